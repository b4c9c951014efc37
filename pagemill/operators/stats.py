"""Statistics of crawls and batches: aggregates, running windows, rate limits and failure runs."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.batches import by_slices
from pagemill.functions.text import STOP_WORDS

_STOP = frozenset(STOP_WORDS)


def _share(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


def batch_statistics(results: DataFrame, ok: str = "ok", ms: str = "ms", chars: str = "chars", cached: str = "cached") -> DataFrame:
    """One row: counts, average, least and most time of successes, characters, cache hits and their share."""
    good = F.col(ok)
    n = F.count(F.lit(1))
    hits = F.count_if(F.col(cached))
    return results.agg(
        n.alias("total"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"),
        F.avg(F.when(good, F.col(ms))).alias("avg_ms"), F.min(F.when(good, F.col(ms))).alias("min_ms"), F.max(F.when(good, F.col(ms))).alias("max_ms"),
        F.sum(F.when(good, F.col(chars))).alias("chars"), hits.alias("cache_hits"), _share(hits, n).alias("hit_rate"),
    )


def count_by(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def as_map(counted: DataFrame, key: str, value: str = "n") -> DataFrame:
    """One row with a map; for keys of a fixed kind (status codes, severities), not for keys that grow with the data."""
    return counted.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("map"))


def progress(events: DataFrame, job: str, order: str, ok: str, ms: str, total: str | None = None) -> DataFrame:
    """Running figures of each job after each event: done, failed, success rate, mean, least and most time, time left.

    Times of zero or less are left out of mean, least and most.
    """
    run = Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    timed = F.when(F.col(ms) > 0, F.col(ms))
    done = F.count(F.lit(1)).over(run)
    out = events.withColumns(
        {
            "done": done, "failed": F.sum((~F.col(ok)).cast("long")).over(run), "mean_ms": F.avg(timed).over(run),
            "min_ms": F.min(timed).over(run), "max_ms": F.max(timed).over(run),
        }
    ).withColumn("success_rate", _share(F.col("done") - F.col("failed"), F.col("done")))
    if total:
        out = out.withColumn("left_ms", F.coalesce("mean_ms", F.lit(0.0)) * F.greatest(F.col(total) - F.col("done"), F.lit(0)))
    return out


def failure_runs(events: DataFrame, key: str, order: str, failed: str, threshold: int = 3) -> DataFrame:
    """Runs of consecutive failures, and whether each would open a circuit breaker."""
    at = Window.partitionBy(key).orderBy(order)
    run = F.row_number().over(at) - F.row_number().over(Window.partitionBy(key, failed).orderBy(order))
    grouped = events.withColumn("run", run).where(F.col(failed)).groupBy(key, "run")
    found = grouped.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("failures"))
    return found.withColumn("opens", F.col("failures") >= threshold).drop("run")


def rate_limit_starts(requests: DataFrame, domain: str, order: str, arrival: str, gap_ms: int = 1000) -> DataFrame:
    """Earliest start of each request when a domain's requests are ``gap_ms`` apart and take no time.

    start_i = max over j <= i of (arrival_j + (i - j) gap): a running maximum.
    """
    at = Window.partitionBy(domain).orderBy(arrival, order)
    place = F.row_number().over(at) * gap_ms
    numbered = requests.withColumn("__p", place)
    head = F.max(F.col(arrival) - F.col("__p")).over(at.rowsBetween(Window.unboundedPreceding, 0))
    started = numbered.withColumn("start_ms", head + F.col("__p")).drop("__p")
    return started.withColumn("wait_ms", F.col("start_ms") - F.col(arrival))


def rate_limit_replay(requests: DataFrame, domain: str, order: str, arrival: str, duration: str, gap_ms: int = 1000) -> DataFrame:
    """As above with durations: start_i = max(arrival_i, end_{i-1} + gap).

    With the sum of durations and gaps before a request taken off, this too is a running maximum.
    """
    at = Window.partitionBy(domain).orderBy(arrival, order)
    before = F.coalesce(F.sum(F.col(duration) + gap_ms).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = requests.withColumn("__b", before)
    head = F.max(F.col(arrival) - F.col("__b")).over(at.rowsBetween(Window.unboundedPreceding, 0))
    return shifted.withColumn("start_ms", head + F.col("__b")).withColumn("end_ms", F.col("start_ms") + F.col(duration)).drop("__b")


_WORD = re.compile(r"\w+")


def _top_words(text: str, most: int) -> list[tuple[str, int]]:
    counts = Counter(w for w in _WORD.findall(text.lower()) if len(w) > 2 and w not in _STOP)
    return sorted(counts.items(), key=lambda x: -x[1])[:most]  # a Counter keeps the order of first appearance, and sorting is stable


def keywords(docs: DataFrame, key: str, text: str = "text", most: int = 10) -> DataFrame:
    """(key, rank, word, n): the most frequent words of over two letters, ties by first appearance; counted inside the row."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"word": w, "n": n} for w, n in _top_words(t or "", most)] for t in texts.to_pylist()], pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))

    top = by_slices(run, "array<struct<word:string,n:long>>", F.col(text))
    return docs.select(key, F.posexplode(top).alias("at", "w")).select(key, (F.col("at") + 1).cast("long").alias("rank"), "w.word", "w.n")


def filled(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``first`` with blank values taken from ``second``, and where each came from."""
    other = second.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    joined = first.join(other, key, "left")
    made = {c: F.when(blank(c), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    source = {f"{c}_from": F.when(~blank(c), "first").when(F.col(f"__{c}").isNotNull(), "second") for c in columns}
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in first.columns], *[v.alias(k) for k, v in source.items()])


def link_degrees(links: DataFrame, source: str, target: str) -> DataFrame:
    """(node, out_links, in_links) of a link table."""
    out = links.select(F.col(source).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = links.select(F.col(target).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.union(into).groupBy("node").agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links"))


# Statistics of crawls, retries, limits, scores and issues


def crawl_statistics(requests: DataFrame, domain: str = "domain", status: str = "status", ms: str = "ms", size: str = "bytes", at: str = "at") -> DataFrame:
    """One row: pages, failures, mean time, bytes, requests a second between the first and the last."""
    n, ok = F.count(F.lit(1)), F.col(status).between(200, 299)
    seconds = (F.max(F.col(at).cast("double")) - F.min(F.col(at).cast("double")))
    return requests.agg(
        n.alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.avg(ms).alias("mean_ms"), F.sum(size).alias("bytes"),
        F.count_distinct(domain).alias("domains"), _share(n, seconds).alias("per_second"),
    )


def resilience_statistics(events: DataFrame, kind: str = "kind", ms: str = "ms") -> DataFrame:
    """One row: events in all and of each kind, and their mean time."""
    names = {"Success": "succeeded", "Failure": "failed", "Retry": "retries", "CircuitBreakerOpened": "breaker_openings", "Timeout": "timeouts", "BulkheadRejected": "rejections"}
    return events.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(kind) == k).alias(n) for k, n in names.items()], F.coalesce(F.avg(ms), F.lit(0.0)).alias("mean_ms"))


def limiter_statistics(waits: DataFrame, domain: str = "domain", wait_ms: str = "wait_ms") -> DataFrame:
    """(domain, requests, delayed, wait_ms, mean_wait_ms) of a rate limiter."""
    return waits.groupBy(domain).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col(wait_ms) > 0).alias("delayed"), F.sum(wait_ms).alias("wait_ms"), F.avg(wait_ms).alias("mean_wait_ms")
    )


def sum_by_category(scores: DataFrame, category: str = "category", value: str = "score") -> DataFrame:
    return scores.groupBy(category).agg(F.sum(value).alias("score"), F.count(F.lit(1)).alias("parts"))


def issue_counts(issues: DataFrame, severity: str = "severity") -> DataFrame:
    """One row: issues in all and of each severity."""
    names = ("Critical", "Error", "Warning", "Info")
    return issues.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(severity) == n).alias(n.lower()) for n in names])


def older_than(rows: DataFrame, at: str, now: Column, hours: float) -> DataFrame:
    return rows.where(F.col(at) < now - F.make_dt_interval(secs=F.lit(hours * 3600)))


def within_hours(at: Column, start: str, end: str) -> Column:
    """Whether the time of day lies between two ``HH:mm:ss`` times, both included."""
    time = F.date_format(at, "HH:mm:ss")
    return (time >= start) & (time <= end)


def score_summary(scores: DataFrame, key: str, category: str = "category", value: str = "score") -> DataFrame:
    """(key, total, summary): the sum of each category as text, categories in order of name; ``1.00 (a: 0.40, b: 0.60)``."""
    by = scores.groupBy(key, category).agg(F.sum(value).alias("sum"))
    fixed = lambda c: F.format_string("%.2f", c)
    parts = F.array_sort(F.collect_list(F.concat(F.col(category), F.lit(": "), fixed(F.col("sum")))))  # a part for each category
    made = by.groupBy(key).agg(F.sum("sum").alias("total"), F.array_join(parts, ", ").alias("parts"))
    return made.select(key, "total", F.concat(F.lit("Total: "), fixed(F.col("total")), F.lit(" ("), F.col("parts"), F.lit(")")).alias("summary"))


def with_next(rows: DataFrame, key: str, value: str, into: str, block: int = 1 << 16) -> DataFrame:
    """``rows`` with the ``value`` of the next larger ``key`` (a number), null at the end.

    Keys are cut into blocks of ``block`` consecutive numbers; a row's next one is in its block, or the first of the next
    block that has any: only one row a block is ordered in one place.
    """
    cut = rows.withColumn("__block", F.floor(F.col(key) / block))
    inside = F.lead(value).over(Window.partitionBy("__block").orderBy(key))
    last = F.lead(key).over(Window.partitionBy("__block").orderBy(key)).isNull()
    firsts = cut.groupBy("__block").agg(F.min_by(F.struct(F.col(value).alias("v")), key).alias("first"))
    after = firsts.withColumn("after", F.lead("first").over(Window.orderBy("__block"))).select("__block", "after")
    joined = cut.withColumns({"__inside": inside, "__last": last}).join(after, "__block")
    return joined.select(*rows.columns, F.when(F.col("__last"), F.col("after.v")).otherwise(F.col("__inside")).alias(into))
