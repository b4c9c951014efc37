"""Registered queries of sources, caches, sinks and streams, and their SQL.

Streams read a table's files, write to new folders under the shared one, and are read back when they have ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagemill.queries import _TEXT, _packed_sql, page_chunks_by_size, table
from pagemill.sources.archive import archive
from pagemill.sources.cache import ContentCache
from pagemill.sources.pages import basic_text, extract_results, fetch_with_retries
from pagemill.sources.shared import shared_dir, written
from pagemill.streaming import monitor, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the pattern takes a folder of files and a single one alike."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name}.parquet*")


# Sources


@query("SELECT url, 'text/html' AS content_type, length(html)::BIGINT AS chars, CASE WHEN html IS NULL OR trim(html, E' \\t\\n\\r\\f\\v') = '' THEN 'EmptyContent' END AS error_code FROM pages")
def archive_pages(spark, sf_dir):
    """The page table through the data source, its pages without content as failures."""
    return archive(spark).load(f"{sf_dir}/pages.parquet").select("url", "content_type", F.length("content").cast("long").alias("chars"), "error_code")


_LATER = "Wed, 03 Jan 2024 00:00:30 GMT"
#: What a server replies to each request, by the first digit of the URL's digest: (digit, request, status, Retry-After, error).
SCRIPT = [
    *[(d, 0, 200, None, None) for d in "0123a"],
    ("4", 0, 429, "7", None), ("4", 1, 200, None, None),
    ("5", 0, 429, None, None), ("5", 1, 429, _LATER, None), ("5", 2, 200, None, None),
    ("6", 0, None, None, "timeout"), ("6", 1, None, None, "network"), ("6", 2, 200, None, None),
    ("7", 0, 503, None, None), ("7", 1, 200, None, None),
    *[("8", k, 404, None, None) for k in range(4)],
    ("9", 0, None, None, "cancelled"), ("9", 1, 200, None, None),
    ("c", 0, None, None, "ssl"), ("c", 1, 200, None, None),
    *[("d", k, 429, "1", None) for k in range(16)],
    *[("e", k, 403, None, None) for k in range(4)],
    ("f", 1, 200, None, None),
]


@query(
    """WITH p AS (SELECT url, min(html) AS html FROM pages GROUP BY url),
    r AS (SELECT page_id, substr(md5(url), 1, 1) AS d, length(p.html)::BIGINT AS chars FROM pages JOIN p USING (url))
    SELECT page_id,
      CASE WHEN d IN ('4', '7', 'c', 'f') THEN 2 WHEN d IN ('5', '6') THEN 3 WHEN d IN ('8', 'b', 'e') THEN 4 WHEN d = 'd' THEN 16 ELSE 1 END AS attempts,
      CASE d WHEN '4' THEN 7 WHEN '5' THEN 90 WHEN '6' THEN 3 WHEN '7' THEN 1 WHEN '8' THEN 7 WHEN 'b' THEN 7 WHEN 'c' THEN 1 WHEN 'd' THEN 19 WHEN 'e' THEN 7 WHEN 'f' THEN 1 ELSE 0 END::DOUBLE AS waited,
      CASE WHEN d = '8' THEN 404 WHEN d IN ('9', 'b') THEN NULL WHEN d = 'd' THEN 429 WHEN d = 'e' THEN 403 ELSE 200 END AS status,
      CASE d WHEN '8' THEN 'NotFound' WHEN '9' THEN 'Timeout' WHEN 'a' THEN 'EmptyContent' WHEN 'b' THEN 'NetworkError' WHEN 'd' THEN 'Blocked' WHEN 'e' THEN 'Blocked' END AS error_code,
      CASE WHEN d IN ('8', '9', 'b', 'd', 'e') THEN NULL WHEN d = 'a' THEN 2 ELSE chars END AS chars
    FROM r"""
)
def fetch_retries(spark, sf_dir):
    """Every page fetched through a reply log: written as an archive by the data source, read back, folded by URL.

    The log is the page table's, with the replies that ``SCRIPT`` gives for a URL's digest.
    """
    pages = table(spark, sf_dir, "pages")
    script = spark.createDataFrame(SCRIPT, "digit string, attempt int, status int, retry_after string, error string")
    body = pages.groupBy("url").agg(F.min("html").alias("html")).withColumn("digit", F.substring(F.md5("url"), 1, 1))
    content = F.when(F.col("status") == 200, F.when(F.col("digit") == "a", "  ").otherwise(F.col("html")))
    log = body.join(script, "digit").select("url", "attempt", "status", "retry_after", "error", F.lit("text/html").alias("content_type"), content.alias("content"))
    folder = shared_dir(spark, "replies")
    replies = archive(spark)  # registers the source, which the writer needs
    log.write.format("page_archive").mode("append").save(folder)
    got = fetch_with_retries(pages.select("url").distinct(), replies.load(folder), now=F.lit("2024-01-03 00:00:00").cast("timestamp"))
    each = pages.select("page_id", "url").join(got, "url")
    return each.select("page_id", F.col("attempts").cast("int").alias("attempts"), "waited", "status", "error_code", F.length("content").cast("long").alias("chars"))


@query(
    f"""WITH u AS (SELECT url, min(html) AS html, substr(md5(url), 1, 1) < '8' AS early FROM pages GROUP BY url),
    t AS (SELECT url, early, length({_TEXT})::BIGINT AS chars FROM u)
    SELECT page_id, chars, early AS second, NOT early AS third, false AS forced, (chars + 1)::BIGINT AS other FROM pages JOIN t USING (url)"""
)
def cache_rounds(spark, sf_dir):
    """The texts of all pages through the cache: at 10:00 for some, at 10:30 and 11:15 for all, by force, and in another format.

    Contents live an hour: at 10:30 those of 10:00 are hits, at 11:15 those of 10:30.
    """
    cache = ContentCache(spark, shared_dir(spark, "cache"))
    pages = table(spark, sf_dir, "pages").groupBy("url").agg(F.min("html").alias("html"))
    at = lambda clock: F.lit(f"2024-01-01 {clock}:00").cast("timestamp")
    texts = lambda rows: rows.select("url", basic_text(F.coalesce("html", F.lit("")), F.lit("text/html")).alias("content"))
    longer = lambda rows: texts(rows).withColumn("content", F.concat("content", F.lit("|")))
    written(cache.through(pages.where(F.substring(F.md5("url"), 1, 1) < "8"), texts, at("10:00")))
    second = written(cache.through(pages, texts, at("10:30")))
    cache.compact(at("10:30"))
    third = written(cache.through(pages, texts, at("11:15")))
    forced = cache.through(pages, texts, at("11:20"), force=True)
    other = cache.through(pages, longer, at("11:20"), kind="PlainText")
    each = table(spark, sf_dir, "pages").select("page_id", "url")
    each = each.join(second.select("url", F.length("content").cast("long").alias("chars"), F.col("from_cache").alias("second")), "url")
    each = each.join(third.select("url", F.col("from_cache").alias("third")), "url").join(forced.select("url", F.col("from_cache").alias("forced")), "url")
    return each.join(other.select("url", F.length("content").cast("long").alias("other")), "url").drop("url")


# Sinks and streams


@query(
    f"""WITH r AS (SELECT url, CASE WHEN html IS NULL OR trim(html, E' \\t\\n\\r') = '' THEN 'EmptyContent' END AS error_code, {_TEXT} AS text FROM pages)
    SELECT url, CASE WHEN error_code IS NULL THEN 'result' ELSE 'failure' END AS outcome, error_code, CASE WHEN error_code IS NULL THEN length(text)::BIGINT END AS chars FROM r"""
)
def sink_results(spark, sf_dir):
    """All pages extracted as a stream into the sink, results and failures in one pass, and read back."""
    pages = stream_of(spark, sf_dir, "pages")
    blank = F.trim(F.coalesce("html", F.lit("")), F.lit(" \t\n\r")) == ""
    replies = pages.select("url", F.lit("text/html").alias("content_type"), F.col("html").alias("content"), F.when(blank, "EmptyContent").alias("error_code"))
    results = extract_results(replies).select("url", "text", "error_code")
    folder = shared_dir(spark, "sink")
    sinks.sink(results, f"{folder}/out", f"{folder}/state").awaitTermination()
    return sinks.read_sink(spark, f"{folder}/out", results.schema).select("url", "outcome", "error_code", F.length("text").cast("long").alias("chars"))


@query(
    """SELECT user_id::VARCHAR AS job, 'completed' AS event, count(*)::BIGINT AS processed, count(*) FILTER (event_type = 'error')::BIGINT AS failed, count(*)::BIGINT AS total,
    CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'error:' || count(*) FILTER (event_type = 'error') ELSE '' END AS errors, max(ts) AS updated FROM events WHERE user_id IS NOT NULL GROUP BY user_id"""
)
def job_monitor(spark, sf_dir):
    """Each user's events as a job of so many steps: what the monitor last said of it."""
    totals = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    events = stream_of(spark, sf_dir, "events").join(totals, "user_id")
    steps = events.select(F.col("user_id").alias("job"), "total", F.when(F.col("event_type") == "error", "error").alias("error_code"), "ts")
    folder, (setting, store) = shared_dir(spark, "monitor"), monitor.STATE_STORE
    before = spark.conf.get(setting)
    spark.conf.set(setting, store)
    try:
        told = monitor.job_monitor(steps)
        told.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    finally:
        spark.conf.set(setting, before)
    last = F.max_by(F.struct("event", "processed", "failed", "total", "errors", "updated"), "processed").alias("r")
    rows = spark.read.schema(told.schema).parquet(f"{folder}/out").groupBy("job").agg(last).select("job", "r.*")
    listed = F.transform(F.array_sort(F.map_entries("errors")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return rows.withColumn("errors", F.array_join(listed, ","))


@query(f"SELECT count(*)::BIGINT AS rows, sum(length(content))::BIGINT AS chars, max(seq)::BIGINT AS last FROM {_packed_sql(f'SELECT page_id AS id, {_TEXT} AS text FROM pages', 1500)} c")
def observed_chunks(spark, sf_dir):
    """What the plan counts of the pages' chunks while they are written."""
    seen = Observation(monitor.CHUNKS)
    chunks = monitor.observed(page_chunks_by_size(table(spark, sf_dir, "pages")), seen, chars=F.sum(F.length("content")), last=F.max("seq"))
    chunks.write.parquet(shared_dir(spark, "chunks"))
    return spark.createDataFrame([(seen.get["rows"], seen.get["chars"], seen.get["last"])], "rows long, chars long, last long")


@query("SELECT event_type AS subscriber, event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type UNION ALL SELECT 'all', event_type, count(*)::BIGINT FROM events GROUP BY event_type")
def subscriptions(spark, sf_dir):
    """The events dealt to a subscriber of each type and one of all, each writing its own; what each one has."""
    kinds = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect()]
    folder, deal = shared_dir(spark, "subscriptions"), sinks.Subscriptions()
    for kind in (*kinds, None):
        deal.subscribe(kind, sinks.keyed_writer(f"{folder}/{kind or 'all'}"))
    events = stream_of(spark, sf_dir, "events")
    events.writeStream.foreachBatch(deal).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    every = None
    for kind in (*kinds, "all"):
        part = spark.read.parquet(f"{folder}/{kind}").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("subscriber"), "event_type", "n")
        every = part if every is None else every.union(part)
    return every
