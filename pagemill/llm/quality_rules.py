"""Operator 1: learned decision lists over text statistics.

Sequential covering: a rule grows condition by condition (``feature <= cut`` or
``feature > cut``, best FOIL gain) on two thirds of the labelled rows, is pruned from its end
on the other third, and is kept if nine of ten rows that it covers there are bad ones: what a
rule rejects is gone for good.  The rows it covers leave, and the next is
learned.  The ordered rules become one Spark
``CASE WHEN`` chain over statistic columns, which anyone can read.

The statistics of every text are counted in one narrow map (no shuffle).  Rules are learned
from at most ``SAMPLE`` labelled rows, the lowest by hash of their key: the one bounded sample.

Cases: null text has no words; empty texts have all counts 0 and fail the base rule; texts
are read whole; repeated rows get equal results; without labelled rows of both classes there
are no learned rules and the base rule alone decides; null labels are not used, of several labels
of a key the lowest is; other columns, whatever their names, are kept by ``keep_good`` and ignored
by the query.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import SPACE_BYTES, free_name, own_columns, table

SAMPLE = 20_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct")
_CONTINUED = bytes(range(0x80, 0xC0))
_UPPER, _MARKS, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"0123456789"


def _without(data: bytes, chars: bytes) -> int:
    return len(data.translate(None, chars))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window occurring twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    order = np.sort(mixed)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    twice = np.isin(mixed, again)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window:] -= twice
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def text_counts(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS for one UTF-8 text."""
    words = text.split()  # bytes: ASCII white space only
    lines = text.split(b"\n")
    seen, dup = set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    size = len(text)
    return (
        len(words),
        _without(text, SPACE_BYTES + _CONTINUED),
        size - _without(text, SYMBOLS),
        dup,
        repeated_words(words),
        len(lines),
        size - _without(text, _UPPER),
        size - _without(text, _MARKS),
        size - _without(text, _DIGITS),
        len(set(words)),
    )


def _stats(texts: pa.Array) -> pa.Array:
    rows = np.array([text_counts(t.as_py() or b"") for t in texts], np.int64).reshape(len(texts), len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], list(COUNTS))


def text_stats(text: Column) -> Column:
    """All counts of a text as one struct.  Marked so that a later filter can't evaluate it again."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return F.arrow_udf(_stats, kind).asNondeterministic()(text.cast("binary"))


def features(stats: str) -> dict[str, Column]:
    """Ratios the rules may test, from the struct column ``stats``."""
    c = {k: F.col(f"{stats}.{k}").cast("double") for k in COUNTS}
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    return {
        "words": c["n_words"],
        "word_length": over(c["word_chars"], c["n_words"]),
        "symbols_per_word": over(c["n_symbols"], c["n_words"]),
        "marks_per_word": over(c["n_marks"], c["n_words"]),
        "digits_per_char": over(c["n_digits"], c["word_chars"]),
        "upper_per_char": over(c["n_upper"], c["word_chars"]),
        "dup_lines": over(c["n_dup_lines"], c["n_lines"]),
        "repeat_words": over(c["n_repeat_words"], c["n_words"]),
        "distinct_words": over(c["n_distinct"], c["n_words"]),
        "words_per_line": over(c["n_words"], c["n_lines"]),
    }


class Test(NamedTuple):
    feature: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.cut if self.above else x[:, self.feature] <= self.cut


Rule = list[Test]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for test in rule:
        held &= test.holds(x)
    return held


def grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most: int) -> Rule:
    rule: Rule = []
    held = np.ones(len(x), bool)
    while len(rule) < most and (p0 := int(bad[held].sum())) and (n0 := int((~bad)[held].sum())):
        before, best, choice = np.log2(p0 / (p0 + n0)), 1e-9, None
        for f, points in enumerate(cuts):
            order = np.sort(x[held & bad, f])
            wrong = np.sort(x[held & ~bad, f])
            p_low, n_low = np.searchsorted(order, points, "right"), np.searchsorted(wrong, points, "right")
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                gain = p * (np.log2((p + 1e-12) / (p + n + 1e-12)) - before)
                k = int(np.argmax(gain)) if len(points) else 0
                if len(points) and gain[k] > best:
                    best, choice = gain[k], Test(f, above, float(points[k]))
        if choice is None:
            break
        rule.append(choice)
        held &= choice.holds(x)
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    def worth(k: int) -> float:
        held = covered(rule[:k], x)
        p, n = int(bad[held].sum()), int((~bad)[held].sum())
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn_rules(
    x: np.ndarray, bad: np.ndarray, most_rules: int = 24, most_tests: int = 4, precision: float = 0.9, least: int = 5, points: int = 64, seed: int = 1
) -> list[Rule]:
    """An ordered list of rules; a row that any rule covers is judged bad."""
    rules: list[Rule] = []
    if not len(x) or bad.all() or not bad.any():
        return rules
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, points + 1)[:-1])) for f in range(x.shape[1])]
    growing = np.random.default_rng(seed).permutation(len(x)) % 3 > 0
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (bad & left & growing).any():
        g, p = left & growing, left & ~growing
        rule = prune(grow(x[g], bad[g], cuts, most_tests), x[p], bad[p])
        held = covered(rule, x) & left if rule else np.zeros(len(x), bool)
        hit, right = int((held & p).sum()), int((held & p & bad).sum())
        if not rule or int((held & bad).sum()) < least or right < max(precision * hit, 1):
            break
        rules.append(rule)
        left &= ~held
    return rules


def verdict(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """The rules as one ordered conditional: true where a text is kept."""
    names, chain = list(columns), None
    for rule in rules:
        both = F.lit(True)
        for test in rule:
            value = columns[names[test.feature]]
            both = both & (value > test.cut if test.above else value <= test.cut)
        chain = F.when(both, False) if chain is None else chain.when(both, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules for ``label`` = 0 from the ``sample`` labelled rows lowest by hash of their key."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(label).alias("__label"))
        .orderBy(F.xxhash64(key), key)
        .limit(sample)
    )
    # at most ``sample`` rows of two numbers: the bound that makes the broadcast safe
    joined = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen.withColumnRenamed(key, "__key")), "__key")
    one = joined.groupBy("__key", "__label").agg(F.min("__text").alias("__text"))  # of several texts of an id one
    rows = one.select("__label", text_stats(F.col("__text")).alias("__s"))
    found = rows.select("__label", *[v.alias(k) for k, v in features("__s").items()]).toPandas()
    found = found.sort_values(list(found.columns)).to_numpy(float)
    return learn_rules(found[:, 1:], found[:, 0] == 0)


def base_failed(stats: str) -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < 20) | (100 * F.col(f"{stats}.n_repeat_words") > 30 * n)


def judged(docs: DataFrame, rules: list[Rule], text: str = "text", into: str = "rules") -> DataFrame:
    """``docs`` and a struct ``into`` of counts, base_failed and kept."""
    counts = free_name(docs, into + "_counts")
    counted = docs.withColumn(counts, text_stats(F.col(text)))
    failed = base_failed(counts)
    made = F.struct(F.col(counts).alias("counts"), failed.alias("base_failed"), (~failed & verdict(rules, features(counts))).alias("kept"))
    return counted.select(*own_columns(docs), made.alias(into))


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    into = free_name(docs, "rules")
    return judged(docs, rules, text, into).where(F.col(into)["kept"]).select(*own_columns(docs))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    counts = [F.col("rules")["counts"][c].alias(c) for c in COUNTS[:5]]
    return judged(docs, rules).select("doc_id", *counts, "rules.base_failed", "rules.kept")
