"""Operator 9: mix sources to target weights by systematic sampling.

Sources share all words by weight, no target exceeding three times its source
(water filling).  A document's expected copies are ``target / source_size``; their
running sum inside the source, shifted by one offset per source, emits a copy for each
integer it crosses.

Documents of a source are ordered by size class, so every stretch of the running sum
holds all sizes in proportion and the words taken come near the target.

Scale: the running sum is two-level.  A source is cut into (size class, salt) cells; a
window numbers rows inside a cell, and a second window over the small cell table gives
each cell's start.  A source with a third of all rows is thus spread over all tasks.

Cases: null text counts 0 words; a null source is one source, last in order; repeated
rows are numbered one after another; a source without words is never taken; an empty
table gives an empty result; other columns, whatever their names, are kept by ``mix`` and ignored
by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import free_name, own_columns, table, word_count

SALTS = 64
SEED = "mix-1"
MOST = 3


def size_class(size: Column) -> Column:
    """Bit length and the three bits below the top one: eight classes an octave, monotone."""
    bits = F.length(F.bin(size)).cast("int")
    return (bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).bitwiseAND(F.lit(7))).cast(
        "int"
    )


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_targets(cells: DataFrame) -> DataFrame:
    """(__src, source_size, target) from the cell table; one row a source."""
    sources = cells.groupBy("__src").agg(F.sum("__words").alias("source_size"))
    by_name = Window.orderBy("__src")  # 0 + name, then 1 for null: one row a source
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    ranked = (
        sources.withColumn("__rank", F.row_number().over(by_name))
        .withColumn("__w", (F.col("__rank") - 1) % 3 + 1)
        .withColumn("__cap", F.lit(MOST) * F.col("source_size"))
    )
    before = F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("__w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = ranked.withColumn("__level", (total - before).cast("double") / after)
    free = F.when(F.col("__level") * F.col("__w") < F.col("__cap"), F.struct("__rank_ratio", "__level"))
    level = level.withColumn("__rank_ratio", F.row_number().over(by_ratio))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = level.withColumn("__lambda", F.min(free).over(everything)["__level"])
    target = F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__lambda"), F.lit(0.0)) * F.col("__w"))
    return level.select("__src", "source_size", target.alias("target"))


def with_copies(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", salts: int = SALTS, seed: str = SEED, into: str = "mix"
) -> DataFrame:
    """``docs`` and a struct ``into`` of size, source_size, target and copies (0 to 3)."""
    own = F.struct(*own_columns(docs))
    keyed = docs.select(
        own.alias("__row"),
        word_count(F.col(text)).alias("__size"),
        F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source))).alias("__src"),
        (_hex(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 8) % salts).cast("int").alias("__salt"),
        F.col(key).alias("__key"),
    ).withColumn("__class", size_class(F.col("__size")))
    cell = ["__src", "__class", "__salt"]
    cells = keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("__rows"), F.sum("__size").alias("__words"))
    starts = Window.partitionBy("__src").orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    begun = cells.select(*cell, F.coalesce(F.sum("__rows").over(starts), F.lit(0)).alias("__start"))
    begun = begun.join(
        source_targets(cells).select("__src", F.col("source_size").alias("__source_size"), F.col("target").alias("__target")),
        "__src",
    )
    inside = Window.partitionBy(*cell).orderBy(F.col("__key").asc_nulls_first(), "__size")
    ranked = keyed.withColumn("__n", F.row_number().over(inside)).join(begun, cell)
    rank = F.col("__start") + F.col("__n")
    rate = F.col("__target") / F.nullif(F.col("__source_size"), F.lit(0))
    offset = _hex(F.concat(F.lit(f"{seed}:"), "__src"), 5) / F.lit(1048576.0)
    crossed = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    copies = F.coalesce(crossed, F.lit(0)).cast("long")
    made = F.struct(F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"))
    return ranked.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns], made.alias(into))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: ``docs``'s columns, and the copy's number as ``copy`` (``copy_`` where that is taken)."""
    into, number = free_name(docs, "mix"), free_name(docs, "copy")
    counted = with_copies(docs, into=into, **options).where(F.col(into)["copies"] > 0)
    return counted.select(*own_columns(docs), F.explode(F.sequence(F.lit(1), F.col(into)["copies"].cast("int"))).alias(number))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return with_copies(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SALTS} AS salt
  FROM documents),
c AS (
  SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS class FROM d),
s AS (
  SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) AS rk FROM d GROUP BY src),
w AS (SELECT *, (rk - 1) % 3 + 1 AS w, {MOST} * source_size AS cap FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level,
         row_number() OVER (ORDER BY cap / w, rk) AS pos FROM w),
t AS (
  SELECT src, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, pos) FROM l WHERE level * w < cap), 0) * w) AS target FROM l),
r AS (
  SELECT c.*, t.source_size, t.target, row_number() OVER (PARTITION BY c.src ORDER BY class, salt, doc_id NULLS FIRST, size) AS i,
         target / nullif(t.source_size, 0) AS rate, ('0x' || substr(md5('{SEED}:' || c.src), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
  FROM c JOIN t USING (src))
SELECT doc_id, size, source_size, target,
       (size * coalesce(floor(i * rate + u) - floor((i - 1) * rate + u), 0))::BIGINT AS taken
FROM r
"""
