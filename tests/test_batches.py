"""What goes to Python is taken a slice at a time, and expressions of a row are computed once."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
from pagemill.functions import batches
from pagemill.functions import text as T
from pagemill.operators import chunking, strategy
from pagemill.sources.pages import basic_text, extract_results

SMALL = "/root/testdata/sf0.001"
WHOLE, SLICED = 250, 251  # eval types of Arrow UDFs as Spark's plans show them: of a batch as one, and of an iterator


def kinds(df):
    """The eval types of a plan's Arrow nodes."""
    return [int(k) for k in re.findall(r"ArrowEvalPython .*\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())]


def planned(spark, name):
    return kinds(__spark_entry__.queries()[name](spark, SMALL))


def test_slices_are_bounded_and_whole():
    texts = pa.array([None, "", "x" * 3_000_000, *(str(k) * 4000 for k in range(2000))])
    parts = [a for a, _ in batches.slices((texts, texts))]
    assert pa.concat_arrays(parts).equals(texts)
    assert max(p.nbytes for p in parts[1:]) <= 2 * batches.BYTES
    assert list(batches.slices((texts.slice(0, 0),))) == []


def test_slices_are_bounded_where_long_rows_stand_together():
    texts = pa.array([*[""] * 9_000, *["x" * 100_000] * 600, *[None] * 400])
    lists = pa.array([None if t is None else [t, t[:9]] for t in texts.to_pylist()])
    parts = [(a, b) for a, b in batches.slices((texts, lists))]
    assert pa.concat_arrays([a for a, _ in parts]).equals(texts) and pa.concat_arrays([b for _, b in parts]).equals(lists)
    assert max(a.nbytes + b.nbytes for a, b in parts) <= 2 * batches.BYTES
    assert max(len(a) for a, _ in parts) <= batches.ROWS


def test_function_sees_slices_and_rows_stay_in_place(spark):
    rows = spark.range(0, 5000, 1, 1).withColumn("t", F.repeat(F.col("id").cast("string"), F.lit(500)))
    seen = rows.select("id", "t", batches.by_slices(lambda t: pa.array([t.nbytes] * len(t), pa.int64()), "long", F.col("t")).alias("n"), T.split_by_size(F.col("t"), 100_000).alias("s"))
    assert seen.agg(F.max("n")).first()[0] < 2 * batches.BYTES
    assert seen.where("s[0] <> t or size(s) <> 1").count() == 0


def test_chunk_by_size_in_slices(spark):
    assert set(planned(spark, "chunk_by_size")) == {SLICED}


def test_chunk_semantic_in_slices(spark):
    assert set(planned(spark, "chunk_semantic")) == {SLICED}


def test_html_extract_in_slices(spark):
    assert set(planned(spark, "html_extract")) == {SLICED}
    assert len(planned(spark, "html_extract")) == 3  # a worker each for the pages, for all candidates of a title, and for plain text


def test_titles_decoded_together(spark):
    pages = ["<title>a &amp; b</title><h1>c</h1>", "<article><h1>&lt;x&gt;</h1></article><title>t</title>", "<title> </title><h1>&nbsp;</h1>", None]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "html string").select(T.best_title(F.col("html"))).collect()]
    assert got == ["a & b", "<x>", "Untitled", "Untitled"]


def plan(spark, name):
    return __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_markdown_elements_once_a_document(spark):
    above = plan(spark, "markdown_elements").split("Generate explode")[0]
    assert "regexp" not in above and "format_string" not in above


def test_page_context_looks_for_tags_once(spark):
    found = plan(spark, "page_context")
    assert found.count("<(?:meta)") == 2  # the context's and the snapshot's
    assert found.count("<(?:link)") == 1


def test_rating_takes_words_once(spark):
    pieces = "array<struct<content:string>>"
    rows = spark.createDataFrame([([("a B b",), ("b c",), ("",), (" ",)],), ([("x",)],), ([],)], f"p {pieces}")
    rated = rows.select(strategy.rating(F.col("p"), F.lit(10)).alias("r"))
    assert rated._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r[0] for r in rated.select(F.round("r.cohesion", 6)).collect()] == [round((1 / 3 + 0 + 1) / 3, 6), 1.0, 0.0]


def test_auto_quality_explodes_pieces_alone(spark):
    docs = spark.createDataFrame([("u", "a b c")], "url string, text string")
    above = chunking.auto_rated(docs)._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode(")[1].split("\n")[0]
    assert above.startswith("pieces#")


def test_chunk_fixed_in_slices(spark):
    assert set(planned(spark, "chunk_fixed")) == {SLICED}


def test_chunk_articles_in_slices(spark):
    assert set(planned(spark, "chunk_articles")) == {SLICED}


def test_extract_articles_in_slices(spark):
    assert set(planned(spark, "extract_articles")) == {SLICED}


def test_chunk_sections_in_slices(spark):
    assert set(planned(spark, "chunk_sections")) == {SLICED}


def test_basic_text_in_slices(spark):
    """The step that cache_rounds and sink_results share; they run when they are built, so their own plans only read."""
    text = basic_text(F.col("html"), F.lit("text/html"))
    assert kinds(spark.read.parquet(f"{SMALL}/pages.parquet").select(text)) == [SLICED]


def test_page_quality_in_slices(spark):
    assert set(planned(spark, "page_quality")) == {SLICED}


def test_sink_rows_in_slices(spark):
    """All columns of the rows that sink_results writes: no function takes a batch as one."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    replies = pages.select("url", F.lit("text/html").alias("content_type"), F.col("html").alias("content"), F.lit(None).cast("string").alias("error_code"))
    assert kinds(extract_results(replies)) == [SLICED]
