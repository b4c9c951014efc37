"""Models in batches, the table function, ratings of chunks, structured data."""

import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from pagemill.functions import options, urls
from pagemill.operators import chunking, models, strategy, structure, structured
from pagemill.sources.cache import ContentCache


def test_batches_fill_up_to_a_limit():
    cut = lambda sizes, rows, tokens: [(s.start, s.stop) for s in models.batches_of(sizes, rows, tokens)]
    assert cut([1, 1, 1, 1, 1], 2, 100) == [(0, 2), (2, 4), (4, 5)]
    assert cut([5, 5, 5, 90, 1], 10, 10) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert cut([], 2, 2) == [] and cut([7], 1, 1) == [(0, 1)]


class Sizes:
    """Each vector: the text's length, and how many texts came with it."""

    dimension, max_tokens = 2, 5

    def embed(self, texts):
        return [[len(t), len(texts)] for t in texts]


class Wide(Sizes):
    def embed(self, texts):
        return [[1.0, 2.0, 3.0] for _ in texts]


def test_embedded(spark):
    rows = [(i, "x" * (i * 3)) for i in range(10)] + [(10, None)]
    df = spark.createDataFrame(rows, "id int, t string").coalesce(1)
    found = {r.id: r.v for r in df.select("id", models.embedded(F.col("t"), "sizes", Sizes, rows=4, tokens=8).alias("v")).collect()}
    assert found[10] is None and [found[i][0] for i in range(10)] == [min(i * 3, 20) for i in range(10)]
    assert [found[i][1] for i in range(10)] == [4, 4, 4, 4, 2, 2, 1, 1, 1, 1]
    with pytest.raises(PythonException, match="a vector of 3 numbers"):
        df.select(models.embedded(F.col("t"), "wide", Wide)).collect()


class Picky:
    """Fails on batches and prompts with a mark."""

    def complete(self, prompts):
        if any("!" in p for p in prompts):
            raise ValueError("marked")
        return [f"{len(prompts)}:{p}" for p in prompts]


class Absent:
    def complete(self, prompts):
        raise ConnectionError("down")


def test_completed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b!"), (3, None), (4, "c"), (5, "d"), (6, "e")], "id int, t string").coalesce(1)
    ask = lambda name, load: {r.id: tuple(r.r) for r in df.select("id", models.completed(F.col("t"), name, load, rows=2).alias("r")).collect()}
    found = ask("picky", Picky)
    assert found[1] == ("1:a", None) and found[2] == (None, "ValueError: marked") and found[3] == (None, None) and found[4] == ("2:c", None) and found[6] == ("1:e", None)
    assert set(ask("absent", Absent).values()) == {(None, "ServiceUnavailable"), (None, None)}
    assert df.select(models.complete_with("absent", Absent)(F.col("t")).alias("r")).where("r is not null").count() == 0


def test_chunk_table(spark):
    chunking.register_chunk_table(spark, "cut_table")
    docs = [(1, "s", "# A\none two.\n# B\nthree."), (2, "s", "alpha"), (3, "t", None), (4, "t", "beta gamma " * 40)]
    spark.createDataFrame(docs, "id int, site string, body string").createOrReplaceTempView("cut_docs")
    smart = spark.sql("SELECT * FROM cut_table(TABLE(cut_docs), text => 'body', strategy => 'Smart')")
    assert smart.columns == ["id", "site", "sequence_number", "content", "chunk_type", "heading_path", "section_title"]
    assert [(r.id, r.sequence_number, r.section_title) for r in smart.where("id < 4").orderBy("id", "sequence_number").collect()] == [(1, 0, "A"), (1, 1, "B"), (2, 0, None)]
    small = spark.sql("SELECT id, sequence_number, content FROM cut_table(TABLE(cut_docs), text => 'body', max_tokens => 10, min_tokens => 2, overlap => 0)")
    assert small.where("id = 4").count() > 8 and small.agg(F.max(F.length("content"))).first()[0] <= 40
    numbered = spark.sql("SELECT site, sequence_number FROM cut_table(TABLE(cut_docs) PARTITION BY site ORDER BY id, text => 'body', strategy => 'Smart', number_partition => true)")
    for site in ("s", "t"):
        found = sorted(r.sequence_number for r in numbered.where(F.col("site") == site).collect())
        assert found == list(range(len(found))) and found
    for call, wrong in (("text => 'none'", "no column none"), ("text => 'body', strategy => 'X'", "unknown strategy X"), ("text => 'body', size => 3", "unknown option size"), ("text => 'body', max_tokens => 0", "max_tokens must be positive")):
        with pytest.raises(AnalysisException, match=wrong):
            spark.sql(f"SELECT * FROM cut_table(TABLE(cut_docs), {call})")


def test_rating(spark):
    made = lambda *texts: [(t, "Text", [], None) for t in texts]
    rows = [(1, made("a b c d", "a b c d")), (2, made("a b", "c d e f")), (3, made("only")), (4, [])]
    df = spark.createDataFrame(rows, f"id int, p {chunking.PIECE}").withColumn("n", F.when(F.col("id") == 1, 14).when(F.col("id") == 2, 20).otherwise(4))
    found = {r.id: r.r for r in df.select("id", strategy.rating(F.col("p"), F.col("n")).alias("r")).collect()}
    assert tuple(found[1]) == (2, 1.0, 1.0, 1.0, 0.8, pytest.approx(0.98)) and tuple(found[3]) == (1, 1.0, 1.0, 1.0, 0.8, pytest.approx(0.98)) and tuple(found[4]) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert (found[2].size_consistency, found[2].cohesion, found[2].structure) == (pytest.approx(0.6), 0.0, 0.5)
    counted = df.select("id", strategy.rating(F.col("p"), F.col("n"), lambda t: F.length(t) * 100).alias("r")).where("id < 3")
    assert [(r.id, round(r.r.efficiency, 6)) for r in counted.orderBy("id").collect()] == [(1, 1.0), (2, 1.0)]


def test_auto_results_are_kept(spark, tmp_path):
    """A document that is met again with the same options is neither cut nor rated anew; other texts and options are."""
    store = ContentCache(spark, str(tmp_path / "auto"))
    docs = spark.createDataFrame([("u1", "alpha beta. " * 50), ("u1", "alpha beta. " * 50), ("u2", ""), ("u3", None), ("u4", "gamma")], "url string, text string")
    at = lambda clock: F.lit(f"2024-01-01 {clock}").cast("timestamp")
    run = lambda df, clock, **more: chunking.auto_rated(df, store=store, now=at(clock), **more).select("source_url", "content", "from_cache", "rating.quality").collect()
    plain = sorted((r.source_url, r.content, round(r.rating.quality, 9)) for r in chunking.auto_rated(docs).collect())
    first, second = run(docs, "10:00:00"), run(docs, "10:30:00")
    for found, cached in ((first, False), (second, True)):
        assert sorted((r.source_url, r.content, round(r.quality, 9)) for r in found) == plain and {r.from_cache for r in found} == {cached}
    assert {r.source_url for r in first} == {"u1", "u4"}
    changed = docs.withColumn("text", F.concat("text", F.lit(" end")))
    assert {r.from_cache for r in run(changed, "10:30:00")} == {False}
    assert {r.from_cache for r in run(docs, "10:30:00", options=chunking.ChunkOptions(max_tokens=300))} == {False}


def test_microdata():
    html = """<div itemscope itemtype="https://schema.org/Article/"><h1 itemprop="headline name"> A <b>b</b> </h1><time itemprop="date" datetime="2024-01-02">Jan</time>
    <span itemprop="author" itemscope itemtype="http://schema.org/Person"><a itemprop="url" href="/w">W</a><span itemprop="name">W</span></span>
    <p itemprop="author" itemscope><span itemprop="name">V</span><i itemprop="born"><time>May</time></i></p><meta itemprop="n" content=" 5 "><img itemprop="image" src="i.png"></div>"""
    want = {
        "@type": "Article", "headline": "A b", "name": "A b", "date": "2024-01-02", "author[0].@type": "Person", "author[0].url": "/w", "author[0].name": "W", "author[1].name": "V", "author[1].born": "May", "n": "5",
        "image": "i.png",
    }
    assert structured.microdata_of(html) == want
    two = structured.microdata_of("<p itemscope itemtype='x/T'><b itemprop='a'>1</b></p><p itemscope><b itemprop='a'>2</b></p>")
    assert two == {"[0].@type": "T", "[0].a": "1", "[1].a": "2"} and structured.microdata_of("<p itemprop='loose'>x</p>") == {}


def test_document_metadata_cases(spark):
    pages = [
        ("https://s.com/a", '<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"List"}]</script><script type="application/ld+json">{"@type":"Event","a":1}</script>'
         '<p itemscope itemtype="x/Thing"><b itemprop="a">m</b><b itemprop="c">n</b></p><meta property="twitter:card" content="player"><meta property="article:published_time" content="soon">'),
        ("https://s.com/b", None), ("not a url", ""),
    ]
    found = {r.url: r.document for r in structured.document_metadata(spark.createDataFrame(pages, "url string, html string")).collect()}
    a, b = found["https://s.com/a"], found["https://s.com/b"]
    assert (a.schema_type, a.published, a.twitter.card) == ("Event", None, "player")
    assert a.structured == {"[0].@type": "List", "@type": "Event", "a": "1", "c": "n"}
    assert (b.schema_type, b.twitter, b.structured, b.keywords, b.domain) == (None, None, {}, [], "s.com") and found["not a url"].title is None


def test_flattened_by_levels(spark):
    rows = [(1, '{"@context":"c","@type":"T","a":{"b":[{"c":1.50},{"c":true}]},"n":null,"s":"x","e":{},"f":[],"m":[[{"z":0}],2]}'), (2, '[{"k":1}]'), (3, "bad"), (4, None), (5, '"text"'), (1, '{"s":"again"}')]
    found = structured.flattened_rows(spark.createDataFrame(rows, "id int, json string"), "id", F.col("json")).collect()
    assert sorted((r.id, r.path, r.value) for r in found) == sorted([
        (1, "@type", "T"), (1, "a.b[0].c", "1.5"), (1, "a.b[1].c", "True"), (1, "s", "x"), (1, "m[0][0].z", "0"), (2, "[0].k", "1"), (1, "s", "again"),
    ])
    assert structured.flattened_rows(spark.createDataFrame([], "id int, json string"), "id", F.col("json")).count() == 0


def test_sitemaps_by_xml_and_by_pattern(spark):
    """Namespaces, prefixes, escapes and nesting by XML; texts that aren't well formed by pattern."""
    xml = [
        '<?xml version="1.0"?><s:urlset xmlns:s="http://x"><s:url><s:loc> https://a/1?x=1&amp;y </s:loc></s:url></s:urlset>',
        "<sitemapindex><url><loc>https://a/u</loc></url><sitemap><loc><![CDATA[https://a/s.xml]]></loc></sitemap></sitemapindex>",
        "<urlset><group><url><loc>https://a/deep</loc></url></group><url><x/></url><url><loc> </loc></url></urlset>",
        "<urlset><url><loc>https://a/2</loc></url><url><loc>https://a/3</loc>", "no xml <loc>https://a/4</loc>", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(xml)), "id int, x string")
    found = {r.id: r.l for r in df.select("id", urls.sitemap_locs(F.col("x")).alias("l")).collect()}
    assert found == {0: ["https://a/1?x=1&y"], 1: ["https://a/s.xml", "https://a/u"], 2: ["https://a/deep"], 3: ["https://a/2", "https://a/3"], 4: ["https://a/4"], 5: [], 6: None}


def test_options():
    assert options.checked("crawl", max_pages=1, min_confidence=1.0, max_depth=0) == {"max_pages": 1, "min_confidence": 1.0, "max_depth": 0}
    for kind, given, want in (
        ("crawl", {"max_pages": 0, "min_confidence": 1.1, "max_retries": -1}, "max_pages must be greater than 0; min_confidence must be from 0 to 1; max_retries must be at least 0"),
        ("reconstruct", {"summary_ratio": 0, "temperature": 2.5}, "summary_ratio must be above 0 to 1; temperature must be from 0 to 2"),
        ("html_chunks", {"max_chunk_size": 5, "min_chunk_size": 5}, "max_chunk_size must be greater than min_chunk_size"), ("pipeline", {"speed": 1}, "unknown option speed"),
    ):
        with pytest.raises(ValueError, match=want):
            options.checked(kind, **given)


def test_option_columns(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 1.0), (None, None)], "a int, b double")
    found = [r.f for r in df.select(options.faults("crawl", {"max_pages": F.col("a"), "min_confidence": F.col("b")}).alias("f")).collect()]
    assert found == [["max_pages must be greater than 0", "min_confidence must be from 0 to 1"], [], []]


def test_links_by_name():
    md = "[a][X y] ![b][] [c]\n\n```\n[d]: http://code\n[a][x y]\n```\n- [x] task [B]\n\n[x  Y]: <http://x> \"T\"\n[b]: /b.png\n[b]: /second\n[c]: #c\ntext [d]: no [^1]\n\n[^1]: note\n"
    found = [e[:3] for e in structure._scan(md)]
    assert [e for e in found if e[0] in ("Link", "Image")] == [("Link", "a", "http://x"), ("Image", "b", "/b.png"), ("Link", "c", "#c"), ("Link", "B", "/b.png")]
    assert [e[0] for e in found if e[0] not in ("Link", "Image")] == ["Code", "List", "Footnote"]


def test_blocks_inside_quotes():
    md = "> # Head\n> - a\n> - b\n>\n> > inner [l](u)\n> ```py\n> x\n> ```\nafter\n> again"
    found = [(e[0], e[1], e[4]) for e in structure._scan(md)]
    assert found == [("Quote", "# Head", 0), ("Heading", "Head", 0), ("List", "- a", 2), ("Quote", "inner [l](u)", 0), ("Link", "l", 0), ("Code", "x", 1), ("Quote", "again", 0)]
    assert len(structure._scan(">" * 5_000)) == 21
