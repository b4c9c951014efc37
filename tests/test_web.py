"""The web-content functions and operators on small fixed inputs, and all SQL at the smallest size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pagemill import derived_queries, queries
from pagemill.functions import dom, text, urls
from pagemill.operators import chunking, crawl, enrich, extract, metadata, stats, strategy, structure
from pagemill.sources import pages
from tests import cases

DATA = "/root/testdata/sf0.001"


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values))
    return spark.createDataFrame([values], schema).select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("HTTP://WWW.Example.COM/a/", "http://example.com/a"),
        ("https://example.com:443/a//b", "https://example.com/a/b"),
        ("https://example.com:8443", "https://example.com:8443/"),
        ("http://example.com/#top", "http://example.com/"),
        ("http://example.com/a?B=1#x", "http://example.com/a?B=1"),
        ("not a url", "not a url"),
        ("", ""),
    ],
)
def test_normalize(spark, given, wanted):
    assert one(spark, urls.normalize, given) == wanted


def test_links_are_resolved_and_filtered(spark):
    html = '<a href="/x">1</a><a href=\'../y?q=1\'>2</a><a href="mailto:a@b.c">3</a><a href="#t">4</a><a href="//h.com/z">5</a><a href="">6</a>'
    assert one(spark, urls.extract_links, html, "https://s.com/a/b/c.html") == ["https://s.com/x", "https://s.com/a/y?q=1", "https://h.com/z"]


def test_should_crawl(spark):
    ok = lambda u, **k: one(spark, lambda a, b: urls.should_crawl(a, b, **k), u, "https://s.com/")
    assert ok("https://S.com/a.html") and not ok("https://s.com/a.PDF") and not ok("https://t.com/a") and not ok("ftp://s.com/a")
    assert not ok("https://s.com/a", include=["/b"]) and not ok("https://s.com/ab", exclude=["AB$"])


def test_robots(spark):
    body = "User-agent: A\nUser-agent: *\nDisallow: /private\nAllow: /private/open # yes\nDisallow:\nCrawl-delay: 5\nSitemap: https://s.com/m.xml\n"
    rules = crawl.robots_rules(spark.createDataFrame([("s.com", body)], "host string, body string"))
    found = {(r.agent, r.kind, r.path) for r in rules.collect()}
    assert ("a", "disallow", "/private") in found and ("*", "allow", "/private/open") in found and (None, "sitemap", "https://s.com/m.xml") in found
    assert not any(p == "" for _, _, p in found)
    pages = spark.createDataFrame([("https://s.com/private/x",), ("https://s.com/private/open/1",), ("https://s.com/",), ("https://t.com/private",)], "url string")
    assert {r.url for r in crawl.allowed(pages, rules, "url").collect()} == {"https://s.com/private/open/1", "https://s.com/", "https://t.com/private"}
    assert [(r.host, r.seconds) for r in crawl.crawl_delay(rules).collect()] == [("s.com", 5)]


SITE = {
    "https://s.com/": '<a href="/a">a</a><a href="/b">b</a><a href="https://t.com/">t</a>',
    "https://s.com/a": '<a href="/c">c</a><a href="/">home</a>',
    "https://s.com/b": '<a href="/c/">c</a><a href="/d.pdf">d</a>',
    "https://s.com/c": '<a href="/e">e</a>',
    "https://s.com/e": "end",
}


def test_crawls(spark):
    pages = spark.createDataFrame(list(SITE.items()), "url string, html string")
    seeds = pages.where("url = 'https://s.com/'").select("url")
    found = crawl.crawl(pages, seeds, max_depth=2).orderBy("depth", "place").collect()
    assert [(r.depth, r.url) for r in found] == [(0, "https://s.com/"), (1, "https://s.com/a"), (1, "https://s.com/b"), (2, "https://s.com/c")]
    assert crawl.crawl(pages, seeds, max_depth=5).count() == 5
    deep = crawl.crawl_depth_first(pages, seeds, max_depth=5).orderBy("visit").collect()
    assert [r.url.removeprefix("https://s.com") for r in deep] == ["/", "/a", "/c", "/e", "/b"]
    with pytest.raises(ValueError, match="Browser"):
        crawl.crawler("Browser")


def test_crawl_caps_are_of_a_start(spark, tmp_path):
    pages = spark.createDataFrame(list(SITE.items()), "url string, html string")
    every = pages.select("url")
    count = lambda df: {r.start.removeprefix("https://s.com"): r["count"] for r in df.groupBy("start").count().collect()}
    assert count(crawl.crawl(pages, every, max_pages=2)) == {"/": 2, "/a": 2, "/b": 2, "/c": 2, "/e": 1}
    assert count(crawl.crawl(pages, every, max_pages=3)) == {"/": 3, "/a": 3, "/b": 3, "/c": 2, "/e": 1}
    whole = {"/": 5, "/a": 5, "/b": 3, "/c": 2, "/e": 1}
    assert count(crawl.crawl(pages, every, max_pages=None)) == whole == count(crawl.crawl_depth_first(pages, every))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert count(queries.QUERIES["crawl_site"](spark, str(tmp_path))) == whole
    deep = crawl.crawl_depth_first(pages, every.where("url like '%/'").union(every.where("url like '%/'")), max_depth=1)
    assert sorted((r.visit, r.depth, r.url.removeprefix("https://s.com")) for r in deep.collect()) == [(0, 0, "/")] * 2 + [(1, 1, "/a")] * 2 + [(2, 1, "/b")] * 2


def test_sitemaps(spark):
    assert one(spark, urls.sitemap_locs, "<urlset xmlns='x'><url><loc> https://a/1 </loc></url><url><loc>https://a/2</loc></url></urlset>") == ["https://a/1", "https://a/2"]
    assert one(spark, urls.sitemap_locs, "<broken><loc>https://a/3</loc>") == ["https://a/3"]


def test_tokens_and_language(spark):
    assert one(spark, text.token_estimate, "abcdefgh") == 2 and one(spark, text.token_estimate, " ") == 0 and one(spark, text.token_estimate, "가나다") == 2
    assert one(spark, text.language_by_share, "안녕하세요 hello") == "ko" and one(spark, text.language_by_presence, "") == "unknown"
    assert one(spark, lambda c: text.split_by_size(c, 9), "aa bbb cccc dd") == ["aa bbb", "cccc dd"]


@pytest.mark.parametrize("size", [1, 7, 40])
def test_packed_against_words(size):
    """Against the rule told word by word."""
    import random

    r = random.Random(size)
    for _ in range(200):
        t = "".join(r.choice("ab   c\n") for _ in range(r.randint(0, 60)))
        out, held, n = [], [], 0
        for word in t.split(" ") if t.strip() else []:
            if n and n + len(word) > size:
                out.append(" ".join(held))
                held, n = [], 0
            held.append(word)
            n += len(word) + 1
        assert text.packed(t, size) == out + ([" ".join(held)] if held else [])


def test_chunkers_take_linear_time():
    """Eight times the text takes about eight times the time, not sixty-four."""
    import time

    def took(cut, n):
        body = ("Some words of a sentence here. " * 8 + "\n" + "# Head\n\n") * n
        began = time.perf_counter()
        cut(body, chunking.ChunkOptions())
        return time.perf_counter() - began

    for cut in (chunking.fixed_size, chunking.paragraphs, chunking.smart):
        took(cut, 200)
        assert took(cut, 16_000) < 24 * took(cut, 2_000) + 0.05


def test_extraction(spark):
    html = (
        "<html><head><title>T &amp; U</title><style>x</style></head><body><nav><a href='/'>home</a></nav><article><h1>Head</h1>"
        "<p>Some <b>bold</b> words that are long enough to be kept as content.<p>Next paragraph with a <a href='/l'>link</a> inside of it, and more."
        "<ul><li>one item of the list</li><li>two items of the list</li></ul><div class='ads'>Buy</div></article><footer>f</footer></body></html>"
    )
    row = extract.extract_pages(spark.createDataFrame([("https://s.com/p", html)], "url string, html string")).first()
    assert row.title == "Head" and row.headings == ["# Head"]
    assert "**bold**" in row.fit_markdown and "[link](https://s.com/l)" in row.raw_markdown and "- one item" in row.raw_markdown
    assert "home" not in row.raw_markdown and "Buy" not in row.raw_markdown and "x" != row.raw_markdown
    empty = extract.extract_pages(spark.createDataFrame([("u", None), ("v", "")], "url string, html string")).collect()
    assert [(r.title, r.text, r.word_count) for r in empty] == [("Untitled", "", 0)] * 2


def test_selectors_and_implied_ends():
    root = dom.parse("<ul><li>a<li class='x y'>b</ul><p>1<p id=q>2<div data-ad-slot='1'>3</div>")
    assert [n.text() for n in dom.select(root, (".y", "#q", "[data-ad-slot]"))] == ["b", "2", "3"]


def test_dom_chunks():
    html = "<main><h1>A</h1><p>intro</p><h3>B</h3><pre>code()</pre><h2>C</h2><table><tr><td>1</td><td>2</td></tr></table><ul><li>i</li></ul><nav>no</nav></main>"
    found = extract.dom_chunks(html)
    assert [(c["chunk_type"], c["content"], c["heading_path"]) for c in found] == [
        ("Text", "intro", ["A"]), ("Code", "code()", ["A", "B"]), ("Table", "1 | 2", ["A", "C"]), ("List", "• i", ["A", "C"]),
    ]
    long = "<section><p>" + "A sentence here. " * 40 + "</p></section>"
    parts = extract.dom_chunks(long, 10, 100)
    assert len(parts) > 5 and all(len(c["content"]) <= 100 for c in parts)


def test_chunk_strategies(spark):
    body = "# One\n" + "word " * 700 + "\n# Two\nshort text.\n\nLast paragraph."
    docs = spark.createDataFrame([("u", body), ("v", ""), ("w", None)], "url string, text string")
    options = chunking.ChunkOptions(max_tokens=100, min_tokens=5, overlap=10)
    for name in ("FixedSize", "Paragraph", "Smart", "MemoryOptimized", "Auto"):
        rows = chunking.chunk(docs, name, options).orderBy("sequence_number").collect()
        assert {r.source_url for r in rows} == {"u"} and [r.sequence_number for r in rows] == list(range(len(rows)))
        assert all(len(r.content) <= 4 * 100 + 60 for r in rows) and len({r.chunk_id for r in rows}) == len(rows)
    smart = chunking.chunk(docs, "Smart", options).collect()
    assert {r.section_title for r in smart} >= {"One", "Two"}
    with pytest.raises(ValueError):
        chunking.chunk(docs, "Semantic")
    with pytest.raises(ValueError):
        chunking.chunk(docs, "FixedSize", chunking.ChunkOptions(max_tokens=10, overlap=10))
    meaning = chunking.semantic(spark.createDataFrame([("u", "Red red red. Red red. Blue blue blue.")], "url string, text string"), chunking.hash_embedder)
    assert [r.content for r in meaning.orderBy("sequence_number").collect()] == ["Red red red. Red red.", "Blue blue blue."]


def test_chunkers_of_ones_own(spark):
    def halves(body, options):
        return [(body[: len(body) // 2], "Half", [], None), (body[len(body) // 2 :], "Half", [], None)]

    chunking.register_chunker("Halves", halves)
    try:
        docs = spark.createDataFrame([("u", "abcd")], "url string, text string")
        assert [r.content for r in chunking.chunk(docs, "Halves").orderBy("sequence_number").collect()] == ["ab", "cd"]
        chunking.register_table_function(spark)
        found = spark.sql("SELECT c.* FROM VALUES ('abcd') t(body), LATERAL chunk_text(body, 'Halves') c ORDER BY 1").collect()
        assert [(r.sequence_number, r.content, r.chunk_type) for r in found] == [(0, "ab", "Half"), (1, "cd", "Half")]
    finally:
        chunking.CUTTERS.pop("Halves")


def test_extractors_of_ones_own(spark):
    pages.register_extractor("Default", F.upper)
    try:
        rows = spark.createDataFrame([("x", "image/png"), ("y", "text/plain")], "content string, kind string")
        assert [r.t for r in rows.select(pages.extracted_text(F.col("content"), F.col("kind")).alias("t")).collect()] == ["X", "y"]
    finally:
        pages.EXTRACTORS.clear()


def test_metadata(spark):
    html = (
        "<html lang='ko-KR'><head><meta charset='utf-8'><title>P</title><meta name='description' content='D'><meta content='W' property='og:title'>"
        "<link rel='canonical' href='https://s.com/c'><script type='application/ld+json'>{\"@type\":\"Article\",\"headline\":\"H\",\"author\":{\"name\":\"N\"}}</script>"
        "<script type='application/ld+json'>{bad</script></head><body><h1>a</h1><h3>b</h3><img src='x' alt='y'><img src='z'></body></html>"
    )
    pages = spark.createDataFrame([(1, "https://s.com/p", html)], "page_id int, url string, html string")
    row = metadata.describe(pages).first()
    assert (row.basic.description, row.open_graph.title, row.basic.canonical, row.language.language, row.language.method) == ("D", "W", "https://s.com/c", "ko", "html")
    assert row.accessibility.alt_coverage == 0.5 and not row.accessibility.ordered_headings and 0 < row.quality_score < 1
    ld = metadata.json_ld(pages, "page_id").collect()
    assert [(r.type, r.article.headline, r.article.author, r.product) for r in ld] == [("Article", "H", "N", None)]


def test_site_context(spark):
    html = (
        "<html><head><link rel='next' href='/2'><link rel='alternate' type='application/rss+xml' href='/feed'><meta name='keywords' content='a, b,a'>"
        '<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"B","item":"/b"},{"position":1,"name":"A","item":"/"}]}</script>'
        "</head><body><nav><a href='/x'>x</a></nav><article>t</article><p class='question'>Q?</p><p class='answer'>R.</p></body></html>"
    )
    context = one(spark, metadata.site_context, html, "u")
    assert [(b.text, b.url) for b in context.breadcrumbs] == [("A", "/"), ("B", "/b")] and (context.next, context.feed) == ("/2", "/feed")
    kind = one(spark, lambda h: metadata.classification(h, metadata.meta_tags(h)), html)
    assert kind.kind == "Article" and kind.tags == [] and [x.url for x in one(spark, metadata.navigation, html).nav] == ["/x"]


def test_errors_and_delays(spark):
    assert one(spark, crawl.error_facts, "TimeoutException").retryable and one(spark, crawl.error_facts, "?").category == "General"
    assert [one(spark, lambda a: crawl.delays("exponential", a, 1.0, 5.0), k) for k in (1, 2, 3, 4)] == [1.0, 2.0, 4.0, 5.0]
    assert one(spark, text.title_from_text, "\n  First \nx") == "First" and one(spark, text.description_from_text, "A b. C! D") == "A b. C"


def test_structure(spark):
    md = "---\ntitle: \"My page\"\ntags: x\n---\n# A b?\n## C\n```\n# no\n```\n- [x] t\n| a | b |\n|---|---|\n"
    assert one(spark, structure.front_matter, md) == {"title": "My page", "tags": "x"}
    assert [tuple(h) for h in one(spark, structure.headings, md)] == [(1, "A b?", "a-b"), (2, "C", "c")]
    yaml = "a: 1 # x\nb:\n  c: [p, 'q']\n  d:\n    - e: 2\n      f: 3\n    - g\n'h i': \"#no comment\"\nempty:\nlast: ~\n"
    assert one(spark, structure.yaml_paths, yaml) == {"a": "1", "b.c[0]": "p", "b.c[1]": "q", "b.d[0].e": "2", "b.d[0].f": "3", "b.d[1]": "g", "h i": "#no comment"}


def test_enrichment(spark):
    docs = spark.createDataFrame([("t", None, "body")], "title string, description string, text string")
    reply = lambda p: F.lit('Sure: ```{"title":"X","description":"Y","topics":["a"]}```')
    row = enrich.merged(enrich.with_metadata(docs, reply)).first()
    assert (row.title, row.description, row.metadata_source) == ("t", "Y", "Merged")
    broken = enrich.merged(enrich.with_metadata(docs, lambda p: F.lit("no"))).first()
    assert (broken.title, broken.description, broken.metadata_source) == ("t", None, "Html")
    made = enrich.reconstruct(docs, "Summarize", lambda p: F.lit("b")).first()
    assert (made.result, made.ratio, made.result_quality) == ("b", 0.25, 0.9)


def test_rate_limit_replay(spark):
    rows = [("d", 0, 0, 500), ("d", 1, 100, 0), ("d", 2, 5000, 100), ("e", 3, 50, 0)]
    found = stats.rate_limit_replay(spark.createDataFrame(rows, "dom string, id int, at long, took long"), "dom", "id", "at", "took").orderBy("id").collect()
    assert [r.start_ms for r in found] == [0, 1500, 5000, 50]


def test_strategy_table(spark):
    docs = spark.createDataFrame([("abstract methodology results", "https://x", 0, 0)], "text string, url string, h int, i int")
    row = strategy.scored(docs, "text", "url", "h", "i").select("content_type", strategy.best(F.col("scores")).alias("b")).first()
    assert row.content_type == "Academic" and row.b.strategy == "Semantic"


def test_streaming_equals_batch(spark, tmp_path):
    from pagemill.streaming import streams

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.page_chunks(streams.read(spark, str(tmp_path / "in"), pages.schema, 1))
    streams.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = streams.page_chunks(pages)
    key = ["source_url", "sequence_number", "content"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))


def test_results_stream_equals_batch(spark, tmp_path):
    """Failures are rows of the stream too."""
    from pagemill.streaming import streams

    rows = [(f"u{k}", "text/html" if k % 3 else "application/json", f"<title>t{k}</title>x" if k % 3 else '{"a": 1}', None if k % 4 else "NotFound") for k in range(20)]
    replies = spark.createDataFrame(rows, "url string, content_type string, content string, error_code string")
    replies.repartition(3).write.parquet(str(tmp_path / "in"))
    told = []
    listener = streams.ProgressListener(lambda kind, n: told.append((kind, n)))
    spark.streams.addListener(listener)
    stream = streams.results(streams.read(spark, str(tmp_path / "in"), replies.schema, 1)).select("url", "title", "text", "error_code")
    streams.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = pages.extract_results(replies).select("url", "title", "text", "error_code")
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))
    for _ in range(100):
        if told and told[-1][0] == "completed":
            break
        import time

        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert told[0] == ("started", 0) and told[-1] == ("completed", 20)


def test_job_progress_stream(spark, tmp_path):
    """State is carried over batches, and goes when a job is complete."""
    import datetime

    from pagemill.streaming import streams

    schema = "job string, total long, ok boolean, ts timestamp"
    at = lambda k: datetime.datetime(2024, 1, 1, 0, 0, k)
    parts = [[("a", 3, True, at(1)), ("b", 1, True, at(2))], [("a", 3, False, at(3))], [("a", 3, True, at(4)), ("a", 3, True, at(5))]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.job_progress(streams.read(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1))
        streams.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("job", "updated").collect()
    assert [(r.job, r.processed, r.failed, r.complete) for r in found] == [("a", 1, 0, False), ("a", 2, 1, False), ("a", 4, 1, True), ("b", 1, 0, True)]


def test_next_rows_over_gaps(spark):
    rows = spark.createDataFrame([(k, f"v{k}") for k in (1, 3, 10, 11, 500, 501, 90_000)], "k long, v string")
    found = {r.k: r.n for r in stats.with_next(rows, "k", "v", "n", block=10).collect()}
    assert found == {1: "v3", 3: "v10", 10: "v11", 11: "v500", 500: "v501", 501: "v90000", 90_000: None}


QUERIES = queries.QUERIES | derived_queries.QUERIES | cases.QUERIES
SQL = queries.ORACLE_SQL | derived_queries.ORACLE_SQL | cases.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    mine, theirs = (d[columns].sort_values(columns).reset_index(drop=True) for d in (mine, theirs))
    assert len(mine) == len(theirs) and ((mine == theirs) | (mine.isna() & theirs.isna())).all().all()
