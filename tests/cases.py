"""Operators on small written-out inputs, with the rows that must come out as their SQL.

For operators whose input the test tables don't hold (JSON-LD, tables, robots files, replies of servers, settings), and for
those that SQL can't express.  The expected rows are written by hand from the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import dom, quality, urls
from pagemill.functions import text as T
from pagemill.operators import chunking, crawl, enrich, extract, metadata, stats, strategy, structure
from pagemill.sources import pages as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def case(schema: str, rows: list[tuple], result: str, wanted: list[tuple]):
    """Register ``f(rows)`` under its name; ``result`` names its columns and types, ``wanted`` holds its rows."""

    def register(f: Callable[[DataFrame], DataFrame]):
        columns = [c.split() for c in result.split(", ")]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.createDataFrame(rows, schema)).select(*[F.col(n).cast(t).alias(n) for n, t in columns])
        names = ", ".join(f"column{k}::{TYPES[t]} AS {n}" for k, (n, t) in enumerate(columns))
        values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in wanted)
        ORACLE_SQL[f.__name__] = f"SELECT {names} FROM (VALUES {values}) v({', '.join(f'column{k}' for k in range(len(columns)))})"
        return f

    return register


def joined(items, by: str = "|"):
    return F.array_join(items, by, "-")


# URLs


@case(
    "id int, url string", [
        (1, "HTTP://WWW.Example.COM/a/"), (2, "https://example.com:443/a//b"), (3, "https://example.com:8443"), (4, "http://example.com/a?B=1#x"), (5, "not a url"), (6, ""), (7, None),
    ], "id int, normalized string, http boolean, same_as_first boolean", [
        (1, "http://example.com/a", True, True), (2, "https://example.com/a/b", True, False), (3, "https://example.com:8443/", True, False), (4, "http://example.com/a?B=1", True, False),
        (5, "not a url", False, False), (6, "", False, False), (7, None, False, False),
    ],
)
def case_urls(rows):
    return rows.select("id", urls.normalize(F.col("url")).alias("normalized"), urls.is_http(F.col("url")).alias("http"), urls.equivalent(F.col("url"), F.lit("http://example.com/a")).alias("same_as_first"))


@case(
    "id int, srcset string", [(1, "a.jpg 320w, b.jpg 1024w, c.jpg 640w"), (2, "a.jpg 1x, b.jpg 2x"), (3, "a.jpg"), (4, "a.jpg 900w, b.jpg 1.5x"), (5, "")],
    "id int, best string", [(1, "b.jpg"), (2, "b.jpg"), (3, "a.jpg"), (4, "b.jpg"), (5, None)],
)
def case_srcset(rows):
    return rows.select("id", urls.srcset_best(F.col("srcset")).alias("best"))


@case(
    "url string, include string, exclude string", [
        ("https://s.com/a.html", None, None), ("https://s.com/a.PDF", None, None), ("https://t.com/a", None, None), ("ftp://s.com/a", None, None), ("https://S.com/docs/x", None, None), ("https://s.com/private/docs", None, None),
    ], "url string, plain boolean, patterns boolean", [
        ("https://s.com/a.html", True, False), ("https://s.com/a.PDF", False, False), ("https://t.com/a", False, False), ("ftp://s.com/a", False, False), ("https://S.com/docs/x", True, True), ("https://s.com/private/docs", True, False),
    ],
)
def case_crawl_filter(rows):
    start = F.lit("https://s.com/")
    return rows.select("url", urls.should_crawl(F.col("url"), start).alias("plain"), urls.should_crawl(F.col("url"), start, ["/docs"], ["PRIVATE"]).alias("patterns"))


# Crawling

_SITE = [
    ("https://s.com/", '<a href="/a">a</a><a href="/b">b</a><a href="https://t.com/">t</a>'), ("https://s.com/a", '<a href="/c">c</a><a href="/">home</a>'),
    ("https://s.com/b", '<a href="/c/">c</a><a href="/d.pdf">d</a>'), ("https://s.com/c", '<a href="/e">e</a>'), ("https://s.com/e", "end"),
]


@case("url string, html string", _SITE, "depth int, place long, url string, parent string", [
    (0, 0, "https://s.com/", None), (1, 0, "https://s.com/a", "https://s.com/"), (1, 1, "https://s.com/b", "https://s.com/"), (2, 0, "https://s.com/c", "https://s.com/a"),
])
def case_crawl_breadth(pages):
    return crawl.crawler("BreadthFirst")(pages, pages.where("url = 'https://s.com/'").select("url"), max_depth=2)


@case("url string, html string", _SITE, "visit long, depth int, url string", [(0, 0, "https://s.com/"), (1, 1, "https://s.com/a"), (2, 2, "https://s.com/c"), (3, 3, "https://s.com/e"), (4, 1, "https://s.com/b")])
def case_crawl_depth(pages):
    return crawl.crawler("DepthFirst")(pages, pages.where("url = 'https://s.com/'").select("url"), max_depth=5)


@case("url string, html string", _SITE, "place long, url string, found boolean", [(0, "https://www.s.com/b/", True), (1, "https://s.com/none", False), (2, "https://s.com/", True)])
def case_crawl_sitemap(pages):
    xml = "<urlset><url><loc> https://www.s.com/b/ </loc></url><url><loc>https://s.com/none</loc></url><url><loc>https://s.com/</loc></url></urlset>"
    sitemaps = pages.limit(1).select(F.lit("https://s.com/sitemap.xml").alias("url"), F.lit(xml).alias("xml"))
    return crawl.crawler("Sitemap")(sitemaps, pages).withColumn("found", F.col("html").isNotNull())


@case(
    "host string, body string", [("s.com", "User-agent: A\nUser-agent: *\nDisallow: /private\nAllow: /private/open # yes\nDisallow:\nCrawl-delay: 5\nSitemap: https://s.com/m.xml\n"), ("t.com", "User-agent: bot\nDisallow: /\n")],
    "host string, agent string, kind string, path string", [
        ("s.com", "a", "disallow", "/private"), ("s.com", "*", "disallow", "/private"), ("s.com", "a", "allow", "/private/open"), ("s.com", "*", "allow", "/private/open"), ("s.com", "a", "crawl-delay", "5"),
        ("s.com", "*", "crawl-delay", "5"), ("s.com", None, "sitemap", "https://s.com/m.xml"), ("t.com", "bot", "disallow", "/"),
    ],
)
def case_robots_rules(sites):
    return crawl.robots_rules(sites)


@case(
    "url string", [("https://s.com/private/x",), ("https://s.com/private/open/1",), ("https://s.com/",), ("https://t.com/private",), ("https://u.com/a",)],
    "url string, delay long", [("https://s.com/private/open/1", 5), ("https://s.com/", 5), ("https://t.com/private", None), ("https://u.com/a", None)],
)
def case_robots_allowed(links):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 5\n"
    rules = crawl.robots_rules(links.limit(1).select(F.lit("s.com").alias("host"), F.lit(body).alias("body")).union(links.limit(1).select(F.lit("t.com"), F.lit("User-agent: bot\nDisallow: /\n"))))
    kept = crawl.allowed(links, rules, "url").withColumn("host", urls.host(F.col("url")))
    return kept.join(crawl.crawl_delay(rules).withColumnRenamed("seconds", "delay"), "host", "left")


@case(
    "id int, attempt int, after string", [(1, 0, None), (2, 3, None), (3, 1, "7"), (4, 1, "Wed, 03 Jan 2024 00:00:30 GMT"), (5, 1, "Tue, 02 Jan 2024 23:59:00 GMT"), (6, 1, "soon")],
    "id int, wait double", [(1, 1.0), (2, 8.0), (3, 7.0), (4, 30.0), (5, 60.0), (6, 60.0)],
)
def case_retry_after(rows):
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    return rows.select("id", crawl.retry_schedule(rows, "attempt", "after", now).alias("wait"))


@case(
    "attempt int", [(1,), (2,), (3,), (7,)], "attempt int, fixed double, linear double, exponential double", [(1, 2.0, 2.0, 2.0), (2, 2.0, 4.0, 4.0), (3, 2.0, 6.0, 8.0), (7, 2.0, 14.0, 30.0)],
)
def case_delays(rows):
    return rows.select("attempt", *[crawl.delays(p, F.col("attempt"), 2.0, 30.0).alias(p) for p in ("fixed", "linear", "exponential")])


@case(
    "kind string, status int", [("HttpRequestException", 404), ("TimeoutException", 401), ("ArgumentException", 429), ("OutOfMemoryException", 503), ("UnauthorizedAccessException", 302), ("FormatException", 418)],
    "kind string, category string, severity string, retryable boolean, code string, http string", [
        ("HttpRequestException", "Network", "Error", True, "HTTPREQUEST", "NotFound"), ("TimeoutException", "Timeout", "Warning", True, "TIMEOUT", "Blocked"),
        ("ArgumentException", "Validation", "Warning", False, "ARGUMENT", "Blocked"), ("OutOfMemoryException", "Resource", "Critical", False, "OUTOFMEMORY", "ServerError"),
        ("UnauthorizedAccessException", "Authentication", "Error", False, "UNAUTHORIZEDACCESS", "Unknown"), ("FormatException", "General", "Error", True, "FORMAT", "Unknown"),
    ],
)
def case_errors(rows):
    return rows.select("kind", crawl.error_facts(F.col("kind")).alias("f"), crawl.error_code(F.col("status")).alias("http")).select("kind", "f.*", "http")


_REPLIES = [
    ("https://s.com/a", 0, 503, "text/html", ""), ("https://s.com/a", 1, 200, "text/html", "<title>A &amp; B</title><p>caf&eacute; **x**</p><img src='i.png'>"), ("https://s.com/a", 2, 500, "text/html", ""),
    ("https://s.com/b", 0, 404, "text/html", "no"), ("https://s.com/b", 1, 404, "text/html", "no"), ("https://s.com/b", 2, 404, "text/html", "no"),
    ("https://s.com/c", 0, 200, "text/html", "  "), ("https://s.com/d", 1, 200, "application/json", '{"a": 1}'), ("https://s.com/e", 0, 200, "text/markdown", "# T"),
]
_REPLY = "url string, attempt int, status int, content_type string, content string"


def _fetched(replies: DataFrame) -> DataFrame:
    wanted = replies.select("url").distinct().union(replies.limit(1).select(F.lit("https://s.com/none")))
    return sources.fetch_with_retries(wanted, replies, max_retries=2)


@case(_REPLY, _REPLIES, "url string, attempts int, waited double, status int, error_code string", [
    ("https://s.com/a", 2, 1.0, 200, None), ("https://s.com/b", 3, 3.0, 404, "NotFound"), ("https://s.com/c", 1, 0.0, 200, "EmptyContent"), ("https://s.com/d", 2, 1.0, 200, None),
    ("https://s.com/e", 1, 0.0, 200, None), ("https://s.com/none", 3, 3.0, None, "NetworkError"),
])
def case_fetch_retries(replies):
    return _fetched(replies)


@case(_REPLY, _REPLIES, "url string, title string, text string, images int, error_code string", [
    ("https://s.com/a", "A &amp; B", "A & Bcafé **x**", 1, None), ("https://s.com/b", None, None, 0, "NotFound"), ("https://s.com/c", None, None, 0, "EmptyContent"),
    ("https://s.com/d", "JSON Content", '{"a":1}', 0, None), ("https://s.com/e", "Markdown Content", "# T", 0, None), ("https://s.com/none", None, None, 0, "NetworkError"),
])
def case_extract_results(replies):
    return sources.extract_results(_fetched(replies)).withColumn("images", F.size("images"))


@case(_REPLY, _REPLIES, "url string, text string, images int, bare boolean", [
    ("https://s.com/a", "A & Bcafé x", 0, True), ("https://s.com/b", None, 0, True), ("https://s.com/c", None, 0, True), ("https://s.com/d", '{"a":1}', 0, True), ("https://s.com/e", "T", 0, True), ("https://s.com/none", None, 0, True),
])
def case_output_options(replies):
    made = sources.extract_results(_fetched(replies), "PlainText", 11, images=False, metadata=False)
    return made.select("url", "text", F.size("images").alias("images"), F.col("metadata").isNull().alias("bare"))


@case(
    "kind string", [("text/html; charset=utf-8",), ("application/xhtml+xml",), ("application/ld+json",), ("text/xml",), ("text/x-md",), ("text/plain",), ("image/png",), ("",), (None,)],
    "kind string, contains string, exact string", [
        ("text/html; charset=utf-8", "Html", "Text"), ("application/xhtml+xml", "Html", "Html"), ("application/ld+json", "Json", "Text"), ("text/xml", "Xml", "Xml"), ("text/x-md", "Markdown", "Text"),
        ("text/plain", "Text", "Text"), ("image/png", "Default", "Text"), ("", "Default", "Text"), (None, "Default", "Text"),
    ],
)
def case_extractors(rows):
    return rows.select("kind", sources.extractor_for(F.col("kind")).alias("contains"), sources.exact_extractor(F.col("kind")).alias("exact"))


@case(
    "url string, wanted boolean, expires long", [("u1", True, 10), ("u2", True, 3), ("u3", True, None), ("u4", False, 10)],
    "url string, content string, from_cache boolean", [("u1", "c-u1", True), ("u2", None, False), ("u3", None, False)],
)
def case_cache(rows):
    cache = rows.where("expires is not null").select("url", F.concat(F.lit("c-"), "url").alias("content"), F.col("expires").alias("expires_at"))
    return sources.through_cache(rows.where("wanted").select("url"), cache, F.lit(5))


# Text


@case(
    "id int, text string", [(1, "caf&eacute; &copy; &#8217; &middot;"), (2, "&lt;b&gt; &amp;amp; &nbsp;|"), (3, "&unknown; &copy no &#x41;&#X42;"), (4, "plain"), (5, None), (6, "&#0; &#xD800; &apos;")],
    "id int, decoded string", [(1, "café © ’ ·"), (2, "<b> &amp; \u00a0|"), (3, "&unknown; &copy no AB"), (4, "plain"), (5, None), (6, "&#0; &#xD800; '")],
)
def case_entities(rows):
    return rows.select("id", T.decode_entities(F.col("text")).alias("decoded"))


@case(
    "id int, text string", [(1, "안녕하세요 hello"), (2, "これはテスト ok"), (3, "这是一个测试 ok"), (4, "only latin letters and one 가"), (5, ""), (6, "漢字 and かな words of plenty more here")],
    "id int, presence string, share string", [(1, "ko", "ko"), (2, "ja", "ja"), (3, "zh", "zh"), (4, "ko", "en"), (5, "unknown", "en"), (6, "ja", "en")],
)
def case_languages(rows):
    return rows.select("id", T.language_by_presence(F.col("text")).alias("presence"), T.language_by_share(F.col("text")).alias("share"))


@case(
    "id int, text string", [(1, "abcdefgh"), (2, " "), (3, "가나다"), (4, "ab 中文"), (5, "x")], "id int, tokens long, own long", [(1, 2, 8), (2, 0, 1), (3, 2, 3), (4, 3, 5), (5, 1, 1)],
)
def case_tokens(rows):
    """The estimate, and a counter of the caller's own."""
    return rows.select("id", T.count_tokens(F.col("text")).alias("tokens"), T.count_tokens(F.col("text"), F.length).alias("own"))


@case(
    "id int, html string", [
        (1, "<title>T</title><main><h1>In <b>main</b></h1></main>"), (2, "<title> T &amp; U </title><h1>H</h1>"), (3, "<h1>Only</h1>"), (4, "<p>x</p>"), (5, "<article><p>a</p></article><h1>after</h1><title>t</title>"), (6, ""),
    ], "id int, best string, plain string", [(1, "In main", "T"), (2, "T & U", "T &amp; U"), (3, "Only", "Untitled"), (4, "Untitled", "Untitled"), (5, "t", "t"), (6, "Untitled", "Untitled")],
)
def case_titles(rows):
    return rows.select("id", T.best_title(F.col("html")).alias("best"), T.title_of(F.col("html")).alias("plain"))


@case(
    "id int, md string", [(1, "# A\n\nFirst line.\n\n\n\n## B\nSecond.\nThird.\nFourth.\n![i](x.png) ![i](x.png)"), (2, ""), (3, "one\r\ntwo\x07 three")],
    "id int, headings string, images string, description string, normalized long, cleaned string", [
        (1, "# A|## B", "x.png", "First line. Second. Third.", 69, None), (2, "", "", "", 0, ""), (3, "", "", "one two\x07 three", 15, "one\ntwo three"),
    ],
)
def case_markdown_text(rows):
    md = F.col("md")
    return rows.select(
        "id", joined(T.markdown_headings(md)).alias("headings"), joined(T.markdown_images(md)).alias("images"), T.description_of(md).alias("description"),
        F.length(T.normalize_markdown(md)).cast("long").alias("normalized"), F.when(F.col("id") > 1, T.preprocess(md)).alias("cleaned"),
    )


@case(
    "id int, text string, html string", [(1, "x" * 60, None), (2, "short", None), (3, "  a   b  " * 10, None), (4, None, None)],
    "id int, size int, title string, first string", [(1, 60, "x" * 60, "x" * 60), (2, 0, "short", "short"), (3, 0, "a   b    a   b    a   b    a   b    a   b    a   b    a   b    a   b    a   b    a   b", "a   b    a   b    a   b    a   b    a   b    a   b    a   b    a   b    a   b    a   b"), (4, None, None, "")],
)
def case_plain_text(rows):
    text = F.col("text")
    return rows.select("id", F.length(T.postprocess(text)).alias("size"), T.title_from_text(text).alias("title"), F.coalesce(T.description_from_text(text), F.lit("")).alias("first"))


@case(
    "id int, fit string, raw string, main string, text string", [(1, "f", "r", "m", "t"), (2, " ", "r", "m", "t"), (3, None, None, "m", "t"), (4, "", "", "", "t"), (5, None, None, None, None)],
    "id int, best string", [(1, "f"), (2, "r"), (3, "m"), (4, "t"), (5, None)],
)
def case_best_content(rows):
    return rows.select("id", T.best_content(*map(F.col, ("fit", "raw", "main", "text"))).alias("best"))


@case(
    "id int, a string, b string", [(1, "a b c", "b c d"), (2, "", ""), (3, "A b", "a B"), (4, "a", "")], "id int, similarity double, only_a string", [(1, 0.5, "a"), (2, 1.0, ""), (3, 1.0, "A|b"), (4, 0.0, "a")],
)
def case_word_sets(rows):
    x, y = T.words(F.col("a")), T.words(F.col("b"))
    return rows.select("id", T.jaccard(x, y).alias("similarity"), joined(F.array_except(x, y)).alias("only_a"))


# Pages

_PAGE = (
    "<html><head><title>T &amp; U</title><style>x</style></head><body><nav><a href='/'>home</a></nav><article><h1>Head</h1>"
    "<p>Some <b>bold</b> words that are long enough to be kept as content.<p>Next paragraph with a <a href='/l'>link</a> inside of it, and more."
    "<ul><li>one item of the list</li><li>two items of the list</li></ul><div class='ads'>Buy</div></article><footer>f</footer></body></html>"
)
_PAGE_MD = (
    "# Head\n\nSome **bold** words that are long enough to be kept as content.\n\nNext paragraph with a [link](https://s.com/l) inside of it, and more.\n\n- one item of the list\n- two items of the list"
)


@case(
    "url string, html string", [("https://s.com/p", _PAGE), ("u", None), ("v", "")], "url string, title string, text string, headings string, word_count long, reading_minutes double", [
        ("https://s.com/p", "Head", _PAGE_MD, "# Head", 36, 1.0), ("u", "Untitled", "", "", 0, 1.0), ("v", "Untitled", "", "", 0, 1.0),
    ],
)
def case_extract_page(pages):
    return extract.extract_pages(pages).withColumn("headings", joined("headings"))


_DENSITY = (
    "<body><div id='menu'><a href='/a'>Home</a> <a href='/b'>About</a></div><div class='content'>" + "Words of the text that stays. " * 3 + "</div>"
    "<ul><li><a href='/c'>First linked item of a long list</a></li><li><a href='/d'>Second linked item</a></li></ul>"
    "<p><a href='/e'>A linked paragraph stays, since it is no container</a></p><figure><img src='i'>cap</figure><div></div><section class='sidebar'>Some longer words beside the text here</section></body>"
)


@case("id int, html string", [(1, _DENSITY)], "place int, tag string, score double", [
    (0, "div", -1.0), (1, "div", 1.2), (2, "ul", -0.5), (3, "figure", 0.5), (4, "div", 0.0), (5, "section", 1.2),
])
def case_density(pages):
    """Link-only blocks fall below zero, paragraphs aren't scored, images protect short captions, names add and take."""
    return extract.density_scores(pages, "id").select("place", "tag", F.round("score", 1).alias("score"))


@case("url string, html string", [("https://s.com/", _DENSITY)], "kept boolean, menu boolean, listed boolean, linked boolean", [(True, False, False, True)])
def case_density_filter(pages):
    def run(html: str) -> str:
        return dom.markdown(extract.dense(dom.parse(html)))

    made = pages.select(T.by_text(lambda t: [run(t)])(F.col("html"))[0].alias("md"))
    has = lambda words: F.contains("md", F.lit(words))
    return made.select(has("Words of the text").alias("kept"), has("Home").alias("menu"), has("First linked").alias("listed"), has("A linked paragraph").alias("linked"))


@case("id int, html string", [
    (1, "<h2>A <em>b</em></h2><p>one<br>two</p><ol><li>x<ul><li>y</li></ul></li><li>z</li></ol><blockquote>q</blockquote><pre><code>c = 1</code></pre><hr><p><a href='/l'>t</a> <img src='s' alt='a'> <code>k</code></p>"),
    (2, "<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2</td></tr></table>"), (3, ""),
], "id int, md string", [
    (1, "## A *b*\n\none\ntwo\n\n1. x\n  - y\n2. z\n\n> q\n\n```\nc = 1\n```\n\n* * *\n\n[t](/l) ![a](s) `k`"), (2, "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"), (3, ""),
])
def case_html_to_markdown(pages):
    return pages.select("id", T.by_text(lambda t: [dom.markdown(dom.parse(t))])(F.col("html"))[0].alias("md"))


@case("url string, html string", [
    ("a", "<main><h1>A</h1><p>intro  text</p><h3>B</h3><pre>code()</pre><h2>C</h2><table><tr><td>1</td><td>2</td></tr></table><ul><li>i</li></ul><nav>no</nav></main>"),
    ("b", "<body><section><p>tiny</p><p>" + "A sentence here. " * 12 + "</p></section></body>"), ("c", None),
], "source_url string, sequence_number long, chunk_type string, content string, path string", [
    ("a", 0, "Text", "intro  text", "A"), ("a", 1, "Code", "code()", "A|B"), ("a", 2, "Table", "1 | 2", "A|C"), ("a", 3, "List", "• i", "A|C"),
    ("b", 0, "Text", "tiny\n\n" + " ".join(["A sentence here."] * 12), ""), ("c", 0, "Text", "words of the page", ""),
])
def case_chunk_dom(pages):
    texts = pages.withColumn("text", F.when(F.col("url") == "c", "words of the page").otherwise("unused"))
    return chunking.chunk(texts, "DomStructure").withColumn("path", joined("heading_path"))


_MD = "# One\nalpha beta\n\n## Two\ngamma. delta\n\nlast paragraph. with words"


@case("url string, text string", [("a", "p1 " * 3 + "\n\nq2\n\n" + "r3 " * 30), ("b", ""), ("c", None)], "source_url string, sequence_number long, content string", [
    ("a", 0, "p1 p1 p1\n\nq2"), ("a", 1, ("r3 " * 13).strip()), ("a", 2, ("r3 " * 13).strip()), ("a", 3, "r3 r3 r3 r3"),
])
def case_chunk_paragraph(docs):
    """Small ones join the next, large ones are packed: at least 10 characters, at most 40."""
    return chunking.chunk(docs, "Paragraph", chunking.ChunkOptions(max_tokens=10, min_tokens=3, overlap=0))


@case("url string, text string", [("a", " ".join(f"w{k}" for k in range(12)))], "sequence_number long, content string", [(0, "w0 w1 w2 w3 w4"), (1, "w4 w5 w6 w7 w8 w9"), (2, "w9 w10 w11")])
def case_chunk_fixed(docs):
    """Sixteen characters a chunk, and the end of the one before from a word's start."""
    return chunking.chunk(docs, "FixedSize", chunking.ChunkOptions(max_tokens=5, min_tokens=1, overlap=1))


@case("url string, text string", [("a", _MD)], "sequence_number long, content string, section_title string", [
    (0, "# One", "One"), (1, "alpha beta", None), (2, "## Two\ngamma. delta\n\nlast paragraph. with words", "Two"),
])
def case_chunk_smart(docs):
    """A short line without a full stop counts as a heading too."""
    return chunking.chunk(docs, "Smart")


@case("url string, text string", [("a", "Red red red. Red red. Blue blue blue. Blue blue."), ("b", None)], "source_url string, sequence_number long, content string", [("a", 0, "Red red red. Red red."), ("a", 1, "Blue blue blue. Blue blue.")])
def case_chunk_semantic(docs):
    def embed(sentences):
        return F.transform(sentences, lambda s: F.array(F.regexp_count(F.lower(s), F.lit("red")).cast("double"), F.regexp_count(F.lower(s), F.lit("blue")).cast("double")))

    return chunking.semantic(docs, embed)


@case("url string, text string", [("https://blog.example/x", "Just a few plain words."), ("https://s.com", "class function method api endpoint")], "source_url string, sequence_number long, strategy string, content string", [
    ("https://blog.example/x", 0, "FixedSize", "Just a few plain words."), ("https://s.com", 0, "Paragraph", "class function method api endpoint"),
])
def case_chunk_auto(docs):
    """Semantic scores best for the second, and has no embedder here: Paragraph."""
    return chunking.chunk(docs, "Auto")


@case("n int, m int, o int, t double", [(512, 100, 64, 0.5), (0, 0, 0, 0.5), (10, 10, 20, 2.0), (10, -1, -1, 0.1)], "n int, errors int", [(512, 0), (0, 3), (10, 3), (10, 2)])
def case_chunk_options(rows):
    made = [(r.n, len(chunking.ChunkOptions(r.n, r.m, r.o, threshold=r.t).errors())) for r in rows.collect()]  # four rows of settings
    return rows.sparkSession.createDataFrame(made, "n int, errors int")


# Metadata

_HEAD = (
    "<html lang='ko-KR'><head><meta charset='utf-8'><title>P</title><meta name='description' content='D > d'><meta content='W' property='og:title'><meta property=\"og:image\" content=\"i.png\">"
    "<meta name='keywords' content='a, b,,c'><meta name=author content=Me><meta name='viewport' content='w'><meta property='article:section' content='News'><meta property='article:tag' content='x, y'>"
    "<meta name='twitter:card' content='summary'><meta name='DC.creator' content='Dc'><meta property='article:published_time' content='2024-05-06T07:08:09Z'>"
    "<link rel='canonical' href='https://s.com/c'><link rel='alternate' hreflang='de' href='/de'><link rel='manifest' href='/m'><link rel='amphtml' href='/amp'>"
)
_BODY = "</head><body><h1>a</h1><h3>b</h3><img src='x' alt=''><img src='z'><a href='#main' class='skip'>s</a><a rel='tag' href='/t'>y</a><a class='tags' href='/u'>z</a><a>none</a></body></html>"
_SCRIPTS = (
    '<script type="application/ld+json">{"@type":"NewsArticle","headline":"H","author":{"name":"N"},"publisher":"Pub","datePublished":"2024-01-02T00:00:00Z","articleSection":"S","keywords":["k1","","k2"]}</script>'
    '<script type="application/ld+json">{"@type":"Product","name":"Pr","brand":{"name":"Br"},"category":"Cat"}</script><script type="application/ld+json">{bad</script>'
    '<script type="application/ld+json">{"@type":"Organization","name":"Org","url":"https://o"}</script><script type="application/ld+json">{"@type":"Article","author":"Plain","keywords":"q, r"}</script>'
)
_PAGES = [(1, "https://s.com/p", _HEAD + _SCRIPTS + _BODY), (2, "http://s.com/q", "<p>x</p>"), (3, None, None)]
_PAGE_COLUMNS = "page_id int, url string, html string"


@case(_PAGE_COLUMNS, _PAGES, "page_id int, title string, description string, keywords string, author string, canonical string, language string, charset string, published string, alternates string, og string, card string, creator string", [
    (1, "P", "D > d", "a|b|c", "Me", "https://s.com/c", "ko-KR", "utf-8", "2024-05-06 07:08:09", "de=/de", "W|i.png", "summary", "Dc"),
    (2, None, None, "", None, None, None, None, None, "", "", None, None), (3, None, None, "", None, None, None, None, None, "", "", None, None),
])
def case_metadata(pages):
    made = metadata.describe(pages)
    return made.select(
        "page_id", "basic.*", "open_graph", "twitter", "dublin_core").select(
        "page_id", "title", "description", joined("keywords").alias("keywords"), "author", "canonical", "language", "charset", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"),
        joined(F.transform("alternates", lambda a: F.concat(a["language"], F.lit("="), a["href"]))).alias("alternates"), F.concat_ws("|", "open_graph.title", "open_graph.image").alias("og"),
        F.col("twitter.card").alias("card"), F.col("dublin_core.creator").alias("creator"),
    )


@case(_PAGE_COLUMNS, _PAGES, "page_id int, place int, type string, kind string, name string, who string, more string, keywords string", [
    (1, 0, "NewsArticle", "article", "H", "N", "Pub|S|2024-01-02", "k1|k2"), (1, 1, "Product", "product", "Pr", "Br", "Cat", None), (1, 2, "Organization", "organization", "Org", None, "https://o", None),
    (1, 3, "Article", "article", None, "Plain", "", "q|r"),
])
def case_json_ld(pages):
    made = metadata.json_ld(pages, "page_id")
    return made.select(
        "page_id", "place", "type", "kind", F.coalesce("article.headline", "product.name", "organization.name").alias("name"), F.coalesce("article.author", "product.brand").alias("who"),
        F.concat_ws("|", "article.publisher", "article.section", F.date_format("article.published", "yyyy-MM-dd"), "product.category", "organization.url").alias("more"), joined("article.keywords").alias("keywords"),
    )


@case(_PAGE_COLUMNS, _PAGES, "page_id int, https boolean, needs_javascript boolean, has_viewport boolean, has_manifest boolean, is_amp boolean, alt_coverage double, ordered_headings boolean, skip_link boolean, aria boolean, score long", [
    (1, True, False, True, True, True, 0.5, False, True, False, 35), (2, False, False, False, False, False, 1.0, False, False, False, 40), (3, False, False, False, False, False, 1.0, False, False, False, 40),
])
def case_technical_accessibility(pages):
    return metadata.describe(pages).select("page_id", "technical.*", "accessibility.*")


@case("id int, html string", [
    (1, "<h1>a</h1><h2>b</h2><h4>c</h4>"), (2, "<h1>a</h1><h2>b</h2><h1>c</h1><h2>d</h2>"), (3, "<h2>a</h2>"), (4, "<script>x</script><p aria-label='l'>t</p>"), (5, "<script type='text/javascript'></script><html amp>"), (6, "<script type=module></script>"),
], "id int, ordered boolean, aria boolean, js boolean, amp boolean", [(1, False, False, False, False), (2, True, False, False, False), (3, False, False, False, False), (4, False, True, True, False), (5, False, False, True, True), (6, False, False, False, False)])
def case_page_rules(rows):
    html = F.col("html")
    a, t = metadata.accessibility(html), metadata.technical(html, F.lit("u"))
    return rows.select("id", a["ordered_headings"].alias("ordered"), a["aria"].alias("aria"), t["needs_javascript"].alias("js"), t["is_amp"].alias("amp"))


@case(_PAGE_COLUMNS, _PAGES, "page_id int, basic double, og double, twitter double, schema double, structure double, technical double, quality double, completeness double, missing string, advice int", [
    (1, 1.0, 0.5, 0.25, 0.8, 0.7, 1.0, 0.75, 0.6375, "", 1), (2, 0.0, 0.0, 0.0, 0.0, 0.2, 0.2, 0.09, 0.0, "title|description|og:image", 3), (3, 0.0, 0.0, 0.0, 0.0, 0.0, 0.2, 0.06, 0.0, "title|description|og:image", 3),
])
def case_metadata_scores(pages):
    made = metadata.describe(pages)
    names = {"basic_score": "basic", "open_graph_score": "og", "twitter_score": "twitter", "schema_score": "schema", "structure_score": "structure", "technical_score": "technical", "quality_score": "quality", "completeness": "completeness"}
    return made.select("page_id", *[F.round(c, 6).alias(n) for c, n in names.items()], joined("missing").alias("missing"), F.size("recommendations").alias("advice"))


@case("id int, html string", [
    (1, _HEAD + _BODY), (2, "<div class='product-card'>x</div>"), (3, "<div class='docs'></div>"), (4, "<pre></pre>" * 6), (5, "<article>x</article><div class='product'>"), (6, "<meta property='og:type' content='article'>"), (7, "<p>x</p>"),
], "id int, kind string, categories string, tags string", [
    (1, "Webpage", "News", "x|y|z"), (2, "Product", "", ""), (3, "Documentation", "", ""), (4, "Documentation", "", ""), (5, "Article", "", ""), (6, "Article", "", ""), (7, "Webpage", "", ""),
])
def case_classification(rows):
    made = rows.select("id", metadata.classification(F.col("html"), metadata.meta_tags(F.col("html"))).alias("c"))
    return made.select("id", "c.kind", joined("c.categories").alias("categories"), joined("c.tags").alias("tags"))


@case("id int, html string, header string", [
    (1, "<html lang='pt-BR'>x", None), (2, "<p>x</p>", "de-CH"), (3, "<p>한국어 문장입니다</p>", None), (4, "<p>日本語の文章です</p>", None), (5, "<p>ひらがなカナの漢</p>", None), (7, "<html lang='fil-PH'>", None), (6, "<p>english</p>", ""),
], "id int, language string, method string", [(1, "pt", "html"), (2, "de", "header"), (3, "ko", "characters"), (4, "zh", "characters"), (5, "ja", "characters"), (7, "fil-ph", "html"), (6, "en", "characters")])
def case_page_language(rows):
    made = rows.select("id", metadata.language(F.col("html"), F.col("html"), F.col("header")).alias("l"))
    return made.select("id", "l.*")


@case("id int, html string", [
    (1, "<link rel='next' href='/2'><link rel='alternate' type='application/rss+xml' href='/feed'><script type=\"application/ld+json\">{\"@type\":\"BreadcrumbList\",\"itemListElement\":[{\"position\":2,\"name\":\"B\",\"item\":\"/b\"},{\"position\":1,\"name\":\"A\",\"item\":\"/\"}]}</script>"),
    (2, "<nav class='breadcrumb'><a href='/'>Home</a> / <a href='/x'>X <b>y</b></a></nav><link rel='prev' href='/0'>"), (3, ""),
], "id int, crumbs string, previous string, next string, feed string", [(1, "A=/|B=/b", None, "/2", "/feed"), (2, "Home=/|X y=/x", "/0", None, None), (3, "", None, None, None)])
def case_site_context(rows):
    made = rows.select("id", metadata.site_context(F.col("html"), F.lit("u")).alias("c"))
    return made.select("id", joined(F.transform("c.breadcrumbs", lambda b: F.concat(b["text"], F.lit("="), b["url"]))).alias("crumbs"), "c.previous", "c.next", "c.feed")


@case("id int, html string", [
    (1, "<header><a href='/h'>H</a></header><nav><a href='/n'>N</a><a href='/n'>N</a></nav><aside><a href='/s'>S</a></aside><footer><a href='/f'>F</a><a href='/sitemap.xml'>M</a></footer><a class='related' href='/r'>R</a><a class='home' href='/home'>T</a><link type='application/rss+xml' href='/rss'>"),
    (2, "<p>x</p>"),
], "id int, header string, nav string, aside string, footer string, related string, home string, sitemap string, feed string", [(1, "/h", "/n|/n", "/s", "/f|/sitemap.xml", "/r", "/home", "/sitemap.xml", "/rss"), (2, "", "", "", "", "", None, None, None)])
def case_navigation(rows):
    made = rows.select("id", metadata.navigation(F.col("html")).alias("n")).select("id", "n.*")
    plain = lambda c: joined(F.transform(c, lambda x: x["url"])).alias(c)
    return made.select("id", plain("header"), plain("nav"), plain("aside"), plain("footer"), joined("related").alias("related"), "home", "sitemap", "feed")


@case("id int, html string", [
    (1, "<div class='faq-item'><h3>Q?</h3><p>no</p><p class='the-answer'>R.</p></div><div class='question'><span class='question-text'>S?</span><div class='response'>T <b>u</b></div></div><div class='faq'><h4>only</h4></div>"), (2, ""),
], "id int, question string, answer string", [(1, "Q?", "R."), (1, "S?", "T u")])
def case_faq(rows):
    return rows.select("id", F.explode(extract.faq(F.col("html"))).alias("f")).select("id", "f.*")


@case("url string, html string", [("https://s.com/d/", "<body><p>Some words that are long enough to stay here.</p><img alt='i' src='s.png' srcset='/a.png 320w, b.png 2x, c.png 640w'><img alt='j' src='k.png' srcset=''></body>")], "url string, text string", [
    ("https://s.com/d/", "Some words that are long enough to stay here.\n\n![i](https://s.com/d/b.png)![j](https://s.com/d/k.png)"),
])
def case_image_sources(pages):
    return extract.extract_pages(pages)


@case("id int, title string, description string, reply string", [
    (1, "Html", None, 'ok {"title":"Ai","description":"D","topics":["a",""," b"],"language":"en","confidence":0.9,"schemaSpecificData":{"apiVersion":"v1","libraries":["x","y"]}}'), (2, None, None, '{"title":"Ai","author":"Me"}'), (3, "Only", "Own", "none"),
], "id int, title string, title_from string, description string, description_from string, author string, topics string, confidence double, version string, libraries string", [
    (1, "Html", "Html", "D", "Ai", None, "a| b", 0.9, "v1", '["x","y"]'), (2, "Ai", "Ai", None, None, "Me", None, None, None, None), (3, "Only", "Html", "Own", "Html", None, None, None, None, None),
])
def case_schema_metadata(docs):
    """The page's own values first, the model's for the others, and what the schema asks for besides."""
    made = enrich.with_schema(docs.withColumns({"text": F.lit("body"), "url": F.lit("https://s.com")}), "TechnicalDoc", lambda prompt: F.col("reply"))
    specific = F.col("enriched.specific")
    return made.select("id", "enriched.title", "enriched.title_from", "enriched.description", "enriched.description_from", "enriched.author", joined("enriched.topics").alias("topics"), "enriched.confidence",
                       specific["apiVersion"].alias("version"), specific["libraries"].alias("libraries"))


@case("schema string", [("General",), ("TechnicalDoc",), ("ProductManual",), ("Article",), ("Custom",)], "schema string, fields int, asked boolean", [("General", 8, True), ("TechnicalDoc", 10, True), ("ProductManual", 10, True), ("Article", 10, True), ("Custom", 2, True)])
def case_schema_prompts(rows):
    asked = lambda s: enrich.schema_prompt(s, F.lit("body"), F.lit("https://s.com"), custom=("sku",) if s == "Custom" else ())
    names = ("General", "TechnicalDoc", "ProductManual", "Article", "Custom")
    made = [rows.where(F.col("schema") == s).select("schema", asked(s).alias("p")) for s in names]
    every = made[0]
    for one in made[1:]:
        every = every.union(one)
    return every.select("schema", F.size(F.regexp_extract_all("p", F.lit(r"(?m)^- "), F.lit(0))).alias("fields"), F.contains("p", F.lit("https://s.com")).alias("asked"))


@case("id int, json string", [(1, '{"@context":"c","@type":"T","a":{"b":[{"c":1.50},{"c":true}]},"n":null,"s":"x"}'), (2, "[{\"k\":1}]"), (3, "bad"), (4, None)], "id int, path string, value string", [
    (1, "@type", "T"), (1, "a.b[0].c", "1.50"), (1, "a.b[1].c", "True"), (1, "s", "x"), (2, "[0].k", "1"),
])
def case_json_paths(rows):
    return rows.select("id", F.explode(metadata.flattened(F.col("json"))).alias("path", "value"))


@case(_PAGE_COLUMNS, _PAGES, "page_id int, description string, metas int, og string, card string, types string", [(1, "D > d", 12, "W", "summary", "Article|NewsArticle|Organization|Product"), (2, None, 0, None, None, ""), (3, None, 0, None, None, "")])
def case_snapshot(pages):
    made = metadata.snapshot(pages, "page_id")
    return made.select("page_id", F.try_element_at("metas", F.lit("description")).alias("description"), F.size("metas").alias("metas"), F.col("open_graph.title").alias("og"), F.col("twitter.card").alias("card"), joined(F.array_sort(F.map_keys("json_ld"))).alias("types"))


@case("id int, html string", [(1, "<p>a&nbsp;b</p>\n\n<p>c &amp; d</p>"), (2, "")], "id int, text string, ratio double", [(1, "a\u00a0b c & d", 0.818182), (2, "", 0.0)])
def case_page_text(rows):
    text = T.page_text(F.col("html"))
    return rows.select("id", text.alias("text"), F.round(quality.content_ratio(F.col("html"), text), 6).alias("ratio"))


@case("score double", [(0.8,), (0.79,), (0.6,), (0.4,), (0.2,), (0.19,)], "score double, grade string, percent string", [(0.8, "Excellent", "80%"), (0.79, "Good", "79%"), (0.6, "Good", "60%"), (0.4, "Fair", "40%"), (0.2, "Poor", "20%"), (0.19, "VeryPoor", "19%")])
def case_grades(rows):
    return rows.select("score", quality.grade(F.col("score")).alias("grade"), T.percent(F.col("score")).alias("percent"))


@case("id int, html string, headings int, described boolean", [
    (1, "<p>" + "word " * 120 + "</p>", 3, True), (2, "<div>please subscribe to read, sign in to go on</div>", 0, False), (3, "<ins class='adsense'></ins>" * 30 + "<p>word</p>", 0, False),
], "id int, overall double, grade string, kind string, words long, paywall boolean, login boolean, ads double, llm double, main boolean", [
    (1, 0.9, "Excellent", "general", 120, False, False, 0.0, 0.8, True), (2, 0.2, "Poor", "general", 9, True, True, 0.0, 0.8, False), (3, 0.302923, "Poor", "general", 1, False, False, 1.0, 0.304385, False),
])
def case_quality(rows):
    html, text = F.col("html"), T.page_text(F.col("html"))
    q = quality.quality(html, text, F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("headings"), F.col("described"))
    return rows.select("id", F.round(q["overall_score"], 6).alias("overall"), quality.grade(F.round(q["overall_score"], 9)).alias("grade"), q["content_type"].alias("kind"), q["word_count"].alias("words"), q["has_paywall"].alias("paywall"),
                       q["requires_login"].alias("login"), q["ad_density"].alias("ads"), F.round(q["llm_suitability"], 6).alias("llm"), q["has_main_content"].alias("main"))


# Markdown and settings

_DOC = '---\ntitle: "My page"\ntags: x\n---\n# A b?\n\nText [l](http://u) and ![](i.png) ![alt](j.png).\n\n### C\n\n```py\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- [x] t\n- u\n\n> q\n\n[^1]: note\n'


@case("id int, md string", [(1, _DOC), (2, "")], "kind string, text string, target string, level int, items int, done int", [
    ("Heading", "A b?", None, 1, 0, 0), ("Link", "l", "http://u", 0, 0, 0), ("Image", "", "i.png", 0, 0, 0), ("Image", "alt", "j.png", 0, 0, 0), ("Heading", "C", None, 3, 0, 0), ("Code", "x = 1", "py", 0, 1, 0),
    ("Table", "| a | b |", None, 2, 1, 0), ("List", "- [x] t", None, 0, 2, 1), ("Quote", "q", None, 0, 0, 0), ("Footnote", "note", "1", 0, 0, 0),
])
def case_markdown_elements(rows):
    return rows.select(F.explode(structure.element_rows(F.col("md"))).alias("e")).select("e.*")


@case("id int, md string", [(1, _DOC), (2, "plain words only"), (3, "## B\n\n![](x y)\n")], "id int, accuracy double, structural double, content double, accessibility double, seo double, complexity double, issues int", [
    (1, 0.92, 1.0, 0.75, 0.5, 0.8, 0.095, 2), (2, 0.7, 0.7, 0.8, 1.0, 0.5, 0.0, 3), (3, 0.84, 1.0, 0.7, 0.0, 0.5, 0.015, 4),
])
def case_markdown_quality(rows):
    e = F.col("e")
    made = rows.withColumn("e", structure.element_rows(F.col("md"))).withColumn("w", structure.text_statistics(F.col("md"))["words"])
    title = F.try_element_at(F.coalesce(structure.front_matter(F.col("md")), F.create_map(F.lit(""), F.lit(""))), F.lit("title"))
    q = structure.quality(e, F.col("w"), F.lit(0.5), title, F.lit(None).cast("string"))
    return made.select("id", F.round(structure.accuracy(e), 6).alias("accuracy"), *[F.round(q[n], 6).alias(n) for n in ("structural", "content", "accessibility", "seo")], F.round(structure.complexity(e), 6).alias("complexity"), F.size(q["issues"]).alias("issues"))


@case("id int, md string", [(1, _DOC), (2, "# x\n"), (3, "none")], "id int, keys string, toc string", [(1, "tags=x|title=My page", "- [A b?](#a-b)\n    - [C](#c)"), (2, "", "- [x](#x)"), (3, "", "")])
def case_front_matter_toc(rows):
    matter = F.coalesce(structure.front_matter(F.col("md")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    pairs = F.array_sort(F.transform(F.map_entries(matter), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("id", joined(pairs).alias("keys"), structure.toc(F.col("md")).alias("toc"))


@case("id int, md string", [(1, "# T\n\npara **x** [a](b) `c<`\n\n- a\n- b\n\n> q\n\n```py\nif a < b:\n```"), (2, "| a |\n|---|\n| 1 |"), (3, None)], "id int, html string", [
    (1, '<h1>T</h1>\n<p>para <strong>x</strong> <a href="b">a</a> <code>c&lt;</code></p>\n<ul><li>a</li><li>b</li></ul>\n<blockquote><p>q</p></blockquote>\n<pre><code class="language-py">if a &lt; b:\n</code></pre>'),
    (2, "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"), (3, None),
])
def case_markdown_to_html(rows):
    return rows.select("id", structure.to_html(F.col("md")).alias("html"))


_YAML = [
    ("_config.yml", "title: My site # named\nurl: 'https://s.com'\nauthor:\n  name: N\n  email: n@s.com\nplugins:\n  - jekyll-feed\n  - jekyll-paginate\nsass:\n  style: compressed\ncollections:\n  docs:\n    output: true\nshow_drafts: true\nenvironment: production\n"),
    ("hugo.yml", "baseURL: https://h.com\ntitle: H\ndescription: D\nlanguageCode: en\ngoogle_analytics: G-1\nsitemap: true\ncompress_html: true\ncdn: https://c\ncache:\n  days: 1\ntwitter:\n  name: t\n"), ("x.yml", ""),
]


@case("name string, yaml string", _YAML, "name string, kind string, title string, url string, author string, email string, plugins string, collections string, drafts boolean", [
    ("_config.yml", "Jekyll", "My site", "https://s.com", "N", "n@s.com", "jekyll-feed|jekyll-paginate", "docs", True), ("hugo.yml", "Hugo", "H", "https://h.com", None, None, "", "", False), ("x.yml", "Generic", None, None, None, None, "", "", False),
])
def case_site_config(rows):
    c = structure.site_config(F.col("name"), F.col("yaml"), F.col("p"))
    made = rows.withColumn("p", structure.yaml_paths(F.col("yaml")))
    return made.select("name", c["kind"].alias("kind"), c["title"].alias("title"), c["url"].alias("url"), c["author"].alias("author"), c["author_email"].alias("email"), joined(c["plugins"]).alias("plugins"), joined(c["collections"]).alias("collections"), c["show_drafts"].alias("drafts"))


@case("name string, yaml string", _YAML, "name string, issues string, total long, critical long, warning long", [
    ("_config.yml", "Info compress_html|Info google_analytics|Warning description|Warning plugins: jekyll-paginate|Warning show_drafts|Warning sitemap", 6, 0, 4), ("hugo.yml", "Info sass.style", 1, 0, 0),
    ("x.yml", "Error title|Info compress_html|Info google_analytics|Info sass.style|Warning description|Warning sitemap", 6, 0, 2),
])
def case_site_issues(rows):
    c = structure.site_config(F.col("name"), F.col("yaml"), F.col("p"))
    found = rows.withColumn("p", structure.yaml_paths(F.col("yaml"))).select("name", F.explode(structure.site_issues(c)).alias("i")).select("name", "i.*")
    listed = found.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "severity", "key"))), "|").alias("issues"))
    counts = None
    for name, _ in _YAML:  # one row of counts for each of the three files
        one = stats.issue_counts(found.where(F.col("name") == name)).withColumn("name", F.lit(name))
        counts = one if counts is None else counts.union(one)
    return listed.join(counts, "name")


@case("name string, yaml string", _YAML, "name string, completeness double, security double, performance double, seo double, practice double, overall double, hugo string", [
    ("_config.yml", 0.5, 0.8, 0.25, 0.166667, 0.9, 0.523333, 'title: "My site"\nbaseURL: "https://s.com"'), ("hugo.yml", 0.7, 1.0, 0.75, 1.0, 1.0, 0.89, 'title: "H"\ndescription: "D"\nbaseURL: "https://h.com"\nlanguageCode: "en"'),
    ("x.yml", 0.0, 1.0, 0.0, 0.0, 1.0, 0.4, ""),
])
def case_site_quality(rows):
    c = structure.site_config(F.col("name"), F.col("yaml"), F.col("p"))
    q = structure.site_quality(c)
    made = rows.withColumn("p", structure.yaml_paths(F.col("yaml")))
    return made.select("name", *[F.round(v, 6).alias(k) for k, v in q.items()], structure.converted(c, "Hugo").alias("hugo"))


# Strategy, enrichment, statistics


@case("id int, text string, headings int", [(1, "Aa bb. Aa cc. Dd!", 0), (2, "", 0), (3, "x" * 1000, 5), (4, "one two", 1)], "id int, density double, structure double, cohesion double, readability double", [
    (1, 0.764706, 0.5, 0.166667, 0.965667), (2, 0.0, 0.0, 1.0, 0.0), (3, 1.0, 0.5, 1.0, 0.0), (4, 0.857143, 1.0, 1.0, 0.96),
])
def case_content_metrics(rows):
    made = rows.withColumn("m", strategy.content_metrics(F.col("text"), F.col("headings")))
    names = {"text_density": "density", "structural_consistency": "structure", "semantic_cohesion": "cohesion", "readability": "readability"}
    return made.select("id", *[F.round(f"m.{c}", 6).alias(n) for c, n in names.items()])


@case("title string, description string, reply string", [("t", None, 'Sure: ```{"title":"X","description":"Y","topics":["a","b"]}```'), ("t", "d", "no json"), (None, None, '{"title":"Z"}'), (None, " ", "none")],
      "title string, description string, topics string, source string", [("t", "Y", "a|b", "Merged"), ("t", "d", None, "Html"), ("Z", None, None, "Ai"), (None, None, None, "None")])
def case_enrich(docs):
    made = enrich.merged(enrich.with_metadata(docs.withColumn("text", F.lit("body")), lambda prompt: F.col("reply")))
    return made.select("title", "description", joined("ai.topics").alias("topics"), F.col("metadata_source").alias("source"))


@case("id int, text string, reply string", [(1, "x" * 100, "y" * 30), (2, "x" * 100, "y" * 8), (3, "x" * 100, " "), (4, "x" * 100, "y" * 55)], "id int, size int, ratio double, quality double", [(1, 30, 0.3, 0.9), (2, 8, 0.08, 0.5), (3, 100, 1.0, 0.5), (4, 55, 0.55, 0.7)])
def case_reconstruct(docs):
    made = enrich.reconstruct(docs, "Summarize", lambda prompt: F.col("reply"))
    return made.select("id", F.length("result").alias("size"), F.round("ratio", 6).alias("ratio"), F.col("result_quality").alias("quality"))


@case("id int, title string, lang string", [(1, "a", None), (2, "", "en"), (3, " ", ""), (4, None, "de")], "id int, title string, title_from string, lang string, lang_from string", [
    (1, "a", "first", "fr", "second"), (2, "T2", "second", "en", "first"), (3, "T3", "second", "fr", "second"), (4, None, None, "de", "first"),
])
def case_fill_blanks(rows):
    other = rows.where("id < 4").select("id", F.concat(F.lit("T"), "id").alias("title"), F.lit("fr").alias("lang"))
    return stats.filled(rows, other, "id", ["title", "lang"])


@case("dom string, id int, at long, took long", [("d", 0, 0, 500), ("d", 1, 100, 0), ("d", 2, 5000, 100), ("e", 3, 50, 0)], "id int, start_ms long, end_ms long", [(0, 0, 500), (1, 1500, 1500), (2, 5000, 5100), (3, 50, 50)])
def case_rate_limit(rows):
    return stats.rate_limit_replay(rows, "dom", "id", "at", "took")


@case("job string, at int, ok boolean, ms long, total int", [("a", 1, True, 100, 4), ("a", 2, False, 0, 4), ("a", 3, True, 300, 4), ("b", 1, True, 50, 1)], "job string, at int, done long, failed long, success_rate double, left_ms double", [
    ("a", 1, 1, 0, 1.0, 300.0), ("a", 2, 2, 1, 0.5, 200.0), ("a", 3, 3, 1, 0.666667, 200.0), ("b", 1, 1, 0, 1.0, 0.0),
])
def case_progress(rows):
    return stats.progress(rows, "job", "at", "ok", "ms", "total").withColumn("success_rate", F.round("success_rate", 6))


@case("doc int, category string, score double", [(1, "size", 0.2), (1, "type", 0.3), (1, "size", 0.15), (2, "type", 1.0)], "doc int, total double, summary string", [(1, 0.65, "Total: 0.65 (size: 0.35, type: 0.30)"), (2, 1.0, "Total: 1.00 (type: 1.00)")])
def case_score_summary(rows):
    return stats.score_summary(rows, "doc").withColumn("total", F.round("total", 6))


@case("id int, severity string", [(1, "Error"), (2, "Warning"), (3, "Warning"), (4, "Critical")], "total long, critical long, error long, warning long, info long", [(4, 1, 1, 2, 0)])
def case_issue_counts(rows):
    return stats.issue_counts(rows)


@case("status int", [(200,), (404,), (200,), (500,)], "status_200 long, status_404 long, status_500 long, others int", [(2, 1, 1, 3)])
def case_histogram(rows):
    made = stats.as_map(stats.count_by(rows, "status"), "status")
    return made.select(*[F.try_element_at("map", F.lit(k)).alias(f"status_{k}") for k in (200, 404, 500)], F.size("map").alias("others"))
