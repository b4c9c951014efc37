"""Registered queries over what Spark makes of the given tables: annotated pages, sitemaps, robots files, Markdown, model replies.

The tables hold no metadata, settings or replies.  Each query gives every row of a table such a form, made of the row's own
columns, and applies an operator to it; the SQL says what must come out by the rule, from the columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import options, quality
from pagemill.functions import text as T
from pagemill.functions import urls as U
from pagemill.operators import chunking, crawl, enrich, extract, metadata, models, stats, strategy, structure, structured
from pagemill.queries import _ABS, _DECODE, _FIXED_PIECES, _HOST, _PARAGRAPH_PIECES, _SMART_PIECES, _auto_sql, _documents_as_pages, _page_text, _quality_sql, table
from pagemill.source_queries import ORACLE_SQL, QUERIES, query  # noqa: F401  those of the sources, to which these are added
from pagemill.sources import pages as pages_source
from pagemill.sources.cache import ContentCache
from pagemill.sources.shared import shared_dir


def joined(items, by: str = "|"):
    return F.array_join(items, by, "-")


# Annotated pages

_HEAD = (
    '<html lang="%1$s"><head><title>Page %2$s</title><meta name="description" content="About %2$s"><meta name="keywords" content="k%2$s, all , "><meta name="author" content="A%2$s">'
    '<meta property="og:title" content="Og %2$s"><meta property="og:image" content="/i%2$s.png">%3$s<meta name="DC.creator" content="C%2$s">'
    '<meta property="article:published_time" content="2024-01-%4$sT10:00:00Z"><meta property="article:section" content="S%2$s">'
    '<link rel="canonical" href="%5$s"><link rel="next" href="/p%2$s"><link type="application/rss+xml" href="/feed%2$s">%6$s</head>'
)
_BODY = (
    '<body><header><a href="/h">H</a></header><nav class="breadcrumb"><a href="/">Home</a><a href="/s%7$s">S%7$s</a></nav><aside><a href="/a%2$s">x</a></aside>'
    '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">Page <i>%2$s</i></b><div itemprop="offers" itemscope itemtype="http://schema.org/Offer/">'
    '<span itemprop="price">%7$s.50</span><meta itemprop="currency" content="EUR"></div><a itemprop="url" href="/u%2$s">x</a><em itemprop="tag"> a </em><em itemprop="tag">b%2$s</em></div>'
    '<p>%8$s</p><footer><a href="/sitemap.xml">map</a></footer></body></html>'
)


def annotated(pages: DataFrame) -> DataFrame:
    """Each page's text under a head with metadata and in a body with microdata; JSON-LD on those of even numbers."""
    n = F.col("page_id").cast("string")
    author = F.struct(F.lit("Person").alias("@type"), F.concat(F.lit("W"), n).alias("name"))
    day = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    rating = F.struct((F.col("page_id") % 7).alias("value"), F.lit(True).alias("best"))
    fields = {
        "headline": F.concat(F.lit("H"), n), "author": author, "publisher": F.struct(F.lit("P").alias("name")), "datePublished": F.concat(F.lit("2024-01-"), day),
        "keywords": F.array(F.lit("a"), F.concat(F.lit("k"), n)), "rating": rating,
    }
    script = F.when(F.col("page_id") % 2 == 0, structured.as_json_ld(fields, "NewsArticle")).otherwise("")
    card = F.when(F.col("page_id") % 3 != 0, '<meta name="twitter:card" content="summary">').otherwise("")
    language = F.element_at(F.array(F.lit("en"), F.lit("fr-CA"), F.lit("de")), (F.col("page_id") % 3 + 1).cast("int"))
    body = F.replace(F.replace(T.strip_tags(F.coalesce("html", F.lit(""))), F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" "))
    made = F.format_string(_HEAD + _BODY, language, n, card, day, F.col("url"), script, (F.col("page_id") % 5).cast("string"), body)
    return pages.select("page_id", "url", made.alias("html"))


_DAY = "lpad((page_id % 28 + 1)::VARCHAR, 2, '0')"


@query(
    f"""SELECT page_id, 'Page ' || page_id AS title, 'About ' || page_id AS description, 'k' || page_id || '|all' AS keywords, 'Og ' || page_id AS og_title, CASE WHEN page_id % 3 <> 0 THEN 'summary' END AS card,
    '2024-01-' || {_DAY} || ' 10:00:00' AS published, CASE WHEN page_id % 2 = 0 THEN 'NewsArticle' ELSE 'Product' END AS schema_type, CASE WHEN page_id % 2 = 0 THEN 15 ELSE 8 END AS fields,
    CASE WHEN page_id % 2 = 0 THEN 'W' || page_id END AS author_name, CASE WHEN page_id % 2 = 0 THEN 'True' END AS best, (page_id % 5) || '.50' AS price, 'EUR' AS currency, 'Offer' AS offer, '/u' || page_id AS item_url,
    'a|b' || page_id AS tags, CASE page_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS language, 'html' AS method, '/feed' || page_id AS feed, {_HOST} AS domain FROM pages"""
)
def document_metadata(spark, sf_dir):
    """The second extractor over annotated pages: one struct of search fields, cards, times, JSON-LD and microdata."""
    made = structured.document_metadata(annotated(table(spark, sf_dir, "pages"))).select("page_id", "document.*")
    field = lambda path: F.try_element_at("structured", F.lit(path))
    return made.select(
        "page_id", "title", "description", joined("keywords").alias("keywords"), F.col("open_graph.title").alias("og_title"), F.col("twitter.card").alias("card"),
        F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "schema_type", F.size("structured").alias("fields"), field("author.name").alias("author_name"), field("rating.best").alias("best"),
        field("offers.price").alias("price"), field("offers.currency").alias("currency"), field("offers.@type").alias("offer"), field("url").alias("item_url"), F.concat_ws("|", field("tag[0]"), field("tag[1]")).alias("tags"),
        F.col("language.language").alias("language"), F.col("language.method").alias("method"), "feed", "domain",
    )


@query(
    f"""SELECT page_id, 0 AS place, 'NewsArticle' AS type, 'article' AS kind, 'H' || page_id AS headline, 'W' || page_id AS author, 'P' AS publisher, '2024-01-' || {_DAY} AS published, 'a|k' || page_id AS keywords
    FROM pages WHERE page_id % 2 = 0"""
)
def json_ld_entities(spark, sf_dir):
    made = metadata.json_ld(annotated(table(spark, sf_dir, "pages")), "page_id")
    return made.select("page_id", F.col("place").cast("int").alias("place"), "type", "kind", "article.headline", "article.author", "article.publisher", F.date_format("article.published", "yyyy-MM-dd").alias("published"), joined("article.keywords").alias("keywords"))


@query(
    f"""SELECT page_id, 'Page ' || page_id AS title, url AS canonical, '2024-01-' || {_DAY} || ' 10:00:00' AS published, CASE page_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr-CA' ELSE 'de' END AS language, 'C' || page_id AS creator,
    'Home=/|S' || (page_id % 5) || '=/s' || (page_id % 5) AS crumbs, '/p' || page_id AS next_page, '/h' AS header, '/|/s' || (page_id % 5) AS nav, '/a' || page_id AS aside, '/sitemap.xml' AS footer, '/sitemap.xml' AS sitemap,
    'Webpage' AS kind, 'S' || page_id AS categories, 8 + (page_id % 3 <> 0)::INT AS metas, CASE WHEN page_id % 2 = 0 THEN 'NewsArticle' ELSE '' END AS ld_types FROM pages"""
)
def page_context(spark, sf_dir):
    """Basic fields, Dublin Core, breadcrumbs, regions' links, class of page and the snapshot of annotated pages."""
    pages = annotated(table(spark, sf_dir, "pages"))
    html, metas, links = F.col("html"), F.col("metas"), F.col("links")
    made = pages.withColumns({"metas": metadata.meta_tags(html), "links": metadata.link_tags(html)})
    b, d, s, n, c = metadata.basic(html, metas, links), metadata.dublin_core(metas), metadata.site_context(html, F.col("url"), links), metadata.navigation(html, links), metadata.classification(html, metas)
    addresses = lambda c: joined(F.transform(c, lambda x: x["url"]))
    shot = metadata.snapshot(pages, "page_id").select("page_id", F.size("metas").alias("metas"), joined(F.array_sort(F.map_keys("json_ld"))).alias("ld_types"))
    crumbs = joined(F.transform(s["breadcrumbs"], lambda x: F.concat(x["text"], F.lit("="), x["url"])))
    each = made.select(  # fields taken from the structs here, so that no other is made
        "page_id", b["title"].alias("title"), b["canonical"].alias("canonical"), F.date_format(b["published"], "yyyy-MM-dd HH:mm:ss").alias("published"), b["language"].alias("language"), d["creator"].alias("creator"),
        crumbs.alias("crumbs"), s["next"].alias("next_page"), *[addresses(n[k]).alias(k) for k in ("header", "nav", "aside", "footer")], n["sitemap"].alias("sitemap"), c["kind"].alias("kind"), joined(c["categories"]).alias("categories"),
    )
    return each.join(shot, "page_id")


@query(
    """SELECT event_id, unnest(['type', 'user.id', 'user.v[0].k', 'user.v[1].k', 'ok']) AS path,
    unnest([event_type, user_id::VARCHAR, json_extract_string(props, '$.k'), event_id::VARCHAR, CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END]) AS value FROM events"""
)
def json_paths(spark, sf_dir):
    """Nested records made of the events, flattened by levels; fields with an at sign, nulls and bare elements stay away."""
    made = F.format_string('{"@id":"x","type":"%s","user":{"id":%d,"v":[%s,{"k":%d}],"tags":["a",1]},"ok":%s,"none":null}', "event_type", "user_id", "props", "event_id", (F.col("event_id") % 2 == 0).cast("string"))
    return structured.flattened_rows(table(spark, sf_dir, "events").select("event_id", made.alias("json")), "event_id", F.col("json"))


# Articles

_ARTICLE = (
    '<html><head><title>T %1$s</title></head><body><nav><a href="/x">Home</a></nav><header>top</header><article><h1>Head %1$s</h1><p>Words <b>bold %1$s</b> %2$s.</p>'
    '<div class="links"><a href="/a">One</a> <a href="/b">Two</a></div><ul><li>first item of the list %1$s</li><li>second item <i>of</i> the list</li></ul>'
    "<table><tr><th>alpha column</th><th>beta column</th></tr><tr><td>%1$s</td><td>2</td></tr></table><pre>x = %1$s</pre>"
    '<h2>More %1$s</h2><p>Last paragraph with a <a href="/l/%1$s">link</a> inside and enough words to stay.</p></article><footer>foot</footer></body></html>'
)


def articles(pages: DataFrame) -> DataFrame:
    """Each page's letters as the first paragraph of an article with all kinds of blocks, between layout and links."""
    letters = F.trim(F.regexp_replace(T.strip_tags(F.coalesce("html", F.lit(""))), r"[^\p{L}]+", " "))
    return pages.select("page_id", "url", F.format_string(_ARTICLE, F.col("page_id").cast("string"), letters).alias("html"))


_LETTERS = "trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'), '[^\\p{L}]+', ' ', 'g'))"
_ROOT = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+')"
_LINKS_BLOCK = "'[One](' || root || '/a) [Two](' || root || E'/b)\\n\\n'"
_MARKDOWN = f"""SELECT page_id, url, '# Head ' || page_id || E'\\n\\nWords **bold ' || page_id || '** ' || letters || E'.\\n\\n' AS before, {_LINKS_BLOCK} AS links,
    '- first item of the list ' || page_id || E'\\n- second item *of* the list\\n\\n| alpha column | beta column |\\n| --- | --- |\\n| ' || page_id || E' | 2 |\\n\\n```\\nx = ' || page_id || E'\\n```\\n\\n## More ' || page_id
    || E'\\n\\nLast paragraph with a [link](' || root || '/l/' || page_id || ') inside and enough words to stay.' AS rest FROM (SELECT page_id, url, {_LETTERS} AS letters, {_ROOT} AS root FROM pages)"""


@query(
    f"""WITH m AS ({_MARKDOWN}) SELECT page_id, 'Head ' || page_id AS title, before || links || rest AS raw_markdown, before || rest AS text, '# Head ' || page_id || '|## More ' || page_id AS headings,
    length(before || rest)::BIGINT AS char_count FROM m"""
)
def extract_articles(spark, sf_dir):
    """Title, Markdown before and after the density filter and headings of articles: layout goes, then the block of links."""
    made = extract.extract_pages(articles(table(spark, sf_dir, "pages")))
    return made.select("page_id", "title", "raw_markdown", "text", joined("headings").alias("headings"), "char_count")


@query(
    """SELECT page_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS place, unnest(['nav', 'header', 'article', 'div', 'ul', 'table', 'footer']) AS tag, unnest([true, false, false, true, false, false, false]) AS dropped,
    unnest([-1.0, 0.3, NULL, -1.0, NULL, NULL, 0.3])::DOUBLE AS score FROM pages"""
)
def density_articles(spark, sf_dir):
    """The containers of articles by the density rule: blocks of links fall below zero, layout with words counts little."""
    made = extract.density_scores(articles(table(spark, sf_dir, "pages")), "page_id")
    shown = F.when(F.col("tag").isin("nav", "header", "div", "footer"), F.round("score", 9))
    return made.select("page_id", "place", "tag", (F.col("score") < 0).alias("dropped"), shown.alias("score"))


@query(
    f"""WITH t AS (SELECT page_id, url, {_LETTERS} AS letters FROM pages)
    SELECT page_id, unnest(range(11))::BIGINT AS sequence_number, unnest(['Text', 'Text', 'Text', 'Text', 'Text', 'List', 'Table', 'Code', 'Text', 'Text', 'Text']) AS chunk_type,
    unnest(['Words', 'bold ' || page_id, trim(letters || '.'), 'One', 'Two', '• first item of the list ' || page_id || E'\\n• second item of the list', E'alpha column | beta column\\n' || page_id || ' | 2', 'x = ' || page_id,
      'Last paragraph with a', 'link', 'inside and enough words to stay.']) AS content,
    'Head ' || page_id || unnest(['', '', '', '', '', '', '', '', '|More ' || page_id, '|More ' || page_id, '|More ' || page_id]) AS path FROM t"""
)
def chunk_articles(spark, sf_dir):
    """Articles cut along their structure, each chunk with the headings above it."""
    pages = articles(table(spark, sf_dir, "pages")).withColumn("url", F.col("page_id").cast("string"))
    made = chunking.chunk(pages, "DomStructure")
    return made.select(F.col("source_url").cast("long").alias("page_id"), "sequence_number", "chunk_type", "content", joined("heading_path").alias("path"))


# Sites


@query(f"SELECT DISTINCT {_HOST} AS host, url AS loc, substr(md5({_HOST}), 1, 1) < '8' AS formed FROM pages")
def sitemap_pages(spark, sf_dir):
    """Sitemaps of all hosts, 1,000 addresses or so each, read back: by XML, and by pattern those that are cut off before their end."""
    pages = table(spark, sf_dir, "pages").select(U.domain_key(F.col("url")).alias("host"), "url").distinct()
    formed = F.substring(F.md5("host"), 1, 1) < "8"
    entry = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.when(formed, "&amp;").otherwise("&")), F.lit("</loc></url>"))
    parts = pages.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(64))).groupBy("host", "part", formed.alias("formed")).agg(F.concat_ws("", F.sort_array(F.collect_list(entry))).alias("urls"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "urls", F.when(F.col("formed"), "</urlset>").otherwise(""))
    return parts.select("host", F.explode(U.sitemap_locs(xml)).alias("loc"), "formed")


@query(
    f"""WITH p AS (SELECT page_id, {_HOST} AS host, regexp_extract(url, {_ABS}, 4) AS path FROM pages)
    SELECT page_id, NOT starts_with(path, '/fr') OR starts_with(path, '/fr/8') AS allowed, length(host) % 9 + 1 AS delay, host || '/map.xml' AS sitemap FROM p"""
)
def robots_sites(spark, sf_dir):
    """A robots file for every host, and each page of the table by its rules: whether it may be fetched, and how long to wait."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.host(F.col("url")).alias("host"))
    delay = (F.length("host") % 9 + 1).cast("string")
    body = F.concat(F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /fr\nAllow: /fr/8 # open\nCrawl-delay: "), delay, F.lit("\nDisallow:\nSitemap: "), "host", F.lit("/map.xml\n"))
    rules = crawl.robots_rules(pages.select("host").distinct().withColumn("body", body))
    may = crawl.allowed(pages.select("page_id", "url"), rules, "url").select("page_id", F.lit(True).alias("allowed"))
    waits = crawl.crawl_delay(rules).select("host", F.col("seconds").cast("int").alias("delay"))
    maps = rules.where("kind = 'sitemap'").select("host", F.col("path").alias("sitemap"))
    return pages.join(may, "page_id", "left").join(waits, "host", "left").join(maps, "host", "left").select("page_id", F.coalesce("allowed", F.lit(False)).alias("allowed"), "delay", "sitemap")


# Markdown


def as_markdown(docs: DataFrame) -> DataFrame:
    """Each document's letters as a paragraph among all kinds of elements."""
    n, letters = F.col("doc_id").cast("string"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " "))
    made = F.format_string(
        '---\ntitle: "D %1$s"\ntags: x\n---\n# Head %1$s!\n\n%2$s [l](http://u/%1$s) and ![](i.png) ![alt](j%1$s.png).\n\n### Part\n\n```py\nx = %1$s\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- [x] t\n- u\n\n> q\n\n[^1]: note %1$s\n',
        n, F.concat(F.lit("Words "), letters),
    )
    return docs.select("doc_id", made.alias("md"))


@query(
    """SELECT doc_id, 'tags=x|title=D ' || doc_id AS matter, '- [Head ' || doc_id || '!](#head-' || doc_id || E')\\n    - [Part](#part)' AS toc, '# Head ' || doc_id || '!|### Part' AS headings, 'i.png|j' || doc_id || '.png' AS images,
    unnest(['Heading', 'Link', 'Image', 'Image', 'Heading', 'Code', 'Table', 'List', 'Quote', 'Footnote']) AS kind,
    unnest(['Head ' || doc_id || '!', 'l', '', 'alt', 'Part', 'x = ' || doc_id, '| a | b |', '- [x] t', 'q', 'note ' || doc_id]) AS text,
    unnest([NULL, 'http://u/' || doc_id, 'i.png', 'j' || doc_id || '.png', NULL, 'py', NULL, NULL, NULL, '1']) AS target,
    unnest([1, 0, 0, 0, 3, 0, 2, 0, 0, 0]) AS level, unnest([0, 0, 0, 0, 0, 1, 1, 2, 0, 0]) AS items FROM documents"""
)
def markdown_elements(spark, sf_dir):
    """Front matter, contents, headings, images and every element of Markdown made of the documents."""
    docs = as_markdown(table(spark, sf_dir, "documents"))
    md = F.col("md")
    pairs = joined(F.array_sort(F.transform(F.map_entries(structure.front_matter(md)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))))
    made = docs.select("doc_id", pairs.alias("matter"), structure.toc(md).alias("toc"), joined(T.markdown_headings(md)).alias("headings"), joined(T.markdown_images(md)).alias("images"), structure.element_rows(md).alias("es"))
    each = made.select("doc_id", "matter", "toc", "headings", "images", F.explode("es").alias("e"))  # beside an explode the others would be made anew for each element
    return each.select("doc_id", "matter", "toc", "headings", "images", "e.kind", "e.text", "e.target", "e.level", "e.items")


@query(
    """WITH n AS (SELECT doc_id, doc_id::VARCHAR AS n FROM documents)
    SELECT doc_id, unnest(['Link', 'Link', 'Link', 'Image', 'Link', 'Link', 'Link']) AS kind, unnest(['named ' || n, 'Ref', 'https://auto.example/' || n, 'pic', 'top', 'write', 'video']) AS text,
    unnest(['https://ref.example/' || n, 'https://ref.example/' || n, 'https://auto.example/' || n, '/pics/' || n || '.png', '#top', 'mailto:a@b.c', 'https://youtu.be/' || n]) AS target,
    unnest(['AutoLink', 'AutoLink', 'AutoLink', 'Inline', 'Internal', 'Email', 'AutoLink']) AS link_kind, 'YouTube=https://youtu.be/' || n AS embeds, 'give the document a title|add a description' AS advice, 'clear headings' AS strengths FROM n"""
)
def markdown_links(spark, sf_dir):
    """Links by name, between brackets, to places and by mail, embeds, and what the quality rule advises."""
    n = F.col("doc_id").cast("string")
    md = F.format_string(
        "# Head\n\n%2$s [named %1$s][ref], [Ref][], [not defined][x] `[code](c)` <https://auto.example/%1$s>\n\n![pic][pics] and [top](#top) [write](mailto:a@b.c) [video](https://youtu.be/%1$s)\n\n[ref]: https://ref.example/%1$s 'R'\n[PICS]: </pics/%1$s.png>\n",
        n, F.repeat(F.lit("word "), 120),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", structure.element_rows(md).alias("e"))
    none = F.lit(None).cast("string")
    q = structure.quality(F.col("e"), F.lit(120), F.lit(0.5), none, none)
    embedded = joined(F.transform(structure.embeds(F.col("e")), lambda x: F.concat(x["kind"], F.lit("="), x["url"])))
    made = docs.select("doc_id", "e", embedded.alias("embeds"), joined(q["recommendations"]).alias("advice"), joined(q["strengths"]).alias("strengths"))
    each = made.select("doc_id", "embeds", "advice", "strengths", F.explode("e").alias("x")).where("x.kind in ('Link', 'Image')")
    return each.select("doc_id", "x.kind", "x.text", "x.target", structure.link_kind(F.col("x.target")).alias("link_kind"), "embeds", "advice", "strengths")


# Settings


def _sites(spark, sf_dir):
    """Settings of every host as paths, and their sections."""
    n = F.length("host")
    paths = F.map_filter(
        F.create_map(
            F.lit("title"), F.col("host"), F.lit("description"), F.when(n % 2 == 0, F.concat(F.lit("about "), "host")), F.lit("url"), F.concat(F.lit("https://"), "host"), F.lit("environment"), F.lit("production"),
            F.lit("show_drafts"), F.when(n % 3 == 0, "true").otherwise("false"), F.lit("compress_html"), F.when(n % 5 == 0, "yes").otherwise("no"), F.lit("sass.style"), F.lit("nested"),
            F.lit("plugins[0]"), F.lit("jekyll-feed"), F.lit("plugins[1]"), F.lit("redcarpet"),
        ),
        lambda _, v: v.isNotNull(),
    )
    sites = table(spark, sf_dir, "pages").select(U.domain_key(F.col("url")).alias("host")).distinct().withColumn("p", paths)
    return sites, structure.site_config(F.lit("_config.yml"), F.lit(""), F.col("p"))


@query(
    f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), s AS (SELECT host, length(host) AS n FROM h)
    SELECT host, 'Jekyll' AS kind, host AS title, CASE WHEN n % 2 = 0 THEN 'about ' || host END AS description, n % 3 = 0 AS drafts, 'jekyll-feed|redcarpet' AS plugins,
    concat_ws('|', CASE WHEN n % 2 <> 0 THEN 'Warning description' END, CASE WHEN n % 3 = 0 THEN 'Warning show_drafts' END, CASE WHEN n % 5 <> 0 THEN 'Info compress_html' END, 'Info sass.style', 'Info google_analytics', 'Warning sitemap', 'Warning plugins: redcarpet') AS issues,
    concat_ws('|', CASE WHEN n % 5 <> 0 THEN 'Performance Medium compress_html false true' END, 'Performance Medium sass.style nested compressed', CASE WHEN n % 3 = 0 THEN 'Security High show_drafts true false' END,
      'Seo Medium google_analytics GA_TRACKING_ID', 'Seo High sitemap false true', 'BestPractice Medium plugins redcarpet kramdown') AS advice,
    round((2 + CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END + 1 + 1) / 10.0, 6)::DOUBLE AS completeness, CASE WHEN n % 3 = 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS security, CASE WHEN n % 5 = 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS performance,
    round(CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END / 6.0, 6)::DOUBLE AS seo, 0.9::DOUBLE AS practice, 'title: "' || host || '"' || CASE WHEN n % 2 = 0 THEN E'\\ndescription: "about ' || host || '"' ELSE '' END || E'\\nbaseURL: "https://' || host || '"' AS hugo, true AS to_hugo FROM s"""
)
def site_settings(spark, sf_dir):
    """Settings of every host of the pages: sections, faults, advice, ratings, and the form for another generator."""
    sites, c = _sites(spark, sf_dir)
    q = structure.site_quality(c)
    listed = lambda rows, *names: joined(F.transform(rows, lambda r: F.concat_ws(" ", *[r[k] for k in names])))
    return sites.select(
        "host", c["kind"].alias("kind"), c["title"].alias("title"), c["description"].alias("description"), c["show_drafts"].alias("drafts"), joined(c["plugins"]).alias("plugins"),
        listed(structure.site_issues(c), "severity", "key").alias("issues"), listed(structure.site_recommendations(c), "type", "priority", "setting", "current", "recommended").alias("advice"),
        *[F.round(q[k], 6).alias(k) for k in ("completeness", "security", "performance", "seo", "practice")], structure.converted(c, "Hugo").alias("hugo"), structure.can_migrate(c["kind"], "Hugo").alias("to_hugo"),
    )


@query(
    f"""WITH s AS (SELECT DISTINCT {_HOST} AS host FROM pages), n AS (SELECT length(host) AS n FROM s),
    c AS (SELECT sum((n % 2 <> 0)::INT + (n % 3 = 0)::INT + 2)::BIGINT AS warning, sum((n % 5 <> 0)::INT + 2)::BIGINT AS info FROM n)
    SELECT warning + info AS total, 0::BIGINT AS critical, 0::BIGINT AS error, warning, info FROM c"""
)
def site_issue_counts(spark, sf_dir):
    """The faults of all hosts' settings by severity."""
    sites, c = _sites(spark, sf_dir)
    return stats.issue_counts(sites.select(F.explode(structure.site_issues(c)).alias("i")).select("i.severity"))


_FAULT = "CASE WHEN {0} THEN '{1}' END"


@query(
    "SELECT event_id, concat_ws('; ', "
    + ", ".join(
        _FAULT.format(*x)
        for x in (
            ("event_id % 5 - 1 <= 0", "crawl: max_pages must be greater than 0"), ("event_id % 3 - 1 < 0", "crawl: max_depth must be at least 0"), ("value / 10 > 1", "crawl: min_confidence must be from 0 to 1"),
            ("event_id % 4 - 1 < 0", "extract: max_retries must be at least 0"), ("event_id % 7 <= 0", "extract: cache_minutes must be greater than 0"), ("event_id % 100 <= user_id % 100", "html_chunks: max_chunk_size must be greater than min_chunk_size"),
            ("value / 20 <= 0 OR value / 20 > 1", "reconstruct: summary_ratio must be above 0 to 1"), ("value / 5 < 1", "reconstruct: expansion_ratio must be at least 1"), ("event_id % 6 > 2", "reconstruct: temperature must be from 0 to 2"),
            ("event_id % 9 <= 0", "analysis: max_section_depth must be greater than 0"), ("event_id % 8 <= 0", "pipeline: total_timeout_ms must be greater than 0"),
        )
    )
    + ") AS faults FROM events"
)
def option_faults(spark, sf_dir):
    """Options made of the events' numbers, checked by class: every fault of a row at once."""
    e, v = F.col("event_id"), F.col("value")
    given = {
        "crawl": {"max_pages": e % 5 - 1, "max_depth": e % 3 - 1, "min_confidence": v / 10}, "extract": {"max_retries": e % 4 - 1, "cache_minutes": e % 7},
        "html_chunks": {"max_chunk_size": e % 100 + 1, "min_chunk_size": F.col("user_id") % 100 + 1}, "reconstruct": {"summary_ratio": v / 20, "expansion_ratio": v / 5, "temperature": e % 6},
        "analysis": {"max_section_depth": e % 9}, "pipeline": {"total_timeout_ms": e % 8},
    }
    return table(spark, sf_dir, "events").select("event_id", F.array_join(options.all_faults(given), "; ").alias("faults"))


# Titles and contents


@query(
    f"""WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages),
    d AS (SELECT page_id, trim({_DECODE.format('h')}, E' \\t\\n\\r') AS h, trim(t, E' \\t\\n\\r') AS t FROM t)
    SELECT page_id, CASE WHEN h <> '' THEN h WHEN t <> '' THEN {_DECODE.format('t')} ELSE 'Untitled' END AS best, CASE WHEN page_id % 2 = 0 AND h <> '' THEN h WHEN page_id % 3 = 0 THEN 'second' END AS title,
    CASE WHEN page_id % 2 = 0 AND h <> '' THEN 'first' WHEN page_id % 3 = 0 THEN 'second' END AS title_from, CASE WHEN page_id % 5 = 0 AND t <> '' THEN t WHEN h <> '' THEN h END AS content FROM d"""
)
def page_titles(spark, sf_dir):
    """The best title of a page; blank titles filled from a second source where it has one; the first content that isn't blank."""
    pages = table(spark, sf_dir, "pages").select("page_id", T.best_title(F.col("html")).alias("best"), T.trim_all(T.title_of(F.col("html"), "")).alias("own"), T.trim_all(T.decode_entities(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1))).alias("head"))
    first = pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("head")).otherwise(" ").alias("title"))
    second = pages.where("page_id % 3 = 0").select("page_id", F.lit("second").alias("title"))
    content = T.best_content(F.when(F.col("page_id") % 5 == 0, F.col("own")), F.lit(" "), F.col("head"), F.lit(None).cast("string"))
    return stats.filled(first, second, "page_id", ["title"]).select("page_id", "title", "title_from").join(pages.select("page_id", "best", content.alias("content")), "page_id")


@query("SELECT event_type AS kind, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def event_type_map(spark, sf_dir):
    """Counts as one map, taken apart again."""
    made = stats.as_map(stats.count_by(table(spark, sf_dir, "events"), "event_type"), "event_type")
    return made.select(F.explode("map").alias("kind", "n"))


# Chunks

_PARTS_OF = {"FixedSize": _FIXED_PIECES, "MemoryOptimized": _FIXED_PIECES, "Paragraph": _PARAGRAPH_PIECES, "Smart": _SMART_PIECES}
_CHOICE = f"SELECT doc_id, CASE WHEN best = 'Semantic' THEN 'Paragraph' ELSE best END AS strategy FROM ({_auto_sql('doc_id::VARCHAR')})"
_AUTO_PIECES = f"WITH choice AS ({_CHOICE}) SELECT doc_id, seq, content, title, strategy FROM (" + " UNION ALL ".join(f"SELECT p.doc_id, p.seq, p.content, p.title, '{name}' AS kind FROM ({sql}) p" for name, sql in _PARTS_OF.items()) + ") JOIN choice USING (doc_id) WHERE kind = strategy"
_BAG = "list_distinct(list_filter(string_split_regex(lower({0}), '[ \\t\\n\\r]+'), lambda x: x <> ''))"


@query(f"SELECT doc_id::VARCHAR AS source_url, strategy, seq::BIGINT AS sequence_number, content, title AS section_title, sha256(doc_id || '|' || strategy || '|' || seq) AS chunk_id FROM ({_AUTO_PIECES})")
def chunk_auto(spark, sf_dir):
    """Every document cut by the strategy that Auto chooses for it."""
    made = chunking.chunk(_documents_as_pages(table(spark, sf_dir, "documents")), "Auto")
    return made.select("source_url", "strategy", "sequence_number", "content", "section_title", "chunk_id")


@query(
    f"""WITH c AS ({_AUTO_PIECES}),
    a AS (SELECT *, {_BAG.format('content')} AS a, lead({_BAG.format('content')}) OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM c),
    j AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1) END AS alike FROM a),
    g AS (SELECT doc_id, count(*)::INT AS chunks, avg(length(content)) AS mean, stddev_pop(length(content)) AS sd, avg(alike) AS cohesion, (SELECT length(text) FROM documents d WHERE d.doc_id = j.doc_id) AS whole FROM j GROUP BY doc_id),
    r AS (SELECT *, CASE WHEN chunks < 2 THEN 1.0 ELSE greatest(0, 1 - sd / nullif(mean, 0)) END AS even, whole // chunks AS share FROM g)
    SELECT doc_id::VARCHAR AS source_url, chunks, round(even, 6)::DOUBLE AS size_consistency, round(coalesce(cohesion, 1), 6)::DOUBLE AS cohesion,
    round(0.3 * even + 0.4 * coalesce(cohesion, 1) + 0.2 * least(mean, share) / greatest(mean, share) + 0.08, 6)::DOUBLE AS quality, false AS first_cached, true AS again_cached FROM r"""
)
def auto_quality(spark, sf_dir):
    """Auto's rating of its own result for every document, and a second run that takes it from the store."""
    docs = _documents_as_pages(table(spark, sf_dir, "documents"))
    store = ContentCache(spark, shared_dir(spark, "auto"))
    run = lambda clock: chunking.auto_rated(docs, store=store, now=F.lit(f"2024-01-01 {clock}:00").cast("timestamp"))
    once = lambda rows: rows.where("sequence_number = 0").dropDuplicates(["source_url"])
    first = once(run("10:00"))
    again = once(run("10:30")).select("source_url", "rating", F.col("from_cache").alias("again_cached"))
    each = first.select("source_url", F.col("from_cache").alias("first_cached")).join(again, "source_url")
    return each.select("source_url", "rating.chunks", *[F.round(f"rating.{c}", 6).alias(c) for c in ("size_consistency", "cohesion", "quality")], "first_cached", "again_cached")


@query(f"SELECT doc_id, source, seq::INT AS sequence_number, content FROM ({_PARAGRAPH_PIECES}) JOIN documents USING (doc_id)")
def chunk_table(spark, sf_dir):
    """The table function over the whole document table, its options by name."""
    chunking.register_chunk_table(spark)
    table(spark, sf_dir, "documents").select("doc_id", "source", "text").createOrReplaceTempView("pagemill_chunk_documents")
    return spark.sql("SELECT doc_id, source, sequence_number, content FROM chunk_table(TABLE(pagemill_chunk_documents), text => 'text', strategy => 'Paragraph')")


@query(_auto_sql(headings="(doc_id % 9)", images="(doc_id % 5)"))
def auto_select_full(spark, sf_dir):
    """The choice of a strategy for documents with headings and images, by their numbers."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").withColumns({"__h": n % 9, "__i": n % 5})
    made = strategy.scored(docs, "text", "source", "__h", "__i").withColumn("b", strategy.best(F.col("scores")))
    return made.select("doc_id", "content_type", "technical", F.col("b.strategy").alias("best"), F.round("b.score", 6).alias("score"))


@query(_quality_sql("(page_id % 4)", "page_id % 2 = 0"))
def page_quality_full(spark, sf_dir):
    """Quality of pages with headings and metadata, by their numbers."""
    made, n = _page_text(table(spark, sf_dir, "pages")), F.col("page_id")
    q = quality.quality(F.col("html"), F.col("text"), F.col("title"), F.col("url"), n % 4, n % 2 == 0)
    scored = made.select("page_id", q["overall_score"].alias("o"), q["llm_suitability"].alias("l"))
    return scored.select("page_id", F.round("o", 6).alias("overall"), F.round("l", 6).alias("llm_suitability"), quality.grade(F.round("o", 9)).alias("grade"))


# Models


class CharacterCounts:
    """An embedder for tests: letters a, e, spaces and lines of a text."""

    dimension, max_tokens = 4, 2_000

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[t.count("a"), t.count("e"), t.count(" "), t.count("\n")] for t in texts]


@query(
    """WITH t AS (SELECT doc_id, text[1:8000] AS t FROM documents)
    SELECT doc_id, (length(t) - length(replace(t, 'a', '')))::DOUBLE AS a, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS e, (length(t) - length(replace(t, ' ', '')))::DOUBLE AS spaces, (length(t) - length(replace(t, chr(10), '')))::DOUBLE AS lines FROM t"""
)
def embed_batches(spark, sf_dir):
    """A vector of every document from a model that takes batches across rows, up to its token limit a text."""
    made = table(spark, sf_dir, "documents").select("doc_id", models.embedded(F.col("text"), "character-counts", CharacterCounts, rows=32, tokens=20_000).alias("v"))
    return made.select("doc_id", *[F.get("v", F.lit(k)).alias(c) for k, c in enumerate(("a", "e", "spaces", "lines"))])


class FirstWords:
    """A text model for tests: metadata with the text's first word as title, no JSON where that is short, an error for none."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.reply(p) for p in prompts]

    def reply(self, prompt: str) -> str:
        if prompt == "Hello":
            return "Hi"
        words = prompt.split("\n\n", 1)[1].split()
        if len(words[0]) < 3:
            return "no metadata in " + words[0]
        return 'Sure: {"title": "T-%d", "topics": ["a", "%d"]} end' % (len(words[0]), len(words[-1]))


@query(
    r"""WITH t AS (SELECT doc_id, CASE WHEN length(text) > 6000 THEN text[1:6000] || '...' ELSE text END AS t, doc_id % 3 AS k FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '[ \t\n\r\f\v\x1c-\x1f\x85\xa0]+'), lambda x: x <> '') AS w FROM t),
    r AS (SELECT *, CASE WHEN len(w) > 0 AND length(w[1]) >= 3 THEN 'T-' || length(w[1]) END AS ai FROM w)
    SELECT doc_id, CASE WHEN k = 0 THEN 'own' WHEN ai IS NOT NULL THEN ai END AS title, CASE WHEN len(w) > 0 AND length(w[1]) >= 3 THEN 'a|' || length(w[len(w)]) END AS topics, CASE WHEN k = 0 THEN 'Html' WHEN ai IS NOT NULL THEN 'Ai' ELSE 'None' END AS source FROM r"""
)
def complete_batches(spark, sf_dir):
    """Metadata of every document by a text model that is probed, asked in batches, and fails on texts without words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "own").alias("title"), F.lit(None).cast("string").alias("description"))
    made = enrich.merged(enrich.with_metadata(docs, models.complete_with("first-words", FirstWords, rows=8)))
    return made.select("doc_id", F.when(F.col("title") != "", F.col("title")).alias("title"), joined("ai.topics").alias("topics"), F.col("metadata_source").alias("source"))


# Crawls


@query(
    """WITH RECURSIVE p AS (SELECT DISTINCT page_id AS n FROM pages WHERE page_id >= 0),
    w AS (SELECT n AS start, n, 0 AS depth, '' AS path FROM p UNION ALL SELECT start, p.n, depth + 1, path || CASE WHEN p.n % 2 = 1 THEN 'a' ELSE 'b' END FROM w JOIN p ON p.n IN (2 * w.n + 1, 2 * w.n + 2) WHERE depth < 2)
    SELECT 'https://t.example/p' || start AS start, row_number() OVER (PARTITION BY start ORDER BY path) - 1 AS visit, depth, 'https://t.example/p' || n AS url FROM w"""
)
def tree_crawl(spark, sf_dir):
    """A site whose page n links to pages 2n + 1 and 2n + 2 and back: from every page depth first, two steps deep."""
    n = F.col("page_id")
    address = lambda k: F.concat(F.lit("https://t.example/p"), k.cast("string"))
    html = F.format_string('<a href="/p%d">a</a><a href="%s">b</a><a href="/p%d">up</a>', 2 * n + 1, address(2 * n + 2), F.floor((n - 1) / 2).cast("long"))
    pages = table(spark, sf_dir, "pages").where("page_id >= 0").select("page_id").distinct().select(address(n).alias("url"), html.alias("html"), n)
    down = pages.withColumn("html", F.regexp_replace("html", r'<a href="/p-?\d+">up</a>', ""))  # a link back leads to what was visited, or out of the subtree
    return crawl.crawl_depth_first(down, down, max_depth=2)


@query(
    f"""WITH d AS (SELECT DISTINCT url FROM pages), l AS (SELECT {_HOST} AS host, url FROM d UNION ALL SELECT DISTINCT {_HOST}, 'https://missing.example/' || {_HOST} FROM d)
    SELECT host || '/map.xml' AS sitemap, url, NOT starts_with(url, 'https://missing.') AS known FROM l"""
)
def sitemap_crawl(spark, sf_dir):
    """Sitemaps of all hosts, each with one address more than there are pages, and the pages that they list."""
    pages = table(spark, sf_dir, "pages")
    addresses = pages.select(U.domain_key(F.col("url")).alias("host"), "url").distinct()
    more = addresses.select("host", F.concat(F.lit("https://missing.example/"), "host").alias("url")).distinct()
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    parts = addresses.union(more).groupBy("host", F.pmod(F.xxhash64("url"), F.lit(64)).alias("part")).agg(F.concat_ws("", F.collect_list(entry)).alias("urls"))
    maps = parts.select(F.concat("host", F.lit("/map.xml")).alias("url"), F.concat(F.lit("<urlset>"), "urls", F.lit("</urlset>")).alias("xml"))
    return crawl.crawl_sitemap(maps, pages).select("sitemap", "url", F.col("html").isNotNull().alias("known"))


# Addresses and texts


@query("SELECT page_id, page_id % 2 = 0 AS same, CASE WHEN page_id % 2 = 0 THEN 'c.png' ELSE 'b' || page_id || '.png' END AS best FROM pages")
def url_variants(spark, sf_dir):
    """Addresses against a variant of themselves, the same but for writing or another page; the widest source of an image."""
    url = F.col("url")
    same = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^([a-z]+)://", "$1://www.")
    n = F.col("page_id")
    sources = F.concat(F.lit("a.png 320w, b"), n.cast("string"), F.lit(".png 640w"), F.when(n % 2 == 0, ", c.png 2x,").otherwise(", d.png 0.5x"))
    bare = F.regexp_replace(url, "#.*$", "")
    other = F.when(n % 2 == 0, F.regexp_replace(same, "//www[.]www[.]", "//www.")).otherwise(F.concat(bare, F.lit("x/"), n.cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", U.equivalent(url, other).alias("same"), U.srcset_best(sources).alias("best"))


@query(
    r"""WITH t AS (SELECT doc_id, text, list_filter([trim(x, E' \t\r\x0b\f') FOR x IN string_split(text, E'\n')], lambda x: x <> '') AS lines, list_filter([trim(x, E' \t\r\n\x0b\f') FOR x IN string_split_regex(text, '[.!?]')], lambda x: x <> '') AS parts,
    len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '')) AS n, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)
    SELECT doc_id, length(trim(regexp_replace(text, E'\n{3,}', E'\n\n', 'g'), E' \t\r\n\x0b\f'))::BIGINT AS normalized, length(replace(text, chr(13), chr(10)))::BIGINT AS cleaned, CASE WHEN length(flat) < 50 THEN 0 ELSE length(flat) END::BIGINT AS flat,
    CASE WHEN length(lines[1]) > 100 THEN lines[1][1:100] || '...' ELSE lines[1] END AS title, CASE WHEN length(array_to_string(parts[1:2], '. ')) > 300 THEN array_to_string(parts[1:2], '. ')[1:300] || '...' ELSE array_to_string(parts[1:2], '. ') END AS description,
    greatest(1.0, round_even(n / 200.0, 1))::DOUBLE AS minutes, length(text)::BIGINT AS own_tokens FROM t"""
)
def text_rules(spark, sf_dir):
    """Cleaning, title, description, reading time and a token counter of the caller's own, for every document."""
    text = F.col("text")
    long = lambda c: F.length(c).cast("long")
    return table(spark, sf_dir, "documents").select(
        "doc_id", long(T.normalize_markdown(text)).alias("normalized"), long(T.preprocess(text)).alias("cleaned"), long(T.postprocess(text)).alias("flat"), T.title_from_text(text).alias("title"),
        T.description_from_text(text).alias("description"), T.reading_minutes(T.word_count(text)).alias("minutes"), T.count_tokens(text, F.length).cast("long").alias("own_tokens"),
    )


_KINDS = ("text/html; charset=utf-8", "application/json", "text/xml", "text/markdown", "text/plain", "image/png")


@query(
    """SELECT page_id, unnest(['Html', 'Json', 'Xml', 'Markdown', 'Text', 'Default']) AS reader, unnest(['Text', 'Json', 'Xml', 'Markdown', 'Text', 'Text']) AS exact,
    unnest(['Page ' || page_id || ' & more', 'JSON Content', 'XML Content', 'Markdown Content', 'Text Content', 'Text Content']) AS title,
    unnest(['Page ' || page_id || ' & moretext ' || page_id, '{"n":' || page_id || ',"t":["a","b"]}', '<n>' || page_id || '</n>', '# ' || page_id, 'plain <b>' || page_id, 'x' || page_id]) AS text FROM pages"""
)
def content_kinds(spark, sf_dir):
    """A reply of each kind for every page: its reader by either rule, its title and its text."""
    n = F.col("page_id").cast("string")
    bodies = ("<title>Page %s &amp; more</title><p>text %s</p>", ' {"n": %s, "t": ["a", "b"]}', "<n>%s</n>", "# %s", "plain <b>%s", "x%s")
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.format_string(b, *[n] * b.count("%s")).alias("body")) for k, b in zip(_KINDS, bodies)])
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")
    kind, body = F.col("kind"), F.col("body")
    title = T.decode_entities(pages_source.basic_title(body, kind))
    return each.select("page_id", pages_source.extractor_for(kind).alias("reader"), pages_source.exact_extractor(kind).alias("exact"), title.alias("title"), pages_source.basic_text(body, kind).alias("text"))


# Chunks of special cases


@query(f"SELECT doc_id::VARCHAR AS source_url, 'MemoryOptimized' AS strategy, seq::BIGINT AS sequence_number, content, sha256(doc_id || '|MemoryOptimized|' || seq) AS chunk_id FROM ({_FIXED_PIECES})")
def chunk_memory(spark, sf_dir):
    made = chunking.chunk(_documents_as_pages(table(spark, sf_dir, "documents")), "MemoryOptimized")
    return made.select("source_url", "strategy", "sequence_number", "content", "chunk_id")


@query(
    """WITH p AS (SELECT page_id, 'A sentence that is repeated many times over here. ' AS s FROM pages),
    k AS (SELECT *, (1500 + 1 - length('tiny ' || page_id) - 2) // length(s) AS a, (1500 + 1) // length(s) AS b FROM p)
    SELECT page_id, unnest([0, 1, 2])::BIGINT AS sequence_number, unnest(['tiny ' || page_id || E'\\n\\n' || trim(repeat(s, a)), trim(repeat(s, b)), trim(repeat(s, 70 - a - b))]) AS content FROM k"""
)
def chunk_sections(spark, sf_dir):
    """Sections of pages: a small chunk joins the next, a large one is cut after sentences."""
    html = F.format_string("<article><section><p>tiny %s</p><p>%s</p></section></article>", F.col("page_id").cast("string"), F.repeat(F.lit("A sentence that is repeated many times over here. "), 70))
    made = chunking.chunk(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), html.alias("html")), "DomStructure")
    return made.select(F.col("source_url").cast("long").alias("page_id"), "sequence_number", "content")


def first_letters(sentences):
    """An embedder of columns for tests: whether a sentence begins with a, b or anything else."""
    one = lambda s, letter: F.when(F.lower(F.substring(s, 1, 1)) == letter, 1.0).otherwise(0.0)
    return F.transform(sentences, lambda s: F.array(one(s, "a"), one(s, "b"), 1.0 - one(s, "a") - one(s, "b")))


@query(
    """WITH d AS (SELECT doc_id, doc_id::VARCHAR AS n, doc_id % 4 + 1 AS a, doc_id % 3 + 1 AS b FROM documents)
    SELECT n AS source_url, unnest([0, 1, 2, 3])::BIGINT AS sequence_number, unnest([trim(repeat('Alpha ' || n || '. ', a)), trim(repeat('Beta? ', b)), trim(repeat('Gamma long enough to fill it all up! ', 55)), trim(repeat('Gamma long enough to fill it all up! ', 5))]) AS content FROM d"""
)
def semantic_runs(spark, sf_dir):
    """Runs of like sentences of every document's own text; a run that would pass the largest size is two chunks."""
    n = F.col("doc_id")
    text = F.concat(F.repeat(F.concat(F.lit("Alpha "), n.cast("string"), F.lit(". ")), (n % 4 + 1).cast("int")), F.repeat(F.lit("Beta? "), (n % 3 + 1).cast("int")), F.repeat(F.lit("Gamma long enough to fill it all up! "), 60))
    docs = table(spark, sf_dir, "documents").select(n.cast("string").alias("url"), text.alias("text"))
    return chunking.semantic(docs, first_letters).select("source_url", "sequence_number", "content")


# Rewriting, errors, ratings


@query(
    """WITH t AS (SELECT doc_id, length(text) AS n, doc_id % 3 AS k FROM documents),
    r AS (SELECT *, CASE k WHEN 0 THEN n * 3 // 10 WHEN 1 THEN n * 11 // 20 ELSE n * 7 // 10 END AS m FROM t),
    s AS (SELECT *, CASE WHEN m = 0 THEN n ELSE m END AS size FROM r)
    SELECT doc_id, size::BIGINT AS size, round(size / nullif(n, 0), 6)::DOUBLE AS ratio, CASE WHEN n > 0 AND size / n BETWEEN 0.2 AND 0.5 THEN 0.9 WHEN n > 0 AND size / n BETWEEN 0.1 AND 0.6 THEN 0.7 ELSE 0.5 END::DOUBLE AS quality FROM s"""
)
def rewritten(spark, sf_dir):
    """Every document summarized by a model that keeps a part of its letters: size, ratio and rating of the result; no reply keeps the text."""
    letters, k = F.length("text"), F.col("doc_id") % 3
    kept = F.when(k == 0, F.floor(letters * 3 / 10)).when(k == 1, F.floor(letters * 11 / 20)).otherwise(F.floor(letters * 7 / 10)).cast("int")
    made = enrich.reconstruct(table(spark, sf_dir, "documents").select("doc_id", "text"), "Summarize", lambda prompt: F.repeat(F.lit("x"), kept))
    return made.select("doc_id", F.length("result").cast("long").alias("size"), F.round("ratio", 6).alias("ratio"), F.col("result_quality").alias("quality"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own ' || doc_id WHEN doc_id % 5 <> 0 THEN 'model ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN 'Html' WHEN doc_id % 5 <> 0 THEN 'Ai' END AS title_from,
    CASE WHEN doc_id % 5 <> 0 THEN 'D' END AS description, CASE WHEN doc_id % 5 <> 0 THEN 'a|b' END AS topics, CASE WHEN doc_id % 5 <> 0 THEN 'v' || doc_id END AS version, CASE WHEN doc_id % 5 <> 0 THEN 0.5 END::DOUBLE AS confidence FROM documents"""
)
def schema_metadata(spark, sf_dir):
    """Metadata of every document by a schema: its own title first, the model's else, and what the schema asks for besides."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("url"), F.when(n % 2 == 0, F.concat(F.lit("own "), n.cast("string"))).otherwise(" ").alias("title"), F.lit(None).cast("string").alias("description"))
    reply = F.format_string('ok {"title":"model %1$s","description":"D","topics":["a",""," ","b"],"confidence":0.5,"schemaSpecificData":{"apiVersion":"v%1$s"}} end', n.cast("string"))
    made = enrich.with_schema(docs, "TechnicalDoc", lambda prompt: F.when(F.contains(prompt, F.lit("schemaSpecificData.apiVersion")) & (n % 5 != 0), reply).otherwise("none"))
    return made.select("doc_id", "enriched.title", "enriched.title_from", "enriched.description", joined("enriched.topics").alias("topics"), F.try_element_at("enriched.specific", F.lit("apiVersion")).alias("version"), "enriched.confidence")


_FAILURES = (("HttpRequest", "Network", "Error", True), ("Timeout", "Timeout", "Warning", True), ("UnauthorizedAccess", "Authentication", "Error", False), ("Argument", "Validation", "Warning", False), ("OutOfMemory", "Resource", "Critical", False), ("Format", "General", "Error", True))


@query(
    "SELECT f.category, f.severity, f.retryable, f.code, count(*)::BIGINT AS n FROM events JOIN (VALUES "
    + ", ".join(f"({k}, '{c}', '{s}', {str(r).lower()}, '{n.upper()}')" for k, (n, c, s, r) in enumerate(_FAILURES))
    + ") f(k, category, severity, retryable, code) ON event_id % 6 = f.k GROUP BY ALL"
)
def error_kinds(spark, sf_dir):
    """What every event would mean as the failure whose name its number picks, counted."""
    names = F.array(*[F.lit(n + ("Exception" if k % 2 else "")) for k, (n, *_) in enumerate(_FAILURES)])
    facts = crawl.error_facts(F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "events").select(facts.alias("f")).select("f.*").groupBy("category", "severity", "retryable", "code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, 0.92::DOUBLE AS accuracy, 0.095::DOUBLE AS complexity, 1.0::DOUBLE AS structural, CASE WHEN w < 100 THEN 0.75 ELSE 0.95 END::DOUBLE AS content, 0.5::DOUBLE AS accessibility, 0.8::DOUBLE AS seo, CASE WHEN w < 100 THEN 2 ELSE 1 END AS issues FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM documents)")
def markdown_quality(spark, sf_dir):
    """Accuracy, complexity and quality of Markdown made of the documents, by their numbers of words."""
    docs = table(spark, sf_dir, "documents")
    rated = as_markdown(docs).join(docs.select("doc_id", T.word_count(F.col("text")).alias("w")), "doc_id").withColumn("e", structure.element_rows(F.col("md")))
    title = F.try_element_at(structure.front_matter(F.col("md")), F.lit("title"))
    q = structure.quality(F.col("e"), F.col("w"), F.lit(0.5), title, F.lit(None).cast("string"))
    parts = [F.round(q[n], 6).alias(n) for n in ("structural", "content", "accessibility", "seo")]
    return rated.select("doc_id", F.round(structure.accuracy(F.col("e")), 6).alias("accuracy"), F.round(structure.complexity(F.col("e")), 6).alias("complexity"), *parts, F.size(q["issues"]).alias("issues"))
