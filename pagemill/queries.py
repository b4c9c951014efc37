"""Registered queries of the web-content engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import quality as Q
from pagemill.functions import text as T
from pagemill.functions import urls as U
from pagemill.operators import chunking, crawl, enrich, extract, metadata, stats, strategy, structure
from pagemill.sources.pages import basic_text, fetch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(source: str, sql: str | None = None):
    """Register ``f(table)`` under the function's name, with its SQL."""

    def register(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(table(spark, sf_dir, source))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to text to chunks, with the size of each site's output."""
    chunks = page_chunks_by_size(table(spark, sf_dir, "pages"))
    return chunks.groupBy("host").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").alias("chars"))


_ABS = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)(\?[^#]*)?(?:#.*)?$'"
_HOST = f"lower(regexp_extract(url, {_ABS}, 2))"
_NORM = f"""lower(regexp_extract({{0}}, {_ABS}, 1)) || '://' || regexp_replace(lower(regexp_extract({{0}}, {_ABS}, 2)), '^www\\.', '')
 || CASE WHEN regexp_extract({{0}}, {_ABS}, 3) IN ('', CASE lower(regexp_extract({{0}}, {_ABS}, 1)) WHEN 'http' THEN '80' WHEN 'https' THEN '443' END) THEN '' ELSE ':' || regexp_extract({{0}}, {_ABS}, 3) END
 || CASE WHEN regexp_extract({{0}}, {_ABS}, 4) IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace(regexp_extract({{0}}, {_ABS}, 4), '/+$', ''), '//+', '/', 'g') END
 || regexp_extract({{0}}, {_ABS}, 5)"""
_STRIP = "regexp_replace(html, '<[^>]*>', '', 'g')"
#: The references that the test pages hold; cases cover the others.
_DECODE = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
_TEXT = f"trim({_DECODE.format(_STRIP)}, E' \\t\\n\\r')"
_WORDS = "len(regexp_extract_all({0}, '[^ \\t\\n\\r]+'))::BIGINT"


# The fixed lists as the SQL has them, apart from those of the code under test
_PAYWALL = (
    "paywall", "subscribe", "subscription", "premium", "members only", "sign up to read", "login to continue", "paid content",
    "exclusive content", "premium-content", "subscriber-only", "paid-article", "paywall-content", "구독", "유료", "프리미엄", "회원전용",
)
_AD_WORDS = (
    "ad-container", "ad-wrapper", "advertisement", "sponsored", "google-ad", "adsense", "ad-unit", "ad-slot", "banner-ad",
    "promoted-content", "sponsored-content", "native-ad",
)
_LOGIN = ("login required", "sign in to", "log in to", "create an account", "register to", "members only", "로그인", "회원가입")
_AGE = ("age-gate", "age-verification", "adult content", "18+", "성인인증")
_STRUCTURED = ("application/ld+json", 'itemtype="http://schema.org', 'vocab="http://schema.org')
_CITATIONS = ("[1]", "참고문헌", "References", "출처:")
_KINDS = {
    "article": ("article", "news", "story", "post"),
    "blog": ("blog", "author", "posted by"),
    "documentation": ("docs", "documentation", "api", "reference", "guide"),
    "product": ("price", "buy", "cart", "add to cart", "product"),
    "forum": ("forum", "thread", "reply", "comment"),
}
_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".svg", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".tar",
    ".gz", ".7z", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".css", ".js", ".woff", ".woff2", ".ttf", ".eot",
)
_STOP = (
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at",
    "는", "은", "이", "가", "을", "를", "에", "의", "와", "과", "으로", "로", "에서", "까지", "부터", "하다", "있다", "없다", "되다", "아니다",
)
_TECHNICAL = (
    "class", "function", "method", "api", "endpoint", "parameter", "return", "exception", "interface", "implementation", "algorithm",
    "data structure", "performance", "optimization", "configuration", "deployment", "installation", "setup", "tutorial", "guide",
)
_ACADEMIC = (
    "abstract", "introduction", "methodology", "results", "conclusion", "references", "bibliography", "research", "study", "analysis",
    "experiment", "hypothesis", "theory", "literature review",
)
_NEWS = (
    "breaking news", "report", "journalist", "correspondent", "press release", "statement", "announcement", "update",
    "developing story", "exclusive", "investigation",
)
_CODE_WORDS = ("class ", "function ", "method ", "api ", "```", "code", "example", "parameter", "return", "import", "export", "interface", "type")


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '" + w.replace("'", "''") + "')" for w in words) + ")"


# URLs, links and crawling


@query("pages", f"SELECT page_id, {_NORM.format('url')} AS normalized FROM pages")
def url_normalize(pages):
    return pages.select("page_id", U.normalize(F.col("url")).alias("normalized"))


@query("pages", f"SELECT page_id, {_HOST} AS domain, lower(regexp_extract(regexp_extract(url, {_ABS}, 4), '\\.[^./]+$')) AS extension FROM pages")
def url_parts(pages):
    return pages.select("page_id", U.domain_key(F.col("url")).alias("domain"), U.extension(F.col("url")).alias("extension"))


_LINKS = r"""
WITH r AS (SELECT page_id, url, unnest(list_filter(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1),
   lambda x: NOT regexp_matches(x, '(?i)^(javascript|mailto|tel):|^\s*$|^#'))) AS h FROM pages),
a AS (SELECT page_id, url, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([^:]+:)', 1) || h
   WHEN starts_with(h, '/') THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*') || h
   WHEN starts_with(h, '?') THEN regexp_replace(url, '[?#].*$', '') || h
   ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || h END AS link FROM r)
"""


@query("pages", _LINKS + "SELECT page_id, link, count(*)::BIGINT AS n FROM a WHERE regexp_matches(link, '(?i)^https?://') GROUP BY ALL")
def extract_links(pages):
    links = pages.select("page_id", F.explode(U.extract_links(F.col("html"), F.col("url"))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("pages", _LINKS + f"""SELECT page_id, link, (lower(regexp_extract(link, {_ABS}, 2)) = {_HOST}
   AND lower(regexp_extract(regexp_extract(link, {_ABS}, 4), '\\.[^./]+$')) NOT IN ({", ".join(f"'{e}'" for e in _EXTENSIONS)})) AS wanted
   FROM (SELECT DISTINCT page_id, url, link FROM a WHERE regexp_matches(link, '(?i)^https?://'))""")
def should_crawl(pages):
    links = pages.select("page_id", "url", F.explode(F.array_distinct(U.extract_links(F.col("html"), F.col("url")))).alias("link"))
    return links.select("page_id", "link", U.should_crawl(F.col("link"), F.col("url")).alias("wanted"))


@query("pages", _LINKS + f"""SELECT DISTINCT {_NORM.format('link')} AS next_url FROM a WHERE regexp_matches(link, '(?i)^https?://')
   AND {_NORM.format('link')} NOT IN (SELECT {_NORM.format('url')} FROM pages)""")
def crawl_frontier(pages):
    """Not yet visited links: an anti join on the normalized URL."""
    links = pages.select(F.explode(U.extract_links(F.col("html"), F.col("url"))).alias("link")).select(U.normalize(F.col("link")).alias("next_url"))
    return links.join(pages.select(U.normalize(F.col("url")).alias("next_url")), "next_url", "left_anti").distinct()


@query("pages", _LINKS + f"""SELECT node, sum(o)::BIGINT AS out_links, sum(i)::BIGINT AS in_links FROM (
   SELECT {_NORM.format('url')} AS node, 1 AS o, 0 AS i FROM a WHERE regexp_matches(link, '(?i)^https?://')
   UNION ALL SELECT {_NORM.format('link')}, 0, 1 FROM a WHERE regexp_matches(link, '(?i)^https?://')) GROUP BY node""")
def link_degree(pages):
    links = pages.select(U.normalize(F.col("url")).alias("source"), F.explode(U.extract_links(F.col("html"), F.col("url"))).alias("link"))
    return stats.link_degrees(links.select("source", U.normalize(F.col("link")).alias("target")), "source", "target")


@query("pages", f"SELECT {_HOST} AS domain, count(*)::BIGINT AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def count_by_domain(pages):
    return pages.groupBy(U.domain_key(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).alias("chars"))


# Text


@query("pages", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), 'Untitled') AS title FROM pages")
def page_title(pages):
    return pages.select("page_id", T.title_of(F.col("html")).alias("title"))


@query("pages", f"""SELECT page_id, {_TEXT} AS text, {_WORDS.format(_TEXT)} AS words,
   greatest(1.0, {_WORDS.format(_TEXT)} / 200.0)::DOUBLE AS minutes FROM pages""")
def basic_page_text(pages):
    text = basic_text(F.col("html"), F.lit("text/html"))
    return pages.select("page_id", text.alias("text")).withColumn("words", T.word_count(F.col("text"))).withColumn("minutes", T.reading_minutes_exact(F.col("words")).cast("double"))


_TOKENS = "CASE WHEN trim({0}, E' \\t\\n\\r') = '' THEN 0 ELSE ceil((length({0}) - len(regexp_extract_all({0}, '[가-힣一-鿿぀-ゟ゠-ヿ]'))) / 4.0 + len(regexp_extract_all({0}, '[가-힣一-鿿぀-ゟ゠-ヿ]')) / 1.5)::BIGINT END"


@query("documents", f"""SELECT doc_id, {_WORDS.format('text')} AS words, {_TOKENS.format('text')} AS tokens,
   greatest(1, ceil({_WORDS.format('text')} / 200.0))::BIGINT AS minutes FROM documents""")
def document_counts(docs):
    words = T.word_count(F.col("text"))
    return docs.select("doc_id", words.alias("words"), T.token_estimate(F.col("text")).alias("tokens"), T.reading_minutes_whole(words).alias("minutes"))


@query(
    "documents",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[぀-ゟ゠-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS by_presence, "
    "CASE WHEN len(regexp_extract_all(text, '[가-힣]')) / length(text) > 0.1 THEN 'ko' WHEN len(regexp_extract_all(text, '[぀-ゟ゠-ヿ]')) / length(text) > 0.1 THEN 'ja' "
    "WHEN len(regexp_extract_all(text, '[一-鿿]')) / length(text) > 0.1 THEN 'zh' ELSE 'en' END AS by_share FROM documents",
)
def language_guess(docs):
    return docs.select("doc_id", T.language_by_presence(F.col("text")).alias("by_presence"), T.language_by_share(F.col("text")).alias("by_share"))


@query("documents", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), 1) AS pos FROM documents),
   c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM w WHERE length(word) > 2 AND word NOT IN ({", ".join(f"'{w}'" for w in _STOP)}) GROUP BY ALL)
   SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank, word, n FROM c QUALIFY rank <= 10""")
def keywords_top(docs):
    return stats.keywords(docs, "doc_id")


@query("documents", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '#{1,6}\s*', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`([^`]+)`', '\1', 'g'), E' \n\t\r') AS plain FROM documents""")
def plain_text_clean(docs):
    return docs.select("doc_id", F.regexp_replace(T.plain_text(F.col("text")), r"^[ \n\t\r]+|[ \n\t\r]+$", "").alias("plain"))


@query("documents", r"""SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x, E' \t\r')), lambda x: x <> '' AND NOT starts_with(x, '#')), 1, 3), ' ')[:300]
   || CASE WHEN length(array_to_string(list_slice(list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x, E' \t\r')), lambda x: x <> '' AND NOT starts_with(x, '#')), 1, 3), ' ')) > 300 THEN '...' ELSE '' END AS description FROM documents""")
def document_description(docs):
    return docs.select("doc_id", T.description_of(F.col("text")).alias("description"))


# Quality


def _page_text(pages):
    return pages.select("page_id", "url", "html", T.page_text(F.col("html")).alias("text"), T.title_of(F.col("html")).alias("title"))


_PT = (
    "WITH p AS (SELECT page_id, url, html, trim(" + _DECODE.format(r"regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')")
    + ") AS text, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), 'Untitled') AS title FROM pages) "
)


@query("pages", _PT + f"""SELECT page_id, {_any("lower(html || ' ' || text)", _PAYWALL)} AS paywall, {_any("lower(html || ' ' || text)", _LOGIN)} AS login,
   {_any("lower(html)", _AGE)} AS age, {_any("lower(html)", _STRUCTURED)} AS structured, {_any("text", _CITATIONS)} AS citations FROM p""")
def page_flags(pages):
    html, text = F.col("html"), F.col("text")
    return _page_text(pages).select(
        "page_id", Q.has_paywall(html, text).alias("paywall"), Q.requires_login(html, text).alias("login"), Q.age_restricted(html).alias("age"),
        Q.has_structured_data(html).alias("structured"), Q.has_citations(text).alias("citations"),
    )


_TYPE = "CASE " + " ".join(f"""WHEN {_any("lower(title || ' ' || text || ' ' || url)", ws)} THEN '{k}'""" for k, ws in _KINDS.items()) + " ELSE 'general' END"
_ADS = "least(1.0, (len(regexp_extract_all(html, '(?i)<(ins|iframe)[^>]*(adsense|doubleclick|googlesyndication)[^>]*>')) + " + " + ".join(
    f"(length(html) - length(replace(lower(html), '{w}', ''))) / {len(w)}" for w in _AD_WORDS
) + ") / 20.0)::DOUBLE"
_RATIO = "least(1.0, length(text)::DOUBLE / length(html) * 3)"


@query("pages", _PT + f"SELECT page_id, {_TYPE} AS content_type, round({_ADS}, 6) AS ad_density, round({_RATIO}, 6) AS content_ratio FROM p")
def page_measures(pages):
    measured = _page_text(pages)
    return measured.select(
        "page_id", Q.content_type(F.col("title"), F.col("text"), F.col("url")).alias("content_type"),
        F.round(Q.ad_density(F.col("html")), 6).alias("ad_density"), F.round(Q.content_ratio(F.col("html"), F.col("text")), 6).alias("content_ratio"),
    )


def _quality_sql(headings: str, metadata: str) -> str:
    return _PT + f""", m AS (SELECT page_id, {_ADS} AS ads, {_RATIO} AS ratio, {_WORDS.format('text')} AS words, {_TOKENS.format('text')} AS tokens,
   {_any("lower(html || ' ' || text)", _PAYWALL)} AS paywall, {_any("lower(html || ' ' || text)", _LOGIN)} AS login FROM p),
   s AS (SELECT *, greatest(0.0, least(1.0, 0.5 - CASE WHEN paywall THEN 0.3 ELSE 0 END - CASE WHEN login THEN 0.2 ELSE 0 END - ads * 0.2 + ratio * 0.2
     + CASE WHEN words BETWEEN 100 AND 5000 THEN 0.1 WHEN words > 5000 THEN 0.05 ELSE 0 END
     + CASE WHEN {headings} >= 2 THEN 0.05 ELSE 0 END + CASE WHEN {metadata} THEN 0.05 ELSE 0 END)) AS overall,
     greatest(0.0, least(1.0, 0.5 + ratio * 0.3 - ads * 0.2 + CASE WHEN words BETWEEN 500 AND 3000 THEN 0.2 WHEN words < 500 THEN -0.1 ELSE 0 END
     + CASE WHEN tokens <= 8000 THEN 0.1 WHEN tokens > 32000 THEN -0.2 ELSE 0 END)) AS llm FROM m)
   SELECT page_id, round(overall, 6)::DOUBLE AS overall, round(llm, 6)::DOUBLE AS llm_suitability, CASE WHEN round(overall, 9) >= 0.8 THEN 'Excellent' WHEN round(overall, 9) >= 0.6 THEN 'Good' WHEN round(overall, 9) >= 0.4 THEN 'Fair' WHEN round(overall, 9) >= 0.2 THEN 'Poor' ELSE 'VeryPoor' END AS grade FROM s"""


@query("pages", _quality_sql("0", "false"))
def page_quality(pages):
    made = _page_text(pages)
    q = Q.quality(F.col("html"), F.col("text"), F.col("title"), F.col("url"), F.lit(0), F.lit(False))
    scored = made.select("page_id", q["overall_score"].alias("o"), q["llm_suitability"].alias("l"))
    return scored.select("page_id", F.round("o", 6).alias("overall"), F.round("l", 6).alias("llm_suitability"), Q.grade(F.round("o", 9)).alias("grade"))


@query("pages", r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<(?:h[1-6])[\s/>]'))::BIGINT AS headings, len(regexp_extract_all(html, '(?i)<(?:p)[\s/>]'))::BIGINT AS paragraphs,
   len(regexp_extract_all(html, '(?i)<a\s[^>]*href'))::BIGINT AS links, len(regexp_extract_all(html, '(?i)<(?:ul|ol)[\s/>]'))::BIGINT AS lists FROM pages""")
def structure_counts(pages):
    shape = pages.select("page_id", metadata.structure(F.col("html")).alias("s"))
    return shape.select("page_id", *[F.col(f"s.{c}").alias(c) for c in ("headings", "paragraphs", "links", "lists")])


_SCRIPT = r"""len(list_filter(regexp_extract_all(html, '(?i)<script(?:\s[^>]*)?>'), lambda t: NOT regexp_matches(t, '(?i)\stype\s*=')
   OR regexp_matches(t, '(?i)\stype\s*=\s*["'']?(?:text|application)/javascript["'']?[\s>]'))) > 0"""
_META = r"""nullif(trim(regexp_extract(html, '(?is)<meta[^>]*\b(?:name|property)\s*=\s*["'']{0}["''][^>]*\bcontent\s*=\s*["'']([^"'']*)["'']', 1)), '')"""
_LANG = r"""nullif(trim(regexp_extract(html, '(?is)<html[^>]*\blang\s*=\s*["'']([^"'']*)["'']', 1)), '')"""
_COUNT = r"len(regexp_extract_all(html, '(?i)<(?:{0})[\s/>]'))"


@query("pages", f"""SELECT page_id, starts_with(lower(url), 'https://') AS https, {_SCRIPT} AS needs_javascript, {_META.format('viewport')} IS NOT NULL AS viewport,
   lower(regexp_extract({_LANG}, '^([A-Za-z]+)', 1)) AS language FROM pages""")
def technical_flags(pages):
    made = pages.select("page_id", metadata.technical(F.col("html"), F.col("url")).alias("t"), metadata.language(F.col("html"), F.col("html")).alias("l"))
    return made.select("page_id", "t.https", "t.needs_javascript", F.col("t.has_viewport").alias("viewport"), "l.language")


_LEVELS = r"list_transform(regexp_extract_all(html, '(?i)<h([1-6])[\s/>]', 1), lambda x: x::INT)"
_ACCESS = rf"""SELECT page_id, url, html, coalesce(len(list_filter(i, lambda t: regexp_matches(t, '(?i)\salt[\s=/>]')))::DOUBLE / nullif(len(i), 0), 1.0) AS coverage,
   len(l) > 0 AND l[1] = 1 AND len(list_filter(range(2, len(l) + 1), lambda k: l[k] - l[k - 1] > 1)) = 0 AS ordered,
   regexp_matches(html, '(?i)<a\s[^>]*class\s*=\s*["''][^"'']*skip') OR regexp_matches(html, '(?i)<a\s[^>]*href\s*=\s*["''][^"'']*#(main|content)') AS skip,
   regexp_matches(html, '(?i)<[a-z][^>]*\saria-(?:label|labelledby|describedby)[\s=/>]') AS aria
   FROM (SELECT page_id, url, html, regexp_extract_all(html, '(?i)<img[\s/>][^>]*>?') AS i, {_LEVELS} AS l FROM pages)"""
_ACCESS_SCORE = "(floor(40 * coverage) + CASE WHEN ordered THEN 25 ELSE 0 END + CASE WHEN skip THEN 15 ELSE 0 END + CASE WHEN aria THEN 20 ELSE 0 END)"


@query("pages", f"SELECT page_id, coverage AS alt_coverage, ordered AS ordered_headings, skip AS skip_link, aria, {_ACCESS_SCORE}::BIGINT AS score FROM ({_ACCESS})")
def accessibility(pages):
    return pages.select("page_id", metadata.accessibility(F.col("html")).alias("a")).select("page_id", "a.*")


_SHAPE = (
    f"{_COUNT.format('h[1-6]')} AS headings, {_COUNT.format('p')} AS paragraphs, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href')) AS links, {_COUNT.format('img')} AS images, "
    f"{_COUNT.format('table')} AS tables, {_COUNT.format('pre|code')} AS codes, "
    r"len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[^ \t\n\r]+')) AS words"
)
_COMPLEX = (
    "least(1.0::DOUBLE, least(headings * 0.1::DOUBLE, 1.0::DOUBLE) + least(paragraphs * 0.01::DOUBLE, 0.5::DOUBLE) + least(links * 0.005::DOUBLE, 0.3::DOUBLE)"
    " + least(images * 0.02::DOUBLE, 0.4::DOUBLE) + least(tables * 0.05::DOUBLE, 0.3::DOUBLE) + least(codes * 0.1::DOUBLE, 0.5::DOUBLE))"
)


@query("pages", f"SELECT page_id, words::BIGINT AS words, ceil(words / 250.0)::BIGINT AS reading_minutes, round({_COMPLEX}, 6) AS complexity FROM (SELECT page_id, {_SHAPE} FROM pages)")
def structure_complexity(pages):
    made = pages.select("page_id", metadata.structure(F.col("html")).alias("s"))
    return made.select("page_id", "s.words", "s.reading_minutes", F.round("s.complexity", 6).alias("complexity"))


_BASIC = (
    "least(1.0, CASE WHEN nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') IS NOT NULL THEN 0.3 ELSE 0 END"
    f" + CASE WHEN {_META.format('description')} IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN {_META.format('keywords')} IS NOT NULL THEN 0.1 ELSE 0 END"
    f" + CASE WHEN {_META.format('author')} IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN {_LANG} IS NOT NULL THEN 0.1 ELSE 0 END"
    r""" + CASE WHEN regexp_matches(html, '(?is)<link[^>]*rel\s*=\s*["'']canonical["'']') THEN 0.1 ELSE 0 END)"""
)
_OG = "least(1.0, " + " + ".join(f"CASE WHEN {_META.format('og:' + n)} IS NOT NULL THEN {w} ELSE 0 END" for n, w in (("title", 0.25), ("description", 0.25), ("image", 0.25), ("url", 0.15), ("type", 0.1))) + ")"
_CARDS = " + ".join(f"CASE WHEN {_META.format('twitter:' + n)} IS NOT NULL THEN 0.25 ELSE 0 END" for n in ("card", "title", "description", "image"))
_MANIFEST = r"""regexp_matches(html, '(?is)<link[^>]*rel\s*=\s*["'']manifest["'']')"""


@query("pages", f"""WITH a AS (SELECT page_id AS id, coverage, ordered, skip, aria FROM ({_ACCESS})),
   b AS (SELECT *, {_SHAPE}, {_BASIC}::DOUBLE AS basic, {_OG}::DOUBLE AS og, ({_CARDS})::DOUBLE AS cards FROM pages JOIN a ON a.id = page_id),
   c AS (SELECT *, (CASE WHEN headings > 0 THEN 0.3 ELSE 0 END + CASE WHEN {_COMPLEX} > 0.3::DOUBLE THEN 0.3 ELSE 0 END + CASE WHEN words > 0 THEN 0.2 ELSE 0 END + CASE WHEN links > 0 THEN 0.2 ELSE 0 END)::DOUBLE AS shape,
     (CASE WHEN starts_with(lower(url), 'https://') THEN 0.3 ELSE 0 END + CASE WHEN {_META.format('viewport')} IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN {_SCRIPT} THEN 0 ELSE 0.2 END
       + CASE WHEN {_MANIFEST} THEN 0.2 ELSE 0 END)::DOUBLE AS tech FROM b)
   SELECT page_id, round(basic, 6) AS basic, round(og, 6) AS open_graph, round(cards, 6) AS twitter, round(shape, 6) AS structure, round(tech, 6) AS technical,
     round(basic * 0.25 + og * 0.2 + shape * 0.15 + tech * 0.1 + {_ACCESS_SCORE} / 100.0 * 0.1, 6)::DOUBLE AS quality, round((basic + og + cards) / 4.0, 6)::DOUBLE AS completeness FROM c""")
def metadata_scores(pages):
    """The test pages have no JSON-LD: its part is 0 in the SQL; cases cover it."""
    made = metadata.describe(pages)
    parts = {"basic_score": "basic", "open_graph_score": "open_graph", "twitter_score": "twitter", "structure_score": "structure", "technical_score": "technical", "quality_score": "quality", "completeness": "completeness"}
    return made.select("page_id", *[F.round(c, 6).alias(n) for c, n in parts.items()])


# Chunks


def page_chunks_by_size(pages):
    text = pages.select("page_id", U.host(F.col("url")).alias("host"), basic_text(F.col("html"), F.lit("text/html")).alias("text"))
    chunks = text.select("page_id", "host", F.posexplode(T.split_by_size(F.col("text"), 1500)).alias("seq", "content"))
    return chunks.select("page_id", "host", F.col("seq").cast("long").alias("seq"), F.length("content").cast("long").alias("chars"), "content")


def _packed_sql(texts: str, size: int) -> str:
    """SQL over ``texts`` (id, text): (id, seq, content) of words packed greedily; a step for each chunk of a text.

    ``es[k]`` is where word k ends, ``bs[k]`` where it begins; a chunk that begins at word s ends before the first word k
    with ``es[k] > size + bs[s]``.
    """
    return f"""(WITH RECURSIVE t AS ({texts}),
     w AS (SELECT id, k, word, sum(length(word) + 1) OVER (PARTITION BY id ORDER BY k) - 1 AS e FROM (
       SELECT id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS k FROM t WHERE trim(text, E' \\t\\n\\r') <> '')),
     l AS (SELECT id, list(word ORDER BY k) AS ws, list(e ORDER BY k) AS es, list(e - length(word) ORDER BY k) AS bs FROM w GROUP BY id),
     c AS (SELECT id, 0 AS seq, 1::BIGINT AS s, greatest(len(list_filter(es, lambda x: x <= {size} + bs[1])) + 1, 2) AS n, ws, es, bs FROM l
       UNION ALL SELECT id, seq + 1, n, greatest(len(list_filter(es, lambda x: x <= {size} + bs[n])) + 1, n + 1), ws, es, bs FROM c WHERE n <= len(ws))
     SELECT id, seq::BIGINT AS seq, array_to_string(ws[s:n - 1], ' ') AS content FROM c)"""


@query("pages", f"SELECT id AS page_id, {_HOST} AS host, seq, length(content)::BIGINT AS chars, content FROM {_packed_sql(f'SELECT page_id AS id, {_TEXT} AS text FROM pages', 1500)} c JOIN pages ON id = page_id")
def chunk_by_size(pages):
    return page_chunks_by_size(pages)


def _auto_sql(url: str = "source", headings: str = "0", images: str = "0") -> str:
    has = lambda text, words: _any(text, words)
    count = " + ".join(f"contains(lower(text), '{w}')::INT" for w in _TECHNICAL)
    return f"""WITH a AS (SELECT doc_id, length(text)::BIGINT AS length, ({count}) >= 3 AS technical, {images} AS images, ({headings} * 2 + {images}) / greatest(length(text) / 1000.0, 1.0) AS shape, {images} / greatest(length(text) // 1000, 1) AS shown,
   CASE WHEN {has('lower(text)', _ACADEMIC)} THEN 'Academic' WHEN {has('lower(text)', _NEWS)} THEN 'News' WHEN {has('lower(text)', _TECHNICAL)} THEN 'Technical'
   WHEN contains(lower({url}), 'doc') OR contains(lower({url}), 'api') THEN 'Documentation' WHEN contains(lower({url}), 'blog') THEN 'Blog' ELSE 'Article' END AS kind FROM documents),
   s AS (SELECT a.*, s.name, s.place,
     CASE WHEN name = 'MemoryOptimized' AND length > 100000 THEN 0.9 WHEN name = 'Smart' AND length > 50000 THEN 0.8 WHEN name = 'Paragraph' AND length > 5000 THEN 0.7 WHEN name = 'FixedSize' AND length <= 5000 THEN 0.6 ELSE 0.3 END * 0.20
     + CASE WHEN name = 'Smart' AND shape >= 2 THEN 0.9 WHEN name = 'Semantic' AND shape >= 2 THEN 0.7 WHEN name = 'Smart' AND shape >= 0.5 AND shape < 2 THEN 0.8 WHEN name = 'Paragraph' AND shape >= 0.5 AND shape < 2 THEN 0.6
       WHEN name = 'FixedSize' AND shape < 0.5 THEN 0.5 ELSE 0.3 END * 0.25
     + CASE WHEN name = 'Semantic' AND kind = 'Academic' THEN 0.9 WHEN name = 'Semantic' AND kind = 'Technical' THEN 0.8 WHEN name = 'Smart' AND kind = 'Documentation' THEN 0.9 WHEN name = 'Smart' AND kind = 'Technical' THEN 0.8
       WHEN name = 'Paragraph' AND kind = 'Blog' THEN 0.7 WHEN name = 'Paragraph' AND kind = 'Article' THEN 0.6 ELSE 0.4 END * 0.30
     + CASE WHEN images = 0 THEN 0.5 WHEN name = 'Smart' AND shown > 0.3 THEN 0.9 WHEN name = 'Smart' THEN 0.7 WHEN name = 'Paragraph' AND shown <= 0.3 THEN 0.6 ELSE 0.4 END * 0.15
     + CASE WHEN name = 'Semantic' AND technical THEN 0.9 WHEN name = 'Smart' AND technical THEN 0.8 WHEN name = 'Paragraph' AND NOT technical THEN 0.6 WHEN name = 'FixedSize' AND NOT technical THEN 0.5 ELSE 0.4 END * 0.10 + 0.5 AS score
     FROM a, (VALUES ('FixedSize', 0), ('Paragraph', 1), ('Smart', 2), ('Semantic', 3), ('MemoryOptimized', 4)) s(name, place))
   SELECT doc_id, kind AS content_type, technical, name AS best, round(score, 6)::DOUBLE AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, place) = 1"""


@query("documents", _auto_sql())
def auto_select(docs):
    none = docs.withColumns({"__h": F.lit(0), "__i": F.lit(0)})
    made = strategy.scored(none, "text", "source", "__h", "__i").withColumn("b", strategy.best(F.col("scores")))
    return made.select("doc_id", "content_type", "technical", F.col("b.strategy").alias("best"), F.round("b.score", 6).alias("score"))


_REC = " + ".join("contains(lower(text), '" + w + "')::INT" for w in _CODE_WORDS)


@query("documents", f"""SELECT doc_id, CASE WHEN length(text) > 100000 THEN 'MemoryOptimized' WHEN ({_REC}) >= 3 THEN 'Smart' WHEN length(text) > 10000 THEN 'Semantic' ELSE 'Paragraph' END AS recommended FROM documents""")
def recommend_strategy(docs):
    return docs.select("doc_id", strategy.recommend(F.col("text"), F.lit(None).cast("string"), F.col("source"), F.lit(0), F.lit(0)).alias("recommended"))


@query("conversations", """WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
   s AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(nxt), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS b FROM t WHERE nxt IS NOT NULL)
   SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1) END, 6)::DOUBLE AS similarity FROM s""")
def adjacent_jaccard(turns):
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.withColumn("next", following).where("next is not null")
    return pairs.select("conv_id", "turn", F.round(T.jaccard(T.words(F.col("text")), T.words(F.col("next"))), 6).alias("similarity"))


@query("conversations", """SELECT conv_id, count(*)::BIGINT AS chunks, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0.0, 1 - stddev_pop(length(text)) / nullif(avg(length(text)), 0)) END, 6)::DOUBLE AS size_consistency FROM conversations GROUP BY conv_id""")
def size_consistency(turns):
    made = strategy.chunk_quality(turns, "conv_id", "turn", "text")
    return made.select("conv_id", "chunks", F.round("size_consistency", 6).alias("size_consistency"))


@query("embeddings", """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS b FROM embeddings)
   SELECT vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6)::DOUBLE AS similarity FROM p WHERE b IS NOT NULL""")
def embedding_neighbours(vectors):
    """Cosine of each vector and that of the next larger id."""
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = stats.with_next(doubles, "vec_id", "a", "b").where("b is not null")
    return both.select("vec_id", F.round(chunking.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


# Statistics over events: users stand for sites, errors for failures, values for times


def _requests(events):
    return events.select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), (F.col("event_type") != "error").alias("ok"), "value")


@query("events", """SELECT count(*)::BIGINT AS total, count(*) FILTER (event_type <> 'error')::BIGINT AS succeeded, count(*) FILTER (event_type = 'error')::BIGINT AS failed,
   round(avg(value) FILTER (event_type <> 'error'), 4) AS avg_ms, min(value) FILTER (event_type <> 'error') AS min_ms, max(value) FILTER (event_type <> 'error') AS max_ms,
   sum(length(props)) FILTER (event_type <> 'error')::BIGINT AS chars, count(*) FILTER (event_type = 'view')::BIGINT AS cache_hits, round((count(*) FILTER (event_type = 'view'))::DOUBLE / count(*), 6) AS hit_rate FROM events""")
def batch_statistics(events):
    rows = events.select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"), F.length("props").alias("chars"), (F.col("event_type") == "view").alias("cached"))
    made = stats.batch_statistics(rows)
    return made.withColumns({"avg_ms": F.round("avg_ms", 4), "hit_rate": F.round("hit_rate", 6)})


@query("events", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def event_type_counts(events):
    return stats.count_by(events, "event_type")


@query("events", """SELECT event_id, count(*) OVER w AS done, (sum((event_type = 'error')::INT) OVER w)::BIGINT AS failed, avg(CASE WHEN cents > 0 THEN cents END) OVER w AS mean_cents,
   min(CASE WHEN cents > 0 THEN cents END) OVER w AS min_cents, max(CASE WHEN cents > 0 THEN cents END) OVER w AS max_cents FROM (SELECT *, round(value * 100)::BIGINT AS cents FROM events)
   WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def progress_running(events):
    rows = _requests(events).withColumns({"at": F.struct("ts", "event_id"), "cents": F.round(F.col("value") * 100).cast("long")})
    made = stats.progress(rows, "user_id", "at", "ok", "cents")
    return made.select("event_id", "done", "failed", F.col("mean_ms").alias("mean_cents"), F.col("min_ms").alias("min_cents"), F.col("max_ms").alias("max_cents"))


@query("events", """WITH r AS (SELECT user_id, ts, event_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS run FROM events)
   SELECT user_id, first(event_id ORDER BY ts, event_id) AS first_id, last(event_id ORDER BY ts, event_id) AS last_id, count(*)::BIGINT AS failures, count(*) >= 3 AS opens FROM r WHERE failed GROUP BY user_id, run""")
def breaker_runs(events):
    rows = _requests(events).withColumn("failed", ~F.col("ok")).withColumn("at", F.struct("ts", "event_id"))
    made = stats.failure_runs(rows, "user_id", "at", "failed")
    return made.select("user_id", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"), "failures", "opens")


@query("events", """WITH a AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) * 1000 AS p FROM events)
   SELECT event_id, (max(t - p) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + p)::BIGINT AS start_ms FROM a""")
def rate_limit_starts(events):
    requests = events.select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival"))
    return stats.rate_limit_starts(requests, "user_id", "event_id", "arrival").select("event_id", F.col("start_ms").cast("long").alias("start_ms"))


_HREFS = r"""list_filter(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1), lambda x: NOT regexp_matches(x, '(?i)^(javascript|mailto|tel):|^\s*$|^#'))"""


@query("pages", _LINKS.replace("AS h FROM pages)", f"AS h, generate_subscripts({_HREFS}, 1) AS spot FROM pages)").replace("SELECT page_id, url, CASE", "SELECT page_id, url, spot, CASE") + f"""
   SELECT page_id, string_agg(path, ' ' ORDER BY spot) AS related FROM (
     SELECT page_id, path, min(spot) AS spot, row_number() OVER (PARTITION BY page_id ORDER BY min(spot)) AS place FROM (SELECT page_id, spot, regexp_extract(link, {_ABS}, 4) AS path FROM a
     WHERE regexp_matches(link, '(?i)^https?://') AND lower(regexp_extract(link, {_ABS}, 2)) = {_HOST} AND regexp_extract(link, {_ABS}, 4) <> regexp_extract(url, {_ABS}, 4)) GROUP BY page_id, path)
   WHERE place <= 20 GROUP BY page_id""")
def related_pages(pages):
    made = pages.select("page_id", F.array_join(U.related_pages(F.col("html"), F.col("url")), " ").alias("related"))
    return made.where("related <> ''")


_TEXT_QUALITY = f"""greatest(0.0, least(1.0, 0.5 - CASE WHEN {_any("lower(text || ' ' || text)", _PAYWALL)} THEN 0.3 ELSE 0 END - CASE WHEN {_any("lower(text || ' ' || text)", _LOGIN)} THEN 0.2 ELSE 0 END + 0.2
   + CASE WHEN {_WORDS.format('text')} BETWEEN 100 AND 5000 THEN 0.1 WHEN {_WORDS.format('text')} > 5000 THEN 0.05 ELSE 0 END))"""


@query("documents", rf"""SELECT doc_id, CASE WHEN length(text) > 10000 THEN 'Summarize' WHEN round({_TEXT_QUALITY}, 9) < 0.6 THEN 'Rewrite' WHEN length(text) < 500 THEN 'Expand'
   WHEN len(regexp_extract_all(text, '!\[.*?\]\(.+?\)')) > 0 OR len(regexp_extract_all(text, '(?m)^#{{1,6}}[ \t]+.+$')) > 5 THEN 'Enrich' ELSE 'Rewrite' END AS strategy FROM documents""")
def rewrite_strategy(docs):
    text, none = F.col("text"), F.lit(0.0)
    quality = Q.overall_score(Q.has_paywall(text, text), Q.requires_login(text, text), none, F.lit(1.0), T.word_count(text), F.lit(0), F.lit(False))
    return docs.select("doc_id", enrich.choose(F.length("text"), F.round(quality, 9), F.size(T.markdown_images(text)), F.size(T.markdown_headings(text))).alias("strategy"))


@query("documents", r"""SELECT doc_id, len(regexp_extract_all(text, '(?m)^>'))::BIGINT AS quotes, len(regexp_extract_all(text, '(?m)^[ \t]*(?:[-*+]|\d+\.)[ \t]+\S'))::BIGINT AS list_items, len(string_split(text, E'\n'))::BIGINT AS lines, length(text)::BIGINT AS characters FROM documents""")
def markdown_counts(docs):
    parts, counts = structure.elements(F.col("text")), structure.text_statistics(F.col("text"))
    return docs.select("doc_id", parts["quotes"].alias("quotes"), parts["list_items"].alias("list_items"), counts["lines"].alias("lines"), counts["characters"].alias("characters"))


@query("pages", f"""WITH s AS (SELECT {_NORM.format('url')} AS k, first(html ORDER BY url, html) AS html FROM pages GROUP BY 1)
   SELECT page_id, 200 AS status, NULL::VARCHAR AS error_code, length(s.html)::BIGINT AS chars FROM pages JOIN s ON s.k = {_NORM.format('url')}""")
def fetch_urls(pages):
    """Every URL of the table joined with the table as a store; cases cover misses."""
    got = fetch(pages.select("page_id", "url"), pages.select("url", "html"))
    return got.select("page_id", "status", "error_code", F.length("html").cast("long").alias("chars"))


# Statistics of crawls, policies, limits and scores


@query("events", """SELECT count(*)::BIGINT AS total, count(*) FILTER (event_type <> 'error')::BIGINT AS succeeded, count(*) FILTER (event_type = 'error')::BIGINT AS failed, round(avg(value), 4) AS mean_ms,
   sum(length(props))::BIGINT AS bytes, count(DISTINCT user_id)::BIGINT AS domains, round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 9) AS per_second FROM events""")
def crawl_statistics(events):
    rows = events.select(F.col("user_id").alias("domain"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("ms"), F.length("props").alias("bytes"), F.col("ts").cast("timestamp").alias("at"))
    return stats.crawl_statistics(rows).withColumns({"mean_ms": F.round("mean_ms", 4), "per_second": F.round("per_second", 9)})


@query("events", """SELECT count(*)::BIGINT AS total, count(*) FILTER (event_type = 'purchase')::BIGINT AS succeeded, count(*) FILTER (event_type = 'error')::BIGINT AS failed, count(*) FILTER (event_type = 'click')::BIGINT AS retries,
   count(*) FILTER (event_type = 'signup')::BIGINT AS breaker_openings, count(*) FILTER (event_type = 'view')::BIGINT AS timeouts, 0::BIGINT AS rejections, round(avg(value), 4) AS mean_ms FROM events""")
def resilience_statistics(events):
    kinds = F.create_map(*[F.lit(x) for x in ("purchase", "Success", "error", "Failure", "click", "Retry", "signup", "CircuitBreakerOpened", "view", "Timeout")])
    rows = events.select(F.try_element_at(kinds, F.col("event_type")).alias("kind"), F.col("value").alias("ms"))
    return stats.resilience_statistics(rows).withColumn("mean_ms", F.round("mean_ms", 4))


@query("events", """SELECT user_id, count(*)::BIGINT AS requests, count(*) FILTER (w > 0)::BIGINT AS delayed, sum(w)::BIGINT AS wait_ms, round(avg(w), 4) AS mean_wait_ms
   FROM (SELECT user_id, greatest(round(value)::BIGINT - 50, 0) AS w FROM events) GROUP BY user_id""")
def limiter_statistics(events):
    rows = events.select("user_id", F.greatest(F.round("value").cast("long") - 50, F.lit(0)).alias("w"))
    return stats.limiter_statistics(rows, "user_id", "w").withColumn("mean_wait_ms", F.round("mean_wait_ms", 4))


@query("events", """SELECT event_type AS category, round(sum(value), 4) AS score, count(*)::BIGINT AS parts FROM events GROUP BY 1""")
def score_by_category(events):
    return stats.sum_by_category(events, "event_type", "value").select(F.col("event_type").alias("category"), F.round("score", 4).alias("score"), "parts")


@query("events", """SELECT event_id, strftime(ts, '%H:%M:%S') BETWEEN '08:00:00' AND '18:30:00' AS in_hours, ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 36 HOUR AS old FROM events""")
def time_windows(events):
    at, now = F.col("ts").cast("timestamp"), F.lit("2024-01-15 00:00:00").cast("timestamp")
    old = stats.older_than(events.select("event_id", at.alias("ts")), "ts", now, 36).select("event_id", F.lit(True).alias("old"))
    marked = events.select("event_id", stats.within_hours(at, "08:00:00", "18:30:00").alias("in_hours")).join(old, "event_id", "left")
    return marked.withColumn("old", F.coalesce("old", F.lit(False)))


@query("documents", r"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE round(len(regexp_extract_all(text, '[^ \t\n\r\f\v]'))::DOUBLE / length(text), 6) END AS visible_share, floor(doc_id % 97 / 97.0 * 100)::INT || '%' AS percent,
   list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda w: w <> '' AND NOT list_contains(['the', 'and', 'der', 'und'], w))))[1] AS first_word FROM documents""")
def text_marks(docs):
    """Share of visible characters, a percentage as text, and words without some others: a set difference."""
    left = F.array_except(F.transform(T.words(F.col("text")), F.lower), F.array(*map(F.lit, ("the", "and", "der", "und"))))
    return docs.select(
        "doc_id", F.round(T.visible_share(F.col("text")), 6).alias("visible_share"), T.percent(F.col("doc_id") % 97 / 97.0).alias("percent"),
        F.get(F.array_sort(left, lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(0)).alias("first_word"),
    )


# Operators without an SQL form


@query("pages")
def html_extract(pages):
    return extract.extract_pages(pages).select("page_id", "title", "raw_markdown", "fit_markdown", "word_count", "reading_minutes", "description")


@query("pages")
def density_filter(pages):
    return extract.density_scores(pages, "page_id")


@query("pages")
def chunk_dom(pages):
    return chunking.chunk(pages, "DomStructure")


def _documents_as_pages(docs):
    return docs.select(F.col("doc_id").cast("string").alias("url"), "text")


def _chunk_columns(chunks):
    return chunks.select("source_url", "sequence_number", "content", "section_title", "chunk_id")


def _chunk_sql(pieces: str, strategy: str) -> str:
    """SQL over ``pieces`` (doc_id, seq, content, title)."""
    return f"""SELECT doc_id::VARCHAR AS source_url, seq AS sequence_number, content, title AS section_title, sha256(doc_id || '|{strategy}|' || seq) AS chunk_id FROM ({pieces})"""


_PARTS = _packed_sql("SELECT doc_id AS id, text FROM documents", 1792)


_FIXED_PIECES = f"""SELECT id AS doc_id, seq, NULL::VARCHAR AS title, CASE WHEN seq = 0 THEN content
   ELSE ltrim(regexp_extract(right(lag(content) OVER (PARTITION BY id ORDER BY seq), 256), '(?s)\\s(.*)$', 1) || ' ' || content, ' ') END AS content FROM {_PARTS}"""


@query("documents", _chunk_sql(_FIXED_PIECES, "FixedSize"))
def chunk_fixed(docs):
    return _chunk_columns(chunking.chunk(_documents_as_pages(docs), "FixedSize"))


def _cut_sql(sections: str) -> str:
    """SQL over ``sections`` (id, text): (id, seq, content), those of more than 2,048 characters packed."""
    return f"""SELECT id, 0::BIGINT AS seq, text AS content FROM ({sections}) WHERE length(text) BETWEEN 1 AND 2048
     UNION ALL SELECT * FROM {_packed_sql(f"SELECT * FROM ({sections}) WHERE length(text) > 2048", 2048)}"""


_WHOLE = "SELECT doc_id AS id, trim(text, E' \\n\\t\\r') AS text FROM documents"


_PARAGRAPH_PIECES = f"SELECT id AS doc_id, seq, NULL::VARCHAR AS title, content FROM ({_cut_sql(_WHOLE)})"


@query("documents", _chunk_sql(_PARAGRAPH_PIECES, "Paragraph"))
def chunk_paragraph(docs):
    """The test documents have no blank lines, so the SQL has one paragraph each; cases cover several."""
    return _chunk_columns(chunking.chunk(_documents_as_pages(docs), "Paragraph"))


_SECTIONS = r"""SELECT (doc_id, section) AS id, trim(string_agg(line, E'\n' ORDER BY k), E' \n\t\r') AS text FROM (
   SELECT doc_id, k, line, sum((k = 1 OR has AND (starts_with(bare, '#') OR starts_with(bare, '<h') OR length(bare) BETWEEN 1 AND 99 AND NOT contains(bare, '.')))::INT) OVER (PARTITION BY doc_id ORDER BY k) AS section
   FROM (SELECT *, trim(line, E' \n\t\r') AS bare FROM (SELECT doc_id, regexp_matches(text, '(?m)^#{1,6}[ \t]+.+$') AS has, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS k FROM documents)))
   GROUP BY doc_id, section"""


_SMART_PIECES = f"""SELECT id[1] AS doc_id, row_number() OVER (PARTITION BY id[1] ORDER BY id[2], seq) - 1 AS seq, content, nullif(title, '') AS title
   FROM (SELECT c.id, seq, content, regexp_extract(text, '^#{{1,6}}\\s+([^\\n]+)', 1) AS title FROM ({_cut_sql(_SECTIONS)}) c JOIN ({_SECTIONS}) t ON c.id = t.id)"""


@query("documents", _chunk_sql(_SMART_PIECES, "Smart"))
def chunk_smart(docs):
    return _chunk_columns(chunking.chunk(_documents_as_pages(docs), "Smart"))


@query("documents", """WITH s AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[.!?]'), lambda x: x <> '') AS ss, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM documents),
   p AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(ss[k]), '[ \\t\\n]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(ss[k + 1]), '[ \\t\\n]+'), lambda x: x <> '')) AS b
     FROM (SELECT doc_id, ss, unnest(range(1, len(ss))) AS k FROM s)),
   c AS (SELECT doc_id, avg(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END) AS cohesion FROM p GROUP BY doc_id)
   SELECT s.doc_id, round(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]'))::DOUBLE / length(text), 6) AS text_density, round(coalesce(cohesion, 1.0), 6) AS semantic_cohesion,
     round(CASE WHEN len(ss) = 0 OR len(ws) = 0 THEN 0.0 ELSE greatest(0.0, 1 - (len(ws)::DOUBLE / len(ss) * 0.1 + list_sum(list_transform(ws, lambda w: length(w)))::DOUBLE / len(ws) * 0.2) / 20.0) END, 6) AS readability
   FROM s LEFT JOIN c USING (doc_id)""")
def content_metrics(docs):
    made = docs.select("doc_id", strategy.content_metrics(F.col("text"), F.lit(0)).alias("m"))
    return made.select("doc_id", *[F.round(f"m.{c}", 6).alias(c) for c in ("text_density", "semantic_cohesion", "readability")])


@query("documents")
def chunk_semantic(docs):
    return chunking.semantic(_documents_as_pages(docs), chunking.hash_embedder)


@query("pages")
def metadata_full(pages):
    made = metadata.describe(pages)
    return made.select("page_id", "basic.title", "basic.charset", F.col("structure.words").alias("words"), F.col("accessibility.score").alias("accessibility"), F.round("quality_score", 6).alias("quality_score"), F.array_join("missing", ",").alias("missing"))


@query("documents")
def markdown_structure(docs):
    return docs.select("doc_id", *[v.alias(k) for k, v in structure.elements(F.col("text")).items()])


_SAME_HOST = f"lower(regexp_extract(link, {_ABS}, 2)) = {_HOST.replace('url', 'start')} AND lower(regexp_extract(regexp_extract(link, {_ABS}, 4), '\\.[^./]+$')) NOT IN ({', '.join(f"'{e}'" for e in _EXTENSIONS)})"


@query("pages", "WITH RECURSIVE " + _LINKS.replace("\nWITH r AS", "r AS", 1) + f""",
   k AS (SELECT {_NORM.format('url')} AS key, min(url) AS url FROM pages GROUP BY 1),
   e AS (SELECT DISTINCT {_NORM.format('url')} AS source, url AS page, link, {_NORM.format('link')} AS key FROM a WHERE regexp_matches(link, '(?i)^https?://')),
   c AS (SELECT url AS start, {_NORM.format('url')} AS key, 0 AS depth FROM pages
     UNION SELECT start, e.key, depth + 1 FROM c JOIN k ON k.key = c.key JOIN e ON e.source = c.key AND e.page = k.url WHERE depth < 3 AND {_SAME_HOST})
   SELECT start, min(depth) AS depth, k.url, (SELECT count(*) FROM pages p WHERE p.url = start)::BIGINT AS copies FROM c JOIN k USING (key) GROUP BY start, key, k.url""")
def crawl_site(pages):
    """Breadth-first crawl from every page, to the default depth and with no cap: level 0 is the table itself."""
    order = crawl.crawl_order(pages, pages.select("url"))
    return order.groupBy("start", "url").agg(F.min("depth").alias("depth"), F.count(F.lit(1)).alias("copies")).select("start", "depth", "url", "copies")
