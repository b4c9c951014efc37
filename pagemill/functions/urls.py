"""URL and link functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
HREF = r"(?i)href\s*=\s*[\"']([^\"']*)[\"']"
#: File types that a crawl leaves out.
EXCLUDED_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".svg", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".tar",
    ".gz", ".7z", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".css", ".js", ".woff", ".woff2", ".ttf", ".eot",
)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, ABSOLUTE, group)


def is_absolute(url: Column) -> Column:
    return F.coalesce(url.rlike(ABSOLUTE), F.lit(False))


def is_http(url: Column) -> Column:
    return is_absolute(url) & F.lower(_part(url, 1)).isin("http", "https")


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def normalize(url: Column) -> Column:
    """Canonical form: lower scheme and host, no ``www.``, default port, trailing or double slash, or fragment.

    Values that aren't absolute are returned as they are.
    """
    scheme = F.lower(_part(url, 1))
    bare = F.regexp_replace(host(url), r"^www\.", "")
    port = _part(url, 3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.when(_part(url, 4) == "", "/").otherwise(_part(url, 4))
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    path = F.regexp_replace(path, "//+", "/")
    built = F.concat(scheme, F.lit("://"), bare, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, _part(url, 5))
    return F.when(is_absolute(url), built).otherwise(url)


def equivalent(a: Column, b: Column) -> Column:
    return normalize(a).eqNullSafe(normalize(b))


def domain_key(url: Column) -> Column:
    """Lower-case host, or the lower-case input where there is none."""
    return F.when(is_absolute(url), host(url)).otherwise(F.lower(url))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(_part(url, 4), r"\.[^./]+$", 0))


def site_root(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of a link on a page; ``.`` and ``..`` segments are folded."""
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(bare.rlike(r"^[^:]+://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, "[^/]*$", ""))
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site_root(base), link))
        .when(F.startswith(link, F.lit("?")), F.concat(bare, link))
        .otherwise(F.concat(folder, link))
    )
    root, tail = site_root(full), F.regexp_extract(full, r"[?#].*$", 0)
    path = F.regexp_replace(F.substring(full, F.length(root) + 1, F.length(full)), r"[?#].*$", "")
    steps = F.split(path, "/")
    folded = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    dotted = path.rlike(r"(^|/)\.{1,2}(/|$)")
    return F.when(dotted, F.concat(root, F.array_join(folded, "/"), tail)).otherwise(full)


def extract_links(html: Column, base: Column) -> Column:
    """Absolute http(s) targets of all href attributes, in order, repeats kept."""
    raw = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    wanted = F.filter(raw, lambda x: ~(x.rlike(r"(?i)^(javascript|mailto|tel):") | x.rlike(r"^\s*$") | F.startswith(x, F.lit("#"))))
    return F.filter(F.transform(wanted, lambda x: resolve(base, x)), is_http)


def should_crawl(url: Column, start: Column, include: list[str] = (), exclude: list[str] = (), excluded: list[str] = EXCLUDED_EXTENSIONS) -> Column:
    """Same-host http(s) pages of wanted kinds; patterns are regular expressions, any case."""
    ok = is_http(url) & (host(url) == host(start)) & ~extension(url).isin(*excluded)
    if include:
        ok = ok & F.greatest(*[url.rlike(f"(?i){p}") for p in include], F.lit(False))
    for pattern in exclude:
        ok = ok & ~url.rlike(f"(?i){pattern}")
    return ok


def srcset_best(srcset: Column) -> Column:
    """The widest candidate of a srcset: by ``w``, or a density counted as a thousand."""
    parts = F.transform(F.split(srcset, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    scored = F.transform(
        F.filter(parts, lambda x: x != ""),
        lambda x: F.struct(
            F.coalesce(
                F.regexp_extract(x, r"\s([0-9.]+)w$", 1).try_cast("double"),
                F.regexp_extract(x, r"\s([0-9.]+)x$", 1).try_cast("double") * 1000,
                F.lit(0.0),
            ).alias("width"),
            F.regexp_extract(x, r"^\S+", 0).alias("url"),
        ),
    )
    return F.aggregate(
        scored, F.struct(F.lit(-1.0).alias("width"), F.lit(None).cast("string").alias("url")),
        lambda best, x: F.when(x["width"] > best["width"], x).otherwise(best), lambda best: best["url"],
    )


def related_pages(html: Column, url: Column, most: int = 20) -> Column:
    """Distinct other paths of the same host that a page links to, the first ``most``."""
    links = F.filter(extract_links(html, url), lambda x: (host(x) == host(url)) & (_part(x, 4) != _part(url, 4)))
    return F.slice(F.array_distinct(F.transform(links, lambda x: _part(x, 4))), 1, most)


def sitemap_locs(xml: Column) -> Column:
    """Locations of a sitemap or sitemap index, index entries first, by XML; by pattern only where it isn't well formed."""
    blank = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    entries = lambda tag: F.xpath(xml, F.lit(f"//*[local-name()='{tag}']/*[local-name()='loc']/text()"))
    known = F.from_xml(xml, F.lit("_corrupt_record string"), {"mode": "PERMISSIVE"})
    formed = known.isNotNull() & known["_corrupt_record"].isNull() & (blank(xml) != "")
    by_xml = F.concat(entries("sitemap"), entries("url"))
    inside = lambda tag: F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}>(?:(?!</{tag}>).)*?<loc>([^<]+)</loc>"), F.lit(1))
    found = F.concat(inside("sitemap"), inside("url"))
    plain = F.regexp_extract_all(xml, F.lit("<loc>([^<]+)</loc>"), F.lit(1))
    chosen = F.when(formed, by_xml).when(F.size(found) > 0, found).otherwise(plain)
    return F.filter(F.transform(chosen, blank), lambda x: x != "")
