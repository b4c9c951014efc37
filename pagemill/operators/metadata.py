"""Page metadata as Spark columns: meta tags, Open Graph, Twitter cards, JSON-LD, structure and scores.

A page is searched once for its meta tags and once for its links; fields are looked up in those
short arrays.  Structure and accessibility count tags by pattern.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.batches import by_slices
from pagemill.functions.text import HAN, HANGUL, KANA, let, none_if_blank, strip_tags, title_of, trim_all, word_count

_QUOTED = r"[\"']([^\"']*)[\"']"


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, quoted or not; null where it has none."""
    found = rf"(?is)[\s\"'/](?:{name})\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.when(tag.rlike(found), F.concat(*[F.regexp_extract(tag, found, k) for k in (1, 2, 3)]))


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?is)[\s\"'/](?:{name})(?:[\s=/>]|$)")


def tags(html: Column, names: str) -> Column:
    """The opening tags of a name, in order; quoted attribute values may hold ``>``."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{names})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"), F.lit(0))


def meta_tags(html: Column) -> Column:
    """(key, content) of each meta tag that has both: its name, property or charset, lower-cased."""
    each = F.transform(
        tags(html, "meta"),
        lambda t: F.struct(
            F.lower(F.coalesce(attribute(t, "name"), attribute(t, "property"), F.when(attribute(t, "charset").isNotNull(), "charset"))).alias("key"),
            F.coalesce(attribute(t, "content"), attribute(t, "charset")).alias("content"),
        ),
    )
    return F.filter(each, lambda m: m["key"].isNotNull() & (trim_all(m["content"]) != ""))


def link_tags(html: Column) -> Column:
    """(rel, type, href) of each link tag with an address."""
    each = F.transform(
        tags(html, "link"), lambda t: F.struct(F.lower(attribute(t, "rel")).alias("rel"), F.lower(attribute(t, "type")).alias("type"), attribute(t, "href").alias("href"))
    )
    return F.filter(each, lambda x: x["href"] != "")


def meta(metas: Column, name: str) -> Column:
    """Content of the first meta tag of a name; null where there is none."""
    return F.get(F.filter(metas, lambda m: m["key"] == name.lower()), F.lit(0))["content"]


def link(links: Column, rel: str) -> Column:
    return F.get(F.filter(links, lambda x: x["rel"] == rel), F.lit(0))["href"]


def tag_count(html: Column, names: str) -> Column:
    return F.coalesce(F.regexp_count(html, F.lit(rf"(?i)<(?:{names})[\s/>]")), F.lit(0)).cast("long")


def listed(text: Column) -> Column:
    """Parts between commas, trimmed; blank ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), trim_all), lambda x: x != "")


def basic(html: Column, metas: Column, links: Column) -> Column:
    alternates = F.filter(F.transform(tags(html, "link"), lambda t: F.struct(attribute(t, "hreflang").alias("language"), attribute(t, "href").alias("href"))), lambda x: x["language"].isNotNull())
    return F.struct(
        none_if_blank(title_of(html, "")).alias("title"), meta(metas, "description").alias("description"), listed(meta(metas, "keywords")).alias("keywords"),
        meta(metas, "author").alias("author"), meta(metas, "robots").alias("robots"), meta(metas, "viewport").alias("viewport"), meta(metas, "theme-color").alias("theme_color"),
        F.coalesce(meta(metas, "charset"), none_if_blank(F.regexp_extract(html, r"(?is)<meta[^>]*charset\s*=\s*[\"']?([\w-]+)", 1))).alias("charset"),
        link(links, "canonical").alias("canonical"), none_if_blank(F.regexp_extract(html, r"(?is)<html[^>]*\blang\s*=\s*[\"']([^\"']*)[\"']", 1)).alias("language"),
        alternates.alias("alternates"),
        F.coalesce(meta(metas, "article:published_time"), meta(metas, "date")).try_cast("timestamp").alias("published"),
        F.coalesce(meta(metas, "article:modified_time"), meta(metas, "last-modified")).try_cast("timestamp").alias("modified"),
    )


def _group(metas: Column, prefix: str, names: tuple[str, ...]) -> Column:
    return F.struct(*[meta(metas, f"{prefix}{n}").alias(n.replace(":", "_").lower()) for n in names])


def open_graph(metas: Column) -> Column:
    return _group(metas, "og:", ("title", "description", "type", "url", "image", "site_name", "locale", "video", "audio", "determiner", "image:width", "image:height"))


def twitter(metas: Column) -> Column:
    return _group(metas, "twitter:", ("card", "site", "creator", "title", "description", "image", "image:alt", "player", "player:width", "player:height"))


def dublin_core(metas: Column) -> Column:
    return _group(metas, "DC.", ("title", "creator", "subject", "description", "publisher", "contributor", "date", "type", "format", "language", "rights"))


# JSON-LD


def ld_scripts(html: Column) -> Column:
    """Texts of the page's JSON-LD scripts that aren't blank."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(F.transform(found, trim_all), lambda x: x != "")


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def named(v: Column, field: str) -> Column:
    """A field that is a text, or an object with a name."""
    inner = F.try_variant_get(v, f"$.{field}.name", "string")
    plain = _field(v, field)
    return F.coalesce(inner, F.when(~F.startswith(F.ltrim(plain), F.lit("{")), plain))


def keywords_of(v: Column) -> Column:
    """A field that is a text with commas or an array of texts."""
    many = F.filter(F.try_variant_get(v, "$.keywords", "array<string>"), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(many, listed(_field(v, "keywords")))


#: The entity that each type is read as, and that entity's fields.
LD_KINDS = {
    "organization": "organization", "person": "person", "article": "article", "blogposting": "article", "newsarticle": "article",
    "softwareapplication": "software", "softwarelibrary": "software", "product": "product", "website": "website",
}
LD_FIELDS = {
    "organization": ("name", "url", "logo", "description"), "person": ("name", "url", "image", "jobTitle"),
    "software": ("name", "version", "programmingLanguage", "runtimePlatform", "license", "codeRepository"), "website": ("name", "url"),
}


def ld_entity(v: Column) -> Column:
    """Type, kind and the fields of the kind, as a struct of structs; those of other kinds are null."""
    own = F.try_variant_get(v, "$['@type']", "string")
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in LD_KINDS.items() for x in pair]), F.lower(own))
    only = lambda name, fields: F.when(found == name, F.struct(*fields)).alias(name)
    date = lambda name: _field(v, name).try_cast("timestamp")
    return F.struct(
        own.alias("type"),
        found.alias("kind"),
        *[only(name, [_field(v, f).alias(f) for f in fields]) for name, fields in LD_FIELDS.items()],
        only(
            "article",
            [
                _field(v, "headline").alias("headline"), date("datePublished").alias("published"), date("dateModified").alias("modified"), named(v, "author").alias("author"),
                named(v, "publisher").alias("publisher"), _field(v, "articleSection").alias("section"), keywords_of(v).alias("keywords"),
            ],
        ),
        only("product", [_field(v, "name").alias("name"), named(v, "brand").alias("brand"), _field(v, "category").alias("category")]),
    )


def ld_entities(html: Column) -> Column:
    """The entity of each script that can be read as an object."""
    parsed = F.filter(F.transform(ld_scripts(html), lambda x: F.try_parse_json(x)), lambda v: v.isNotNull())
    return F.transform(parsed, ld_entity)


def json_ld(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, place, type, kind, and a struct for each kind) of each JSON-LD script that can be read."""
    found = pages.select(key, F.posexplode(ld_entities(F.col(html))).alias("place", "entity"))
    return found.select(key, "place", "entity.*")


# Structure


def visible(html: Column) -> Column:
    return strip_tags(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), " ")


def complexity(shape: dict[str, Column]) -> Column:
    """Weighted and capped counts of a page's parts, one at most."""
    #: Weight and cap of each part.
    parts = {"headings": (0.1, 1.0), "paragraphs": (0.01, 0.5), "links": (0.005, 0.3), "images": (0.02, 0.4), "tables": (0.05, 0.3), "code_blocks": (0.1, 0.5)}
    return F.least(F.lit(1.0), sum((F.least(shape[name] * weight, F.lit(cap)) for name, (weight, cap) in parts.items()), F.lit(0.0)))


def structure(html: Column) -> Column:
    count = word_count(visible(html))
    shape = {name: tag_count(html, names) for name, names in {"headings": "h[1-6]", "sections": "section", "paragraphs": "p", "images": "img", "tables": "table", "lists": "ul|ol", "code_blocks": "pre|code"}.items()}
    shape["links"] = F.size(F.filter(tags(html, "a"), lambda t: has_attribute(t, "href"))).cast("long")
    return F.struct(
        *[v.alias(k) for k, v in shape.items()], count.alias("words"), F.ceil(count / 250.0).cast("long").alias("reading_minutes"), complexity(shape).alias("complexity")
    )


def technical(html: Column, url: Column, metas: Column | None = None, links: Column | None = None) -> Column:
    metas = meta_tags(html) if metas is None else metas
    links = link_tags(html) if links is None else links
    scripts = F.exists(
        F.transform(tags(html, "script"), lambda t: attribute(t, "type")), lambda kind: F.coalesce(kind.isin("text/javascript", "application/javascript"), F.lit(True))
    )
    linked = lambda rel: F.exists(links, lambda x: F.coalesce(x["rel"] == rel, F.lit(False)))
    return F.struct(
        F.coalesce(F.startswith(F.lower(url), F.lit("https://")), F.lit(False)).alias("https"), scripts.alias("needs_javascript"),
        meta(metas, "viewport").isNotNull().alias("has_viewport"), linked("manifest").alias("has_manifest"),
        (F.lower(html).rlike(r"<html[^>]*\samp[\s>=]") | linked("amphtml")).alias("is_amp"),
    )


def accessibility(html: Column) -> Column:
    images = tags(html, "img")
    described = F.size(F.filter(images, lambda t: has_attribute(t, "alt")))
    coverage = F.when(F.size(images) == 0, 1.0).otherwise(described / F.size(images))
    levels = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])[\s/>]"), F.lit(1)), lambda x: x.cast("int"))
    jumps = F.exists(F.zip_with(levels, F.slice(levels, F.lit(2), F.size(levels)), lambda a, b: b > a + 1), lambda x: F.coalesce(x, F.lit(False)))
    ordered = (F.size(levels) > 0) & F.coalesce(F.get(levels, F.lit(0)) == 1, F.lit(False)) & ~jumps
    skip = F.exists(
        tags(html, "a"),
        lambda t: F.contains(F.coalesce(attribute(t, "class"), F.lit("")), F.lit("skip")) | F.coalesce(attribute(t, "href"), F.lit("")).rlike("#main|#content"),
    )
    aria = html.rlike(r"(?i)<[a-z][^>]*\saria-(?:label|labelledby|describedby)[\s=/>]")
    score = F.floor(40 * coverage) + F.when(ordered, 25).otherwise(0) + F.when(skip, 15).otherwise(0) + F.when(aria, 20).otherwise(0)
    return F.struct(coverage.alias("alt_coverage"), ordered.alias("ordered_headings"), skip.alias("skip_link"), aria.alias("aria"), score.cast("long").alias("score"))


def language(html: Column, text: Column, header: Column | None = None) -> Column:
    """(language, method): the html attribute, the header, then the script with the largest share over 5 %, else English."""
    own = none_if_blank(F.regexp_extract(html, r"(?is)<html[^>]*\blang\s*=\s*[\"']([^\"']*)[\"']", 1))
    header = F.lit(None).cast("string") if header is None else none_if_blank(header)
    share = lambda p: F.regexp_count(text, F.lit(p)) / F.greatest(F.length(text), F.lit(1))
    shares = F.array_max(F.array(*[F.struct(share(p).alias("share"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, p) in enumerate((("ko", HANGUL), ("ja", KANA), ("zh", HAN)))]))
    chosen = F.coalesce(own, header, F.when(shares["share"] > 0.05, shares["name"]), F.lit("en"))
    method = F.when(own.isNotNull(), "html").when(header.isNotNull(), "header").otherwise("characters")
    short = F.lower(F.regexp_extract(trim_all(chosen), "^[^-_]*", 0))
    return F.struct(F.when(F.length(short) == 2, short).otherwise(F.lower(chosen)).alias("language"), method.alias("method"))


# Scores


def _filled(weights: dict[str, float], value) -> Column:
    """Sum of the weights of the fields that aren't empty, one at most."""
    return F.least(F.lit(1.0), sum((F.when(value(name), w).otherwise(0.0) for name, w in weights.items()), F.lit(0.0)))


def scores(b: Column, og: Column, cards: Column, shape: Column, tech: Column, access: Column, entities: Column, breadcrumbs: Column, scripts: Column) -> dict[str, Column]:
    """Part scores, their weighted whole, completeness, what is missing and what to do."""
    held = lambda s: lambda name: s[name].isNotNull() if name != "keywords" else F.size(s[name]) > 0
    kinds = F.transform(entities, lambda e: e["kind"])
    has = lambda kind: F.array_contains(kinds, kind)
    #: Weights of the fields and of the parts.
    parts = {
        "basic": _filled({"title": 0.3, "description": 0.3, "keywords": 0.1, "author": 0.1, "language": 0.1, "canonical": 0.1}, held(b)),
        "open_graph": _filled({"title": 0.25, "description": 0.25, "image": 0.25, "url": 0.15, "type": 0.1}, held(og)),
        "twitter": _filled({"card": 0.25, "title": 0.25, "description": 0.25, "image": 0.25}, held(cards)),
        "schema": _filled(
            {"type": 0.3, "organization": 0.2, "article": 0.2, "person": 0.1, "breadcrumbs": 0.1, "scripts": 0.1},
            lambda name: {"type": F.exists(entities, lambda e: F.coalesce(e["type"], F.lit("")) != ""), "breadcrumbs": F.size(breadcrumbs) > 0, "scripts": F.size(scripts) > 0}.get(name, has(name)),
        ),
        "structure": _filled(
            {"headings": 0.3, "complexity": 0.3, "reading_minutes": 0.2, "links": 0.2}, lambda name: shape[name] > (0.3 if name == "complexity" else 0)
        ),
        "technical": _filled({"https": 0.3, "has_viewport": 0.3, "needs_javascript": 0.2, "has_manifest": 0.2}, lambda name: ~tech[name] if name == "needs_javascript" else tech[name]),
        "accessibility": access["score"] / 100.0,
    }
    weights = {"basic": 0.25, "open_graph": 0.20, "schema": 0.20, "structure": 0.15, "technical": 0.10, "accessibility": 0.10}
    whole = sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))
    complete = (parts["basic"] + parts["open_graph"] + parts["twitter"] + parts["schema"]) / 4.0
    missing = F.array_compact(F.array(F.when(b["title"].isNull(), "title"), F.when(b["description"].isNull(), "description"), F.when(og["image"].isNull(), "og:image")))
    advice = F.array_compact(
        F.array(
            F.when(parts["basic"] < 0.8, "improve the basic metadata (title, description, keywords)"), F.when(parts["open_graph"] < 0.6, "add Open Graph metadata"),
            F.when(parts["schema"] < 0.5, "add structured data of schema.org"),
        )
    )
    return {**{f"{k}_score": v for k, v in parts.items()}, "quality_score": whole, "completeness": complete, "missing": missing, "recommendations": advice}


def describe(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with a struct for each group of metadata, and the scores."""
    page = F.coalesce(F.col(html), F.lit(""))
    found = pages.withColumns({"metas": meta_tags(page), "links": link_tags(page), "scripts": ld_scripts(page), "entities": ld_entities(page)})
    metas, links = F.col("metas"), F.col("links")
    made = found.withColumns(
        {
            "basic": basic(page, metas, links), "open_graph": open_graph(metas), "twitter": twitter(metas), "dublin_core": dublin_core(metas), "structure": structure(page),
            "technical": technical(page, F.col(url), metas, links), "accessibility": accessibility(page), "language": language(page, page),
            "breadcrumbs": breadcrumbs(page), "classification": classification(page, metas),
        }
    )
    names = ("basic", "open_graph", "twitter", "structure", "technical", "accessibility", "entities", "breadcrumbs", "scripts")
    return made.withColumns(scores(*[F.col(c) for c in names])).drop("metas", "links", "scripts")


# Site context


def _between(html: Column, names: str, mark: str) -> Column:
    """Inner markup of the elements of some names whose class holds a word."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<({names})\b[^>]*\bclass\s*=\s*[\"'][^\"']*{mark}[^\"']*[\"'][^>]*>(.*?)</\1>"), F.lit(2))


def _anchors(markup: Column) -> Column:
    """(text, url) of each link."""
    found = F.regexp_extract_all(markup, F.lit(r"(?is)<a(?=[\s>])[^>]*>.*?</a>"), F.lit(0))
    return F.transform(found, lambda t: F.struct(trim_all(strip_tags(t)).alias("text"), F.coalesce(attribute(t, "href"), F.lit("")).alias("url")))


def breadcrumbs(html: Column) -> Column:
    """(text, url) of the links in a breadcrumb bar or list."""
    return F.flatten(F.transform(_between(html, "nav|ol", "breadcrumb"), _anchors))


def site_context(html: Column, url: Column, links: Column | None = None) -> Column:
    """Breadcrumbs (structured data by position first, else the breadcrumb bar), previous, next, feed and language variants."""
    script = F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>((?:(?!</script>).)*?BreadcrumbList.*?)</script>", 1)
    items = F.from_json(
        F.regexp_extract(script, r"(?s)\"itemListElement\"\s*:\s*(\[.*\])", 1), "array<struct<position:int,name:string,item:string>>"
    )
    marked = F.transform(F.array_sort(items), lambda x: F.struct(x["name"].alias("text"), F.coalesce(x["item"], F.lit("")).alias("url")))
    links = link_tags(html) if links is None else links
    feed = F.get(F.filter(links, lambda x: x["type"].isin("application/rss+xml", "application/atom+xml")), F.lit(0))["href"]
    variants = F.filter(F.transform(tags(html, "link"), lambda t: attribute(t, "hreflang")), lambda x: x.isNotNull())
    return F.struct(
        F.when(F.size(marked) > 0, marked).otherwise(breadcrumbs(html)).alias("breadcrumbs"),
        link(links, "prev").alias("previous"), link(links, "next").alias("next"), feed.alias("feed"), F.array_distinct(variants).alias("variants"),
    )


def navigation(html: Column, links: Column | None = None) -> Column:
    """Links of each region of a page, in order, repeats kept; related links, sitemap and feed."""
    inside = lambda *names: F.filter(
        F.flatten(F.array(*[F.flatten(F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{n}\b[^>]*>(.*?)</{n}>"), F.lit(1)), _anchors)) for n in names])), lambda x: x["url"] != ""
    )
    anchors = tags(html, "a")
    with_class = lambda word: F.filter(anchors, lambda t: F.contains(F.coalesce(attribute(t, "class"), F.lit("")), F.lit(word)))
    addresses = lambda found: F.filter(F.transform(found, lambda t: attribute(t, "href")), lambda x: F.coalesce(x, F.lit("")) != "")
    feed = F.filter(link_tags(html) if links is None else links, lambda x: x["type"] == "application/rss+xml")
    return F.struct(
        inside("header").alias("header"), inside("nav").alias("nav"), inside("aside").alias("aside"), inside("footer").alias("footer"),
        addresses(with_class("related")).alias("related"), F.get(addresses(with_class("home")), F.lit(0)).alias("home"),
        F.get(F.filter(addresses(anchors), lambda x: F.contains(x, F.lit("sitemap"))), F.lit(0)).alias("sitemap"), F.get(feed, F.lit(0))["href"].alias("feed"),
    )


def classification(html: Column, metas: Column) -> Column:
    """Kind of page (article, product, documentation or web page), its categories and tags."""

    def by_class(classes: Column) -> Column:
        has = lambda words: F.exists(classes, lambda c: c.rlike(words))
        return F.when(has("product|item"), "Product").when(has("documentation|docs") | (tag_count(html, "pre|code") > 5), "Documentation").otherwise("Webpage")

    article = html.rlike(r"(?i)<article[\s/>]") | F.contains(F.coalesce(meta(metas, "og:type"), F.lit("")), F.lit("article"))
    kind = F.when(article, "Article").otherwise(let(F.transform(tags(html, "div"), lambda t: F.coalesce(attribute(t, "class"), F.lit(""))), by_class))
    marked = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?is)<a(?=[\s>])[^>]*>.*?</a>"), F.lit(0)),
        lambda t: F.contains(F.coalesce(attribute(t, "class"), F.lit("")), F.lit("tag")) | F.contains(F.coalesce(attribute(t, "rel"), F.lit("")), F.lit("tag")),
    )
    linked = F.filter(F.transform(marked, lambda t: trim_all(strip_tags(t))), lambda x: x != "")
    section = meta(metas, "article:section")
    categories = F.concat(listed(meta(metas, "category")), F.when(section.isNull(), F.array().cast("array<string>")).otherwise(F.array(section)))
    return F.struct(
        kind.alias("kind"), F.array_distinct(categories).alias("categories"), F.array_distinct(F.concat(listed(meta(metas, "article:tag")), linked)).alias("tags")
    )


def snapshot(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, metas, open_graph, twitter, json_ld): all meta tags as a map, cards where they have a title or kind, scripts by type."""
    page = F.coalesce(F.col(html), F.lit(""))
    found = pages.select(key, meta_tags(page).alias("metas"), ld_scripts(page).alias("scripts"))
    names = F.array_distinct(F.transform("metas", lambda m: m["key"]))
    first = F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter("metas", lambda m: m["key"] == n), F.lit(0))["content"]))
    typed = F.filter(F.transform("scripts", lambda x: F.struct(F.try_variant_get(F.try_parse_json(x), "$['@type']", "string").alias("type"), x.alias("json"))), lambda x: x["type"].isNotNull())
    types = F.array_distinct(F.transform(typed, lambda x: x["type"]))
    by_type = F.map_from_arrays(types, F.transform(types, lambda t: F.get(F.filter(typed, lambda x: x["type"] == t), F.lit(0))["json"]))
    og, cards = open_graph(F.col("metas")), twitter(F.col("metas"))
    return found.select(key, first.alias("metas"), F.when(og["title"].isNotNull(), og).alias("open_graph"), F.when(cards["card"].isNotNull(), cards).alias("twitter"), by_type.alias("json_ld"))


def _paths(json_text: str | None) -> dict[str, str]:
    try:
        todo = [("", json.loads(json_text or "", parse_float=str, parse_int=str))]
    except ValueError:
        return {}
    out = {}
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            kept = [(f"{path}.{k}" if path else k, v) for k, v in value.items() if k == "@type" or not k.startswith("@")]
            todo.extend(reversed(kept))
        elif isinstance(value, list):
            todo.extend((f"{path}[{k}]", v) for k, v in reversed(list(enumerate(value))))
        elif value is not None and path and not path.endswith("]"):
            out[path] = str(value)
    return out


def flattened(json_text: Column) -> Column:
    """Path and value of every field of a JSON text that is a scalar, as a map: ``a.b[0].c``.

    Fields that begin with ``@`` other than ``@type``, nulls and bare array elements are left out; no map entries where the text can't be read.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([list(_paths(t).items()) for t in texts.to_pylist()], pa.map_(pa.string(), pa.string()))

    return by_slices(run, "map<string,string>", json_text)
