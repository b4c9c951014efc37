"""Structured data of pages: JSON-LD flattened by levels, microdata trees, and the second metadata extractor as one struct."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import dom
from pagemill.functions.batches import by_slices
from pagemill.functions.text import none_if_blank, title_of
from pagemill.functions.urls import host
from pagemill.operators import metadata as M
from pagemill.sources.shared import written


def flattened_rows(rows: DataFrame, key: str, json_text: Column) -> DataFrame:
    """(key, path, value): every scalar field of a JSON text, ``a.b[0].c``, by ``variant_explode`` one level at a time.

    Fields that begin with ``@`` other than ``@type``, nulls and scalars that stand in an array themselves are left out, as are
    texts that can't be read.  Numbers are in their shortest form, booleans are True and False.  A level is a lateral
    join in the row and is written before the next, so the work of each is in proportion to what it holds.
    """
    explode = rows.sparkSession.tvf.variant_explode
    kind = F.schema_of_variant("value")
    level = rows.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(json_text).alias("v")).where("v is not null")
    out = None
    while True:
        inside = level.lateralJoin(explode(F.col("v").outer())).where("pos is not null")
        named = inside.toDF("id", "path", "v", "pos", "name", "value")
        named = named.where(F.col("name").isNull() | (F.col("name") == "@type") | ~F.startswith("name", F.lit("@")))
        at = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        at = at.when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("."), "name"))
        nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
        text = F.try_variant_get("value", "$", "string")
        text = F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
        step = written(named.select("id", at.alias("path"), "name", nested.alias("nested"), F.when(nested, F.to_json("value")).otherwise(text).alias("value")))
        found = step.where(~F.col("nested") & F.col("name").isNotNull() & F.col("value").isNotNull()).select("id", "path", "value")
        out = found if out is None else out.union(found)
        level = step.where("nested").select(F.col("id").alias("key"), "path", F.parse_json("value").alias("v"))
        if level.isEmpty():
            return out.withColumnRenamed("id", key)


# Microdata


#: Where an element's property stands, by its tag; its text elsewhere.
VALUE_OF = {
    "meta": "content", "a": "href", "area": "href", "link": "href", "img": "src", "audio": "src", "video": "src", "source": "src", "embed": "src", "iframe": "src",
    "track": "src", "object": "data", "data": "value", "meter": "value", "time": "datetime",
}


def _properties(scope: dom.Node) -> list[tuple[str, dom.Node]]:
    """The property elements of an item, in order, without those of items inside it."""
    found, todo = [], [c for c in reversed(scope.children) if isinstance(c, dom.Node)]
    while todo:
        node = todo.pop()
        found += [(name, node) for name in node.attrs.get("itemprop", "").split()]
        if "itemscope" not in node.attrs:
            todo.extend(c for c in reversed(node.children) if isinstance(c, dom.Node))
    return found


def microdata_of(html: str) -> dict[str, str]:
    """Paths and values of a page's items, in the form of flattened JSON-LD.

    A property that an item has several times is numbered, as are several outer items.
    """
    outer = [n for n in dom.parse(html).walk() if "itemscope" in n.attrs and not n.attrs.get("itemprop")]
    out: dict[str, str] = {}
    todo = [(f"[{k}]" if len(outer) > 1 else "", item) for k, item in enumerate(outer)]
    while todo:
        path, item = todo.pop(0)
        below = lambda name, path=path: f"{path}.{name}" if path else name
        if kind := item.attrs.get("itemtype", "").strip():
            out[below("@type")] = kind.rstrip("/").rsplit("/", 1)[-1]
        own = _properties(item)
        times: dict[str, int] = {}
        for name, _ in own:
            times[name] = times.get(name, 0) + 1
        seen: dict[str, int] = {}
        for name, node in own:
            at, seen[name] = below(name) + (f"[{seen.get(name, 0)}]" if times[name] > 1 else ""), seen.get(name, 0) + 1
            if "itemscope" in node.attrs:
                todo.append((at, node))
            else:
                attribute = VALUE_OF.get(node.tag)
                value = node.attrs.get(attribute) if attribute else None
                out[at] = dom.flat(node.text()).strip() if value is None else value.strip()
    return out


def microdata(html: Column) -> Column:
    """``microdata_of`` as a map; empty where a page has no items."""

    def run(pages: pa.Array) -> pa.Array:
        made = (microdata_of(h) if h and "itemscope" in h else {} for h in pages.to_pylist())
        return pa.array([list(m.items()) for m in made], pa.map_(pa.string(), pa.string()))

    return by_slices(run, "map<string,string>", html)


def structured(scripts: Column) -> Column:
    """The fields of all JSON-LD scripts of a page in one map; of a path that several have, the last one's."""

    def run(pages: pa.Array) -> pa.Array:
        out = []
        for texts in pages.to_pylist():
            fields: dict[str, str] = {}
            for text in texts or ():
                fields |= M._paths(text)
            out.append(list(fields.items()))
        return pa.array(out, pa.map_(pa.string(), pa.string()))

    return by_slices(run, "map<string,string>", scripts)


def schema_type(scripts: Column, items: Column) -> Column:
    """The type of the first JSON-LD script that is an object with one, else of the first microdata item."""
    types = F.filter(F.transform(scripts, lambda s: F.try_variant_get(F.try_parse_json(s), "$['@type']", "string")), lambda t: t.isNotNull() & ~F.startswith(t, F.lit("[")))
    first_item = F.coalesce(F.try_element_at(items, F.lit("@type")), F.try_element_at(items, F.lit("[0].@type")))
    return F.coalesce(F.get(types, F.lit(0)), first_item)


OPEN_GRAPH = ("title", "description", "image", "type", "site_name", "locale")
CARD = ("card", "site", "creator", "title", "description", "image")


def document_metadata(pages: DataFrame, url: str = "url", html: str = "html", header: Column | None = None) -> DataFrame:
    """``pages`` with ``document``: one struct of all that the second extractor reads.

    Search fields, Open Graph, Twitter card (null without a kind), times (null where they can't be read), schema type and
    structured fields (JSON-LD, and microdata where JSON-LD has none of a path), language and how it was found, site context,
    feed and domain.  ``header``: the Content-Language of the reply.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    found = pages.withColumns({"__metas": M.meta_tags(page), "__links": M.link_tags(page), "__scripts": M.ld_scripts(page), "__items": microdata(page)})
    metas, links, items = F.col("__metas"), F.col("__links"), F.col("__items")
    fields = found.withColumn("__fields", structured(F.col("__scripts")))
    both = F.map_concat(F.map_filter(items, lambda k, _: ~F.map_contains_key("__fields", k)), "__fields")
    card = F.struct(*[M.meta(metas, f"twitter:{n}").alias(n) for n in CARD])
    by_type = lambda kind: F.get(F.filter(links, lambda x: x["type"] == kind), F.lit(0))["href"]
    time = lambda name: M.meta(metas, name).try_cast("timestamp")
    made = F.struct(
        F.col(url).alias("url"), none_if_blank(title_of(page, "")).alias("title"), M.meta(metas, "description").alias("description"), M.listed(M.meta(metas, "keywords")).alias("keywords"),
        M.meta(metas, "author").alias("author"), M.meta(metas, "robots").alias("robots"), M.link(links, "canonical").alias("canonical"),
        F.struct(*[M.meta(metas, f"og:{n}").alias(n) for n in OPEN_GRAPH]).alias("open_graph"), F.when(card["card"].isNotNull(), card).alias("twitter"),
        time("article:published_time").alias("published"), time("article:modified_time").alias("modified"), schema_type(F.col("__scripts"), items).alias("schema_type"), both.alias("structured"),
        M.language(page, page, header).alias("language"), M.site_context(page, F.col(url)).alias("site"),
        F.coalesce(none_if_blank(by_type("application/rss+xml")), by_type("application/atom+xml")).alias("feed"), host(F.col(url)).alias("domain"),
    )
    return fields.withColumn("document", made).drop("__metas", "__links", "__scripts", "__items", "__fields")


def as_json_ld(fields: dict[str, Column], kind: str) -> Column:
    """A JSON-LD script of one object, for pages made from rows."""
    made = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *[c.alias(n) for n, c in fields.items()]))
    return F.concat(F.lit('<script type="application/ld+json">'), made, F.lit("</script>"))
