"""Enrichment and rewriting by an injected model: a column function from prompt to reply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import none_if_blank, truncate

Complete = Callable[[Column], Column]
MOST = 6000
PROMPTS = {
    "summarize": "Summarize the text below in a few sentences.\n\n",
    "expand": "Explain the text below in more detail.\n\n",
    "rewrite": "Rewrite the text below so that it is clear and well ordered.\n\n",
    "enrich": "Add helpful context to the text below.\n\n",
    "metadata": "Return a JSON object with title, description, author, language, topics and keywords of the text below.\n\n",
}
REPLY = "title string, description string, author string, language string, topics array<string>, keywords array<string>"


def prompt(task: str, text: Column) -> Column:
    return F.concat(F.lit(PROMPTS[task]), truncate(F.coalesce(text, F.lit("")), MOST))


def reply_json(reply: Column) -> Column:
    """The JSON object inside a reply, whatever stands around it; null where none can be read."""
    return F.from_json(none_if_blank(F.regexp_extract(reply, r"(?s)\{.*\}", 0)), REPLY)


def with_metadata(docs: DataFrame, complete: Complete, text: str = "text") -> DataFrame:
    """``docs`` with ``ai``: the model's metadata, null where the reply is no JSON."""
    return docs.withColumn("ai", reply_json(complete(prompt("metadata", F.col(text)))))


def merged(docs: DataFrame, columns: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """Blank own columns filled from ``ai``, and ``metadata_source``: Html, Ai, Merged or None."""
    own = [none_if_blank(F.col(c)) for c in columns]
    has = lambda cs: F.greatest(*[c.isNotNull() for c in cs], F.lit(False))
    taken = [c.isNull() & F.col(f"ai.{n}").isNotNull() for c, n in zip(own, columns)]
    source = F.when(has(own) & F.greatest(*taken, F.lit(False)), "Merged").when(has(own), "Html").when(F.col("ai").isNotNull(), "Ai").otherwise("None")
    filled = {n: F.coalesce(c, F.col(f"ai.{n}")) for c, n in zip(own, columns)}
    return docs.withColumn("metadata_source", source).withColumns(filled)


def choose(length: Column, quality: Column, images: Column, sections: Column, has_model: bool = True) -> Column:
    """The rewriting strategy for a document."""
    if not has_model:
        return F.lit("None")
    return (
        F.when(length > 10_000, "Summarize").when(quality < 0.6, "Rewrite").when(length < 500, "Expand")
        .when((images > 0) | (sections > 5), "Enrich").otherwise("Rewrite")
    )


def quality_of(strategy: str, ratio: Column) -> Column:
    """Rating of a result by its length over the original's."""
    if strategy == "Summarize":
        return F.when(ratio.between(0.2, 0.5), 0.9).when(ratio.between(0.1, 0.6), 0.7).otherwise(0.5)
    if strategy == "Expand":
        return F.when(ratio.between(1.3, 2.0), 0.9).when(ratio.between(1.1, 2.5), 0.7).otherwise(0.5)
    return F.lit(0.8)


def reconstruct(docs: DataFrame, strategy: str, complete: Complete | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``result``, ``ratio``, ``tokens`` and ``result_quality``; a missing reply keeps the text."""
    if strategy == "None" or complete is None:
        result = F.col(text)
        return docs.withColumn("result", result).withColumns({"ratio": F.lit(1.0), "tokens": F.lit(0), "result_quality": F.lit(1.0)})
    asked = prompt(strategy.lower(), F.col(text))
    made = docs.withColumn("result", F.coalesce(none_if_blank(complete(asked)), F.col(text)))
    ratio = F.length("result") / F.nullif(F.length(text), F.lit(0))
    tokens = F.floor((F.length(asked) + F.length("result")) / 4)
    return made.withColumns({"ratio": ratio, "tokens": tokens, "result_quality": quality_of(strategy, ratio)})


# Metadata by schema

#: The fields that each schema asks for, its own ones apart.
SCHEMAS = {
    "General": (("title", "description", "topics", "keywords", "contentType", "siteStructure", "language", "confidence"), ()),
    "TechnicalDoc": (("title", "description", "topics", "keywords", "confidence"), ("libraries", "frameworks", "technologies", "apiVersion", "codeLanguages")),
    "ProductManual": (("title", "description", "confidence"), ("productName", "company", "version", "model", "price", "currency", "categories")),
    "Article": (("title", "description", "author", "publishedDate", "topics", "keywords", "confidence"), ("tags", "readingTimeMinutes", "articleType")),
}


def schema_prompt(schema: str, text: Column, url: Column, custom: tuple[str, ...] = (), title: Column | None = None) -> Column:
    """The question to a model: the fields of a schema (``Custom``: the caller's own), the address, a hint and the text."""
    if schema != "Custom" and schema not in SCHEMAS:
        raise ValueError(f"no schema named {schema}; there are {', '.join([*SCHEMAS, 'Custom'])}")
    fields, own = SCHEMAS.get(schema, (("confidence",), custom))
    listed = "".join(f"- {f}\n" for f in fields) + "".join(f"- schemaSpecificData.{f}\n" for f in own)
    hint = F.lit("") if title is None else F.coalesce(F.concat(F.lit("Title of the page: "), title, F.lit("\n")), F.lit(""))
    return F.concat(F.lit(f"Return one JSON object with these fields of the page below:\n{listed}Address: "), url, F.lit("\n"), hint, F.lit("\n"), truncate(F.coalesce(text, F.lit("")), MOST))


def with_schema(docs: DataFrame, schema: str, complete: Complete, custom: tuple[str, ...] = (), text: str = "text", url: str = "url") -> DataFrame:
    """``docs`` (with title and description, null where the page has none) and ``enriched``: the page's values first, the model's for the others.

    ``title_from`` and ``description_from`` say Html or Ai; ``specific`` holds the schema's own fields as texts; a reply that
    is no JSON leaves the page's values.
    """
    reply = complete(schema_prompt(schema, F.col(text), F.col(url), custom, none_if_blank(F.col("title"))))
    v = F.try_parse_json(none_if_blank(F.regexp_extract(reply, r"(?s)\{.*\}", 0)))
    get = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
    many = lambda path: F.filter(get(path, "array<string>"), lambda x: none_if_blank(x).isNotNull())
    own = {c: none_if_blank(F.col(c)) for c in ("title", "description")}
    source = lambda c: F.when(own[c].isNotNull(), "Html").when(get(c).isNotNull(), "Ai").alias(f"{c}_from")
    return docs.withColumn(
        "enriched",
        F.struct(
            F.coalesce(own["title"], get("title")).alias("title"), source("title"), F.coalesce(own["description"], get("description")).alias("description"), source("description"),
            get("author").alias("author"), get("language").alias("language"), many("topics").alias("topics"), many("keywords").alias("keywords"), get("contentType").alias("content_type"),
            get("siteStructure").alias("site_structure"), get("publishedDate").alias("published"), get("schemaSpecificData", "map<string,string>").alias("specific"), get("confidence", "double").alias("confidence"),
        ),
    )
