"""Choice of a chunking strategy: content analysis, score of each strategy, the best one."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.batches import by_slices
from pagemill.functions.text import let

STRATEGIES = ("FixedSize", "Paragraph", "Smart", "Semantic", "MemoryOptimized")
#: Keyword sets, weights and score tables.
TECHNICAL = (
    "class", "function", "method", "api", "endpoint", "parameter", "return", "exception", "interface", "implementation", "algorithm",
    "data structure", "performance", "optimization", "configuration", "deployment", "installation", "setup", "tutorial", "guide",
)
ACADEMIC = (
    "abstract", "introduction", "methodology", "results", "conclusion", "references", "bibliography", "research", "study", "analysis",
    "experiment", "hypothesis", "theory", "literature review",
)
NEWS = (
    "breaking news", "report", "journalist", "correspondent", "press release", "statement", "announcement", "update",
    "developing story", "exclusive", "investigation",
)
WEIGHTS = {"size": 0.20, "structure": 0.25, "type": 0.30, "multimodal": 0.15, "technical": 0.10}
HISTORY = 0.5
SHORT, LONG, VERY_LONG, DENSE = 5_000, 50_000, 100_000, 0.3
BY_STRUCTURE = {("Smart", "High"): 0.9, ("Smart", "Medium"): 0.8, ("Semantic", "High"): 0.7, ("Paragraph", "Medium"): 0.6, ("FixedSize", "Low"): 0.5}
BY_TYPE = {
    ("Semantic", "Academic"): 0.9, ("Semantic", "Technical"): 0.8, ("Smart", "Documentation"): 0.9, ("Smart", "Technical"): 0.8,
    ("Paragraph", "Blog"): 0.7, ("Paragraph", "Article"): 0.6,
}
BY_TECHNICAL = {("Semantic", True): 0.9, ("Smart", True): 0.8, ("Paragraph", False): 0.6, ("FixedSize", False): 0.5}
RECOMMEND_TECHNICAL = ("class ", "function ", "method ", "api ", "```", "code", "example", "parameter", "return", "import", "export", "interface", "type")
RICH_SITES = ("github.com", "stackoverflow.com", "medium.com", "dev.to", "docs.", "api.", "learn.", "guide.", "manual.")


def _held(text: Column, words: tuple[str, ...]) -> list[Column]:
    return [F.contains(text, F.lit(w)) for w in words]


def _count(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text holds anywhere."""
    return reduce(Column.__add__, [x.cast("int") for x in _held(text, words)])


def keyword_facts(text: Column) -> Column:
    """How many technical words a lower-case text holds anywhere, and whether it has academic or news words."""
    some = lambda t, words: reduce(Column.__or__, _held(t, words))
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: F.named_struct(F.lit("technical"), _count(t, TECHNICAL), F.lit("academic"), some(t, ACADEMIC), F.lit("news"), some(t, NEWS)),
    )


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return let(text, lambda t: reduce(Column.__or__, _held(t, words)))


def analysis(text: Column, url: Column, headings: Column, images: Column, facts: Column) -> dict[str, Column]:
    """``facts``: ``keyword_facts`` of the lower-case text, computed once."""
    address, length = F.lower(F.coalesce(url, F.lit(""))), F.length(text)
    density = images / F.greatest(F.floor(length / 1000), F.lit(1))
    kind = (
        F.when(facts["academic"], "Academic").when(facts["news"], "News").when(facts["technical"] > 0, "Technical")
        .when(_has(address, ("doc", "api")), "Documentation").when(_has(address, ("blog",)), "Blog").otherwise("Article")
    )
    complexity = (headings * 2 + images) / F.greatest(length / 1000.0, F.lit(1.0))
    return {
        "length": length.cast("long"),
        "image_density": density.cast("double"),
        "technical": facts["technical"] >= 3,
        "content_type": kind,
        "complexity": F.when(complexity >= 2.0, "High").when(complexity >= 0.5, "Medium").otherwise("Low"),
    }


def _table(strategy: str, by: Column, scores: dict, default: float) -> Column:
    chain = F.lit(default)
    for (name, value), score in scores.items():
        if name == strategy:
            chain = F.when(by == value, score).otherwise(chain)
    return chain


def score(strategy: str, images: Column) -> Column:
    """Weighted score of one strategy over the analysis columns."""
    length, density = F.col("length"), F.col("image_density")
    size = {
        "MemoryOptimized": F.when(length > VERY_LONG, 0.9), "Smart": F.when(length > LONG, 0.8),
        "Paragraph": F.when(length > SHORT, 0.7), "FixedSize": F.when(length <= SHORT, 0.6),
    }.get(strategy, F.when(F.lit(False), 0.0)).otherwise(0.3)
    shown = {"Smart": F.when(density > DENSE, 0.9).otherwise(0.7), "Paragraph": F.when(density <= DENSE, 0.6).otherwise(0.4)}.get(strategy, F.lit(0.4))
    multimodal = F.when(images > 0, shown).otherwise(0.5)
    return (
        size * WEIGHTS["size"]
        + _table(strategy, F.col("complexity"), BY_STRUCTURE, 0.3) * WEIGHTS["structure"]
        + _table(strategy, F.col("content_type"), BY_TYPE, 0.4) * WEIGHTS["type"]
        + multimodal * WEIGHTS["multimodal"]
        + _table(strategy, F.col("technical"), BY_TECHNICAL, 0.4) * WEIGHTS["technical"]
        + HISTORY
    )


def scored(docs: DataFrame, text: str, url: str, headings: str, images: str) -> DataFrame:
    """``docs`` with the analysis columns and ``scores``: one (strategy, score) for each strategy, in order."""
    known = docs.withColumn("__facts", keyword_facts(F.lower(text)))
    facts = known.withColumns(analysis(F.col(text), F.col(url), F.col(headings), F.col(images), F.col("__facts"))).drop("__facts")
    each = [F.struct(F.lit(s).alias("strategy"), score(s, F.col(images)).alias("score")) for s in STRATEGIES]
    return facts.withColumn("scores", F.array(*each))


def best(scores: Column) -> Column:
    """The first strategy of the highest score."""
    return F.aggregate(scores, F.get(scores, F.lit(0)), lambda a, b: F.when(b["score"] > a["score"] + 1e-9, b).otherwise(a))


def recommend(text: Column, title: Column, url: Column, headings: Column, images: Column, little_memory: bool = False) -> Column:
    length = F.coalesce(F.length(text), F.lit(0))
    rich = _has(F.lower(F.coalesce(url, F.lit(""))), RICH_SITES) | (F.coalesce(title, F.lit("")) != "") | (headings > 0)
    technical = let(F.lower(F.coalesce(text, F.lit(""))), lambda t: _count(t, RECOMMEND_TECHNICAL)) >= 3
    return (
        F.when(F.lit(little_memory) | (length > 100_000), "MemoryOptimized").when(rich, "Auto").when((images > 0) & (length > 5_000), "Smart")
        .when(technical | (headings > 0), "Smart").when(length > 10_000, "Semantic").otherwise("Paragraph")
    )


def chunk_quality(chunks: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Per document: .3 size consistency, .4 similarity of neighbours, .2 size against its share, .1 token efficiency (0.8)."""
    from pagemill.functions.text import jaccard, words

    at = Window.partitionBy(key).orderBy(order)
    pairs = chunks.withColumn("__next", F.lead(content).over(at))
    facts = pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"), F.avg(F.length(content)).alias("mean"), F.stddev_pop(F.length(content)).alias("sd"),
        F.avg(F.when(F.col("__next").isNotNull(), jaccard(words(F.col(content)), words(F.col("__next"))))).alias("cohesion"), F.sum(F.length(content)).alias("total"),
    )
    size = F.when(F.col("chunks") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("sd") / F.nullif("mean", F.lit(0.0))))
    share = F.floor(F.col("total") / F.col("chunks"))
    structure = F.least(F.col("mean"), share) / F.greatest(F.col("mean"), share)
    cohesion = F.coalesce("cohesion", F.lit(1.0))
    return facts.select(
        key, "chunks", size.alias("size_consistency"), cohesion.alias("cohesion"),
        (0.3 * F.coalesce(size, F.lit(0.0)) + 0.4 * cohesion + 0.2 * F.coalesce(structure, F.lit(0.0)) + 0.1 * 0.8).alias("quality"),
    )


def rating(pieces: Column, length: Column, count=None) -> Column:
    """How well a document is cut, from its own chunks in its row: chunks, size_consistency, cohesion, structure, efficiency, quality.

    .3 evenness of sizes, .4 likeness of neighbours' words, .2 mean size against the document's share, .1 mean tokens against
    500 to 1,500, which is 0.8 without a counter ``count(text)``.  Without chunks all is 0.
    """
    from pagemill.functions.text import jaccard_of_sets, word_set, words

    n = F.size(pieces)
    mean_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(xs), F.lit(0))
    sizes = F.transform(pieces, lambda p: F.length(p["content"]).cast("double"))

    def rated(facts: Column) -> Column:
        mean = mean_of(facts["sizes"])
        spread = F.sqrt(mean_of(F.transform(facts["sizes"], lambda x: (x - mean) * (x - mean))))
        size = F.when(n < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - spread / F.nullif(mean, F.lit(0.0))))
        cohesion = F.when(n < 2, 1.0).otherwise(mean_of(facts["alike"]))
        share = F.floor(length / F.greatest(n, F.lit(1))).cast("double")
        structure = F.least(mean, share) / F.greatest(mean, share)
        tokens = facts["tokens"]
        efficiency = F.when(tokens.isNull(), 0.8).when(tokens < 500, tokens / 500.0).when(tokens > 1500, 1500.0 / tokens).otherwise(1.0)
        parts = [F.coalesce(x, F.lit(0.0)) for x in (size, cohesion, structure, efficiency)]
        quality = 0.3 * parts[0] + 0.4 * parts[1] + 0.2 * parts[2] + 0.1 * parts[3]
        some = lambda c: F.when(n > 0, c).otherwise(0.0)
        names = ("size_consistency", "cohesion", "structure", "efficiency")
        return F.struct(n.alias("chunks"), *[some(c).alias(k) for k, c in zip(names, parts)], some(quality).alias("quality"))

    last = F.greatest(n - 1, F.lit(0))
    alike = let(F.transform(pieces, lambda p: word_set(words(p["content"]))), lambda sets: F.zip_with(F.slice(sets, F.lit(1), last), F.slice(sets, F.lit(2), last), jaccard_of_sets))
    tokens = F.lit(None).cast("double") if count is None else mean_of(F.transform(pieces, lambda p: count(p["content"]).cast("double")))
    return let(F.struct(sizes.alias("sizes"), alike.alias("alike"), tokens.alias("tokens")), rated)


def _metrics(text: str) -> dict[str, float]:
    sentences = [s for s in re.split(r"[.!?]", text) if s]
    words = [w for w in re.split(r"[ \t\n\r]+", text) if w]
    sets = [{w for w in re.split(r"[ \t\n]+", s.lower()) if w} for s in sentences]
    pairs = [len(a & b) / len(a | b) if a or b else 1.0 for a, b in zip(sets, sets[1:])]
    readable = 0.0
    if text.strip() and sentences and words:
        load = len(words) / len(sentences) * 0.1 + sum(map(len, words)) / len(words) * 0.2
        readable = max(0.0, 1.0 - load / 20.0)
    return {"text_density": len("".join(text.split())) / len(text) if text.strip() else 0.0, "semantic_cohesion": sum(pairs) / len(pairs) if pairs else 1.0, "readability": readable}


def content_metrics(text: Column, headings: Column) -> Column:
    """A struct: share of visible characters, similarity of neighbouring sentences, ease of reading, and heading density."""
    names = ("text_density", "semantic_cohesion", "readability")

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_metrics(t or "") for t in texts.to_pylist()], pa.struct([(n, pa.float64()) for n in names]))

    size = F.length(F.coalesce(text, F.lit("")))
    density = F.when(size == 0, 0.0).when(headings == 0, 0.5).otherwise(F.least(F.lit(1.0), headings / (size / 1000.0) * 0.1))
    made = by_slices(run, "text_density double, semantic_cohesion double, readability double", text)
    return F.transform(F.array(made), lambda m: F.struct(*[m[n].alias(n) for n in names], density.alias("structural_consistency")))[0]
