"""Chunkers: one row in, chunk rows out.

Each strategy walks a document once in an Arrow batch, and its chunks are exploded in place: no shuffle, time in
proportion to the text.  Rows:
source_url, sequence_number, content, chunk_type, heading_path, section_title, strategy, chunk_id.
Sizes of token strategies are in estimated tokens, four characters each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeResult

from pagemill.functions import text as T
from pagemill.functions.batches import by_slices
from pagemill.operators import strategy
from pagemill.operators.extract import dom_chunks
from pagemill.sources.cache import ContentCache

PIECE = "array<struct<content:string,chunk_type:string,heading_path:array<string>,section_title:string>>"


@dataclass(frozen=True)
class ChunkOptions:
    max_tokens: int = 512
    min_tokens: int = 100
    overlap: int = 64
    max_chars: int = 1500
    min_chars: int = 100
    threshold: float = 0.5

    def errors(self) -> list[str]:
        """Everything that is wrong with the values."""
        found = [f"{n} must be positive" for n in ("max_tokens", "max_chars") if getattr(self, n) <= 0]
        found += [f"{n} must not be negative" for n in ("min_tokens", "overlap", "min_chars") if getattr(self, n) < 0]
        if self.overlap >= self.max_tokens:
            found.append("overlap must be less than max_tokens")
        if self.min_tokens >= self.max_tokens:
            found.append("min_tokens must be less than max_tokens")
        if not 0 <= self.threshold <= 1:
            found.append("threshold must be between 0 and 1")
        return found

    def validate(self) -> ChunkOptions:
        if found := self.errors():
            raise ValueError("; ".join(found))
        return self


Piece = tuple[str, str, list[str], str | None]
KIND = pa.list_(pa.struct([("content", pa.string()), ("chunk_type", pa.string()), ("heading_path", pa.list_(pa.string())), ("section_title", pa.string())]))
_TITLE = re.compile(r"^#{1,6}\s+([^\n]+)")
_HEADING = re.compile(r"^#{1,6}[ \t]+.+$", re.MULTILINE)


def _plain(contents: Iterable[str], kind: str = "Text") -> list[Piece]:
    return [(c, kind, [], None) for c in contents]


def fixed_size(text: str, options: ChunkOptions) -> list[Piece]:
    """Greedy packing of words; each chunk but the first repeats the end of the one before."""
    parts = T.packed(text, 4 * (options.max_tokens - options.overlap))
    if not options.overlap:
        return _plain(parts)
    ends = [re.split(r"\s", p[-4 * options.overlap :], maxsplit=1)[1:] for p in parts]
    return _plain([*parts[:1], *(" ".join([*end, part]).lstrip(" ") for end, part in zip(ends, parts[1:]))])


def paragraphs(text: str, options: ChunkOptions) -> list[Piece]:
    """Blank-line paragraphs; small ones join the next, large ones are packed by words."""
    most, least = 4 * options.max_tokens, 4 * options.min_tokens
    merged, held, size = [], [], 0
    for p in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        size += len(p) + 2 * bool(held)
        held.append(p)
        if size >= least:
            merged.append("\n\n".join(held))
            held, size = [], 0
    if held:
        merged.append("\n\n".join(held))
    return _plain(c for p in merged for c in ([p] if len(p) <= most else T.packed(p, most)))


def is_heading(line: str) -> bool:
    return line.startswith(("#", "<h")) or 0 < len(line) < 100 and "." not in line


def smart(text: str, options: ChunkOptions) -> list[Piece]:
    """Sections that begin at each heading line, or blank-line parts where there is no heading; large ones go to ``paragraphs``."""
    if _HEADING.search(text):
        sections: list[list[str]] = []
        for line in text.split("\n"):
            if is_heading(line.strip()) or not sections:
                sections.append([])
            sections[-1].append(line)
        whole = ["\n".join(s) for s in sections]
    else:
        whole = text.split("\n\n")
    out = []
    for section in filter(None, map(str.strip, whole)):
        title = _TITLE.match(section)
        path = [title[1]] if title else []
        parts = [section] if len(section) <= 4 * options.max_tokens else [c for c, *_ in paragraphs(section, options)]
        out += [(c, "Section", path, title[1] if title else None) for c in parts]
    return out


CUTTERS = {"FixedSize": fixed_size, "MemoryOptimized": fixed_size, "Smart": smart, "Paragraph": paragraphs}


def pieces(text: Column, name: Column, options: ChunkOptions) -> Column:
    """The chunks of a text by the strategy named; each text is walked once."""
    cutters = dict(CUTTERS)  # with the caller's own, which workers don't know

    def run(texts: pa.Array, names: pa.Array) -> pa.Array:
        made = (cutters[n](t or "", options) for t, n in zip(texts.to_pylist(), names.to_pylist()))
        return pa.array([[dict(zip(("content", "chunk_type", "heading_path", "section_title"), c)) for c in cs] for cs in made], KIND)

    return by_slices(run, PIECE, text, name)


def register_chunker(name: str, cut) -> None:
    """A strategy of the caller's own: ``cut(text, options)`` gives (content, chunk_type, heading_path, section_title) tuples."""
    CUTTERS[name] = cut


@dataclass
class ChunkFacts(AnalyzeResult):
    """What the analysis of a call found out, for its rows."""

    text: str = "text"
    others: tuple[str, ...] = ()
    strategy: str = "Paragraph"
    options: ChunkOptions = ChunkOptions()
    whole: bool = False


def register_table_function(spark: SparkSession, name: str = "chunk_text", options: ChunkOptions = ChunkOptions()) -> None:
    """An SQL table function ``name(text, strategy)``: (sequence_number, content, chunk_type, heading_path, section_title)."""
    cutters = dict(CUTTERS)

    class ChunkText:
        def eval(self, text: str, strategy: str):
            for k, piece in enumerate(cutters.get(strategy, cutters["Paragraph"])(text or "", options)):
                yield (k, *piece)

    made = F.udtf(ChunkText, returnType="sequence_number int, content string, chunk_type string, heading_path array<string>, section_title string")
    spark.udtf.register(name, made)


def register_chunk_table(spark: SparkSession, name: str = "chunk_table") -> None:
    """An SQL table function over a whole table, its options by name:

        SELECT * FROM chunk_table(TABLE(docs) PARTITION BY site ORDER BY url, text => 'body', strategy => 'Smart', max_tokens => 256)

    Gives the table's other columns and (sequence_number, content, chunk_type, heading_path, section_title).  Chunks are numbered
    by row, with ``number_partition => true`` over the partition, in its order.  Unknown strategies, columns and wrong options are
    errors when the query is analyzed.
    """
    cutters = dict(CUTTERS)
    limits = ("max_tokens", "min_tokens", "overlap", "max_chars", "min_chars")

    class ChunkTable:
        def __init__(self, facts=None):
            self.facts, self.number = facts, 0

        @staticmethod
        def analyze(rows, **options):
            known = {k: v.value for k, v in options.items()}
            text, chosen, whole = known.pop("text", "text"), known.pop("strategy", "Paragraph"), bool(known.pop("number_partition", False))
            if not rows.isTable:
                raise ValueError("the first argument must be TABLE(...)")
            if text not in rows.dataType.names:
                raise ValueError(f"no column {text}")
            if chosen not in cutters:
                raise ValueError(f"unknown strategy {chosen}: one of {', '.join(sorted(cutters))}")
            if wrong := sorted(set(known) - set(limits)):
                raise ValueError(f"unknown option {wrong[0]}: one of {', '.join(limits)}")
            made = ChunkOptions(**{k: int(v) for k, v in known.items()}).validate()
            others = [f for f in rows.dataType.fields if f.name != text]
            text_type = StringType()
            added = StructType().add("sequence_number", IntegerType()).add("content", text_type).add("chunk_type", text_type).add("heading_path", ArrayType(text_type)).add("section_title", text_type)
            schema = StructType([*others, *added.fields])
            return ChunkFacts(schema, text=text, others=tuple(f.name for f in others), strategy=chosen, options=made, whole=whole)

        def eval(self, row, **options):
            own = [row[c] for c in self.facts.others]
            for k, piece in enumerate(cutters[self.facts.strategy](row[self.facts.text] or "", self.facts.options)):
                yield (*own, self.number if self.facts.whole else k, *piece)
                self.number += 1

    spark.udtf.register(name, F.udtf(ChunkTable))


def dom_structure(html: Column, options: ChunkOptions) -> Column:
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([dom_chunks(h, options.min_chars, options.max_chars) for h in pages.to_pylist()], KIND)

    return by_slices(run, PIECE, html)


def rows(docs: DataFrame, pieces: Column, name: Column, url: str) -> DataFrame:
    listed = docs.select(F.col(url).alias("source_url"), name.alias("strategy"), F.posexplode(pieces).alias("sequence_number", "__c"))
    number = F.col("sequence_number").cast("long")
    return listed.select(
        "source_url", number.alias("sequence_number"), "__c.*", "strategy",
        F.sha2(F.concat_ws("|", "source_url", "strategy", number.cast("string")), 256).alias("chunk_id"),
    )


def chunk(docs: DataFrame, name: str = "Paragraph", options: ChunkOptions = ChunkOptions(), text: str = "text", url: str = "url", html: str = "html") -> DataFrame:
    """Chunk rows by one strategy; ``Auto`` picks one for each document, unknown names mean Paragraph."""
    options.validate()
    if name == "Intelligent":
        raise ValueError("Intelligent has no implementation")
    if name == "Semantic":
        raise ValueError("Semantic needs an embedder: use semantic()")
    body = F.coalesce(F.col(text), F.lit("")) if text in docs.columns else None
    if name == "DomStructure":
        plain = _plain_pieces(F.coalesce(F.col(text), F.lit("")), options) if text in docs.columns else F.array().cast(PIECE)
        return rows(docs, F.when(T.trim_all(F.coalesce(F.col(html), F.lit(""))) != "", dom_structure(F.col(html), options)).otherwise(plain), F.lit(name), url)
    if name != "Auto":
        known = F.lit(name if name in CUTTERS else "Paragraph")
        return rows(docs, pieces(body, known, options), known, url)
    scored, chosen = _with_choice(docs, text, url)
    return rows(scored, pieces(body, chosen, options), chosen, url)


def _with_choice(docs: DataFrame, text: str, url: str) -> tuple[DataFrame, Column]:
    """``docs`` with the facts that Auto weighs, and the strategy that it takes."""
    body = F.coalesce(F.col(text), F.lit(""))
    facts = docs.withColumns({"__h": F.size(T.markdown_headings(body)), "__i": F.size(T.markdown_images(body))})
    scored = strategy.scored(facts, text, url, "__h", "__i").withColumn("__best", strategy.best(F.col("scores"))["strategy"])
    return scored, F.when(F.col("__best") == "Semantic", "Paragraph").otherwise(F.col("__best"))  # no embedder here


RESULT = f"struct<strategy:string,pieces:{PIECE},rating:struct<chunks:int,size_consistency:double,cohesion:double,structure:double,efficiency:double,quality:double>>"


def auto_rated(
    docs: DataFrame, options: ChunkOptions = ChunkOptions(), text: str = "text", url: str = "url", count=None, store: ContentCache | None = None, now: Column | None = None, minutes: float = 60
) -> DataFrame:
    """Auto's chunk rows with the ``rating`` of their document's result, and ``from_cache``.

    With a ``store`` results are kept by the digest of URL and text and by the options: a document that is met again within
    ``minutes`` is not cut or rated a second time.  A blank text has no chunks.
    """
    options.validate()
    own = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({"__key": F.sha2(F.concat_ws("\n", F.col(url).cast("string"), own), 256), "__text": own, "__url": F.col(url).cast("string")})

    def result(rows: DataFrame) -> DataFrame:
        scored, chosen = _with_choice(rows.select("__key", "__text", "__url"), "__text", "__url")
        cut = scored.select("__key", "__text", chosen.alias("s"), pieces(F.col("__text"), chosen, options).alias("p"))
        return cut.select("__key", F.struct(F.col("s").alias("strategy"), F.col("p").alias("pieces"), strategy.rating(F.col("p"), F.length("__text"), count).alias("rating")).alias("r"))

    if store is None:
        known = result(keyed.dropDuplicates(["__key"])).withColumn("from_cache", F.lit(False))
    else:
        kind = "auto:" + hashlib.sha256(repr(options).encode()).hexdigest()[:16]
        wanted = keyed.select(F.col("__key").alias("url"), "__key", "__text", "__url").dropDuplicates(["url"])
        got = store.through(wanted, lambda rows: result(rows).select(F.col("__key").alias("url"), F.to_json("r").alias("content")), now, minutes, kind)
        known = got.select("__key", F.from_json("content", RESULT).alias("r"), "from_cache")
    result_of = known.select("__key", "r.strategy", "r.rating", "r.pieces", "from_cache")
    each = keyed.select("__key", F.col("__url").alias("source_url")).join(result_of, "__key").select("source_url", "strategy", "rating", "from_cache", F.posexplode("pieces").alias("sequence_number", "__c"))
    number = F.col("sequence_number").cast("long")
    return each.select(
        "source_url", number.alias("sequence_number"), "__c.*", "strategy", F.sha2(F.concat_ws("|", "source_url", "strategy", number.cast("string")), 256).alias("chunk_id"), "rating", "from_cache"
    )


def _plain_pieces(text: Column, options: ChunkOptions) -> Column:
    """Words packed by characters: what is left of a page without markup."""
    return F.transform(
        T.split_by_size(text, options.max_chars),
        lambda c: F.struct(c.alias("content"), F.lit("Text").alias("chunk_type"), F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("string").alias("section_title")),
    )


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def semantic(docs: DataFrame, embed, options: ChunkOptions = ChunkOptions(), text: str = "text", url: str = "url") -> DataFrame:
    """Sentences in runs of like meaning: a chunk ends where neighbours' cosine is under the threshold, or where it would pass ``max_tokens``.

    ``embed``: column function from array<string> to array<array<double>>.
    """
    sentences = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+"), lambda s: T.trim_all(s) != "")
    seen = docs.select(url, sentences.alias("__s")).withColumn("__e", embed(F.col("__s")))

    def run(texts: pa.Array, vectors: pa.Array) -> pa.Array:
        made = (_plain(_runs(s or [], v or [], options.threshold, 4 * options.max_tokens)) for s, v in zip(texts.to_pylist(), vectors.to_pylist()))
        return pa.array([[dict(zip(("content", "chunk_type", "heading_path", "section_title"), c)) for c in cs] for cs in made], KIND)

    return rows(seen, by_slices(run, PIECE, F.col("__s"), F.col("__e")), F.lit("Semantic"), url)


def _runs(sentences: list[str], vectors: list[list[float]], threshold: float, most: int) -> list[str]:
    """Neighbours whose cosine is at least the threshold, joined to at most ``most`` characters; a vector of zeros is like nothing."""
    if not sentences:
        return []
    v = np.array(vectors, float)
    size = np.sqrt((v * v).sum(axis=1))
    both = size[1:] * size[:-1]
    alike = (v[1:] * v[:-1]).sum(axis=1) / np.where(both > 0, both, 1.0)
    joins = np.concatenate([[False], (both > 0) & (alike >= threshold)])
    out: list[list[str]] = []
    size = 0
    for sentence, joined in zip(sentences, joins.tolist()):
        if joined and size + 1 + len(sentence) <= most:
            out[-1].append(sentence)
            size += 1 + len(sentence)
        else:
            out.append([sentence])
            size = len(sentence)
    return [" ".join(x) for x in out]


def hash_embedder(sentences: Column, size: int = 16) -> Column:
    """A test double: words hashed to ``size`` counts."""

    def run(texts: pa.Array) -> pa.Array:
        made = []
        for each in texts.to_pylist():
            rows = np.zeros((len(each or []), size))
            for row, sentence in zip(rows, each or []):
                for word in sentence.lower().split():
                    row[zlib.crc32(word.encode()) % size] += 1
            made.append(rows.tolist())
        return pa.array(made, pa.list_(pa.list_(pa.float64())))

    return by_slices(run, "array<array<double>>", sentences)
