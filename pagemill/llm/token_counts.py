"""Operator 10: exact token counts of every prefix by dynamic programming.

For a BPE vocabulary the last token of a prefix's encoding decides the rest:
``count[i] = count[i - len(t)] + 1`` where ``t`` is the one token that ends at ``i`` and
stays separate when joined to the last token before it.  One pass gives the count at every
prefix, which answers truncation and budget questions without encoding again.

A text is cut before each space that follows another character, and between a word and
other characters.  No piece of the vocabulary spans such a place (checked when the model
is loaded), so prefix counts of the parts add up.  Counts of short parts are kept in a
bounded cache per Python worker; new parts are counted in sorted order, so that a common
beginning is counted once.

The work is a narrow map over rows: no shuffle, memory of one Arrow batch and the cache.

Cases: null text counts as empty (0 bytes, 0 tokens); texts of any length are processed
whole, in linear time; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored by the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Most entries of a worker's cache, and most characters of a cached piece of text.
CACHE_ROWS, CACHE_CHARS = 1_000_000, 48
SPACE_MARK = "▁"
#: Cuts before each run of spaces; the second also where a word and other characters meet.
WORD = "0-9A-Za-z\u00c0-\u024f"
CUTS = (
    rf"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+",
    rf"{SPACE_MARK}*[{WORD}]+|{SPACE_MARK}*[^{WORD}{SPACE_MARK}]+|{SPACE_MARK}+",
)
#: Texts that a model with a normaliser, user-defined pieces or another space mark counts otherwise.
PROBES = ("\uff21\ufb01\u00bd \u2460", "a  b   c", " lead and trail ", "e\u0301 \u00e9", "x\ty\nz", "<s> </s> <unk>", "")
#: Characters of texts that are counted together.
CHUNK = 2_000_000


class Prefixes(NamedTuple):
    """Token count after each character of a text."""

    counts: np.ndarray

    def total(self) -> int:
        return int(self.counts[-1]) if len(self.counts) else 0

    def tokens_of(self, chars: int) -> int:
        return int(self.counts[chars - 1]) if chars > 0 else 0

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        fits = np.flatnonzero(self.counts <= budget)
        return int(fits[-1]) + 1 if len(fits) else 0


class PrefixCounter:
    """Prefix counts under a SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.vocab_size())
        self.score = {
            model.id_to_piece(i): model.get_score(i)
            for i in ids
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.score):
            raise ValueError("a piece of this vocabulary spans a space: texts can't be cut there")
        mixed = re.compile(rf"[{WORD}][^{WORD}{SPACE_MARK}]|[^{WORD}{SPACE_MARK}][{WORD}]")
        self.pattern = re.compile(CUTS[not any(map(mixed.search, self.score))])
        self.longest = max(map(len, self.score))
        self.joins: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}
        if any(found.total() != len(model.encode(t)) for t, found in zip(PROBES, self.prefixes(list(PROBES)))):
            raise ValueError("this model changes texts before it cuts them, or isn't a BPE of plain pieces")

    def encode(self, chars: str) -> list[str]:
        """BPE of a short string: the best-scored merge first, leftmost among equals."""
        parts = list(chars)
        while len(parts) > 1:
            best = max(
                ((self.score[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score),
                default=None,
            )
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether two tokens stay the tokens of their joined string; an empty left is a text's start."""
        key = (left, right)
        known = self.joins.get(key)
        if known is None:
            if len(self.joins) > 2_000_000:
                self.joins.clear()
            known = self.joins[key] = self.encode(left + right) == ([left, right] if left else [right])
        return known

    def extend(self, piece: str, counts: list[int], last: list[str]) -> None:
        """Carry counts and last tokens, which hold a prefix of ``piece``, on to its end."""
        score, apart, longest = self.score, self.apart, self.longest
        for end in range(len(counts), len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in score:
                    if apart(last[start], token):
                        counts.append(counts[start] + 1)
                        break
                elif end - start == 1:  # bytes: joins nothing
                    counts.append(counts[start] + len(token.encode()))
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends {piece[:end]!r}")
            last.append(token)

    def piece_counts(self, piece: str) -> list[int]:
        counts, last = [0], [""]
        self.extend(piece, counts, last)
        return counts[1:]

    def learn(self, pieces: set[str]) -> None:
        """Cache the counts of short pieces, in order: neighbours share the work of a common prefix."""
        if len(self.cache) + len(pieces) > CACHE_ROWS:
            self.cache.clear()
        counts, last, before = [0], [""], ""
        for piece in sorted(p for p in pieces if len(p) <= CACHE_CHARS):
            same = 0
            for x, y in zip(piece, before):
                if x != y:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            self.extend(piece, counts, last)
            before = piece
            if max(counts) < 256:
                self.cache[piece] = bytes(counts[1:])

    def prefixes(self, texts: list[str]) -> list[Prefixes]:
        cut = [self.pattern.findall(SPACE_MARK + t.replace(" ", SPACE_MARK)) if t else [] for t in texts]
        known = self.cache.keys()
        self.learn({p for pieces in cut for p in pieces if p not in known})
        return [self.joined(pieces) for pieces in cut]

    def joined(self, pieces: list[str]) -> Prefixes:
        if not pieces:
            return Prefixes(np.zeros(0, np.int32))
        rows = list(map(self.cache.get, pieces))
        if None in rows:
            rows = [r if r is not None else self.cache.get(p) or self.piece_counts(p) for r, p in zip(rows, pieces)]
            inside = np.concatenate([np.frombuffer(r, np.uint8) if isinstance(r, bytes) else np.array(r) for r in rows])
        else:
            inside = np.frombuffer(b"".join(rows), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        totals = inside[np.cumsum(lengths) - 1].astype(np.int64)
        counts = inside + np.repeat(np.cumsum(totals) - totals, lengths)
        return Prefixes(counts[1:].astype(np.int32))  # without the mark put before the text


@lru_cache(maxsize=2)
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _counted(model_file: str | None, texts: pa.Array) -> Iterator[Prefixes]:
    count = counter(model_file or default_model())
    chunk, chars = [], 0
    for value in texts:
        chunk.append(value.as_py() or "")
        chars += len(chunk[-1])
        if chars >= CHUNK:
            yield from count.prefixes(chunk)
            chunk, chars = [], 0
    yield from count.prefixes(chunk)


def prefix_token_counts(docs: DataFrame, model_file: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, prefix_tokens): the token count after each character of each text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p.counts for p in _counted(model_file, batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], [key, "prefix_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, prefix_tokens array<int>")


def token_budget(
    docs: DataFrame, limit: int = LIMIT, model_file: str | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_bytes, n_tokens, fit_chars): fit_chars is the longest prefix within ``limit`` tokens."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, fits = [], []
            for found in _counted(model_file, batch.column(1)):
                totals.append(found.total())
                fits.append(found.longest_within(limit))
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(totals, pa.int64()), pa.array(fits, pa.int64())],
                [key, "n_bytes", "n_tokens", "fit_chars"],
            )

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(key, text, size).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, fit_chars long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_budget(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")
