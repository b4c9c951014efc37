"""Operator 2: language-model scores by cross-entropy difference.

Two bigram models over one vocabulary, smoothed alike (Witten-Bell over add-one unigrams): the
target model counts the documents labelled good, the background model all others.  The score of
a text is its mean loss per token under the target less that under the background, in bits:
the lower, the more the text reads like the target.

``corpus_scores`` gives every word of the documents an id of its own (a 63-bit hash) and counts
every pair of words (by a 64-bit hash), so its models grow with the input; they are never in
one place.  A document's own counts are left out of the model that has them while it is scored,
so a document of the target is not told by having been counted there.

Cases: null or empty texts have 0 tokens and null scores; texts are read whole; repeated rows
count each time they occur and get equal scores; without target documents the target model is
the uniform one; null labels are no target; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import FOLD, table


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


#: Bytes of text in a block, in a shard of word pairs and in a shard of words: their numbers grow with the input.
BLOCK_BYTES, PAIR_SHARD_BYTES, WORD_SHARD_BYTES = 16 << 20, 16 << 20, 64 << 20
ROW = "shard int, block int, body binary"
#: Tokens of texts that are scored together (or one text).
TOKENS = 1 << 17


class Hashes(dict):
    """63-bit hash of each word met; 0 is left for a text's start."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = (int.from_bytes(blake2b(word, digest_size=8).digest(), "little") >> 1) or 1
        return found


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([a.nbytes for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def unpack(body: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays of ``pack``, by their type codes; ``n`` stands for counts packed by ``small``, ``k`` for keys by ``short``."""
    plain = kinds.replace("n", "Bq").replace("k", "HI")
    ends = np.cumsum(np.frombuffer(body, np.int64, len(plain))) + 8 * len(plain)
    parts = iter([np.frombuffer(body[a:b], kind) for kind, a, b in zip(plain, [8 * len(plain), *ends], ends)])
    out = []
    for kind in kinds:
        part = next(parts)
        if kind == "n":
            low, part = part, part.astype(np.int64)
            part[low == 255] = next(parts)
        elif kind == "k":
            part = part.astype(np.int64) << 32 | next(parts)
        out.append(part)
    return out


def small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each count; those of 255 and more follow in full."""
    return np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.int64)


def short(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper 48 bits of each key: of the pairs of one shard, a few million, they tell each from the others."""
    return (keys >> np.uint64(48)).astype(np.uint16), (keys >> np.uint64(16)).astype(np.uint32)


class Block(NamedTuple):
    words: np.ndarray  # hashes, in order
    before: np.ndarray  # of each distinct pair, in order: places in ``words``
    after: np.ndarray
    tokens: np.ndarray  # the pair of each token
    lengths: np.ndarray  # tokens of each text

    def keys(self) -> np.ndarray:
        """64-bit hash of each pair."""
        x = self.words[self.before].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) + self.words[self.after].view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


HASHES = Hashes()


def block_of(texts: pa.ChunkedArray) -> Block:
    found, lengths = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = words_of(text.as_py())
        lengths[k] = len(words)
        own = np.zeros(len(words) + 1, np.int64)
        own[1:] = np.fromiter(map(HASHES.__getitem__, words), np.int64, len(words))
        found.append(own)
    words, stream = np.unique(np.concatenate(found), return_inverse=True)
    inner = np.ones(len(stream), bool)
    inner[np.cumsum(lengths + 1) - lengths - 1] = False
    at = np.flatnonzero(inner)
    pairs, tokens = np.unique(stream[at - 1] * max(len(words), 1) + stream[at], return_inverse=True)
    return Block(words, pairs // max(len(words), 1), pairs % max(len(words), 1), tokens, lengths)


def dealt(hashes: np.ndarray, shards: int) -> list[np.ndarray]:
    """The places of each shard's hashes, in order."""
    own = (hashes.view(np.uint64) % np.uint64(shards)).astype(np.uint32)
    order = np.argsort(own, kind="stable")
    return np.split(order, np.searchsorted(own[order], np.arange(1, shards)))


def rows_of(shards: list[int], blocks: list[int], bodies: list[bytes]) -> pa.Table:
    return pa.table([pa.array(shards, pa.int32()), pa.array(blocks, pa.int32()), pa.array(bodies, pa.binary())], ["shard", "block", "body"])


def ids_sent(ids: pa.ChunkedArray) -> bytes:
    """The distinct ids in Arrow's own form, whatever characters they hold."""
    out, rows = pa.BufferOutputStream(), pa.table([ids.unique()], ["id"])
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


def ids_got(body: bytes) -> pa.Array:
    return pa.ipc.open_stream(body).read_all()["id"].combine_chunks()


def summed(at: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, counts, size).astype(np.int64)  # exact below 2 ** 53


def text_losses(found: Block, texts: slice, at: slice, target: np.ndarray, pairs: np.ndarray, words: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Mean bits a token of some texts under the target and the background, without each text's own counts.

    ``at``: the tokens of the texts; ``pairs``, ``words``, ``totals``: counts of the corpus, in all and in the target.
    """
    tokens, lengths = found.tokens[at], found.lengths[texts]
    text = np.repeat(np.arange(len(lengths)), lengths)
    after, before = found.after[tokens], found.before[tokens]
    _, first, of_pair = np.unique(text * len(found.before) + tokens, return_index=True, return_inverse=True)
    times = np.bincount(of_pair)
    _, of_after = np.unique(text * len(found.words) + after, return_inverse=True)
    _, of_before = np.unique(text * len(found.words) + before, return_inverse=True)
    own_after, own_before = np.bincount(of_after)[of_after], np.bincount(of_before)[of_before]
    mean = np.zeros((2, len(lengths)))
    for row, k in enumerate((1, 0)):  # the target, then the background: all less the target
        n, used, follows = (x[k] if k else x[0] - x[1] for x in (pairs[:2, tokens], words[:2, after], words[2:4, before]))
        total = totals[2] if k else totals[1] - totals[2]
        mine = target[text] == bool(k)  # tokens that this model has counted
        last = mine[first] & (n[first] == times)  # pairs that no other text has
        own_kinds = np.bincount(of_before[first], last)[of_before] if len(first) else np.zeros(0)
        left = lambda x, y: x - np.where(mine, y, 0)
        plain = (left(used, own_after) + 1) / (left(total, lengths[text]) + totals[0] + 2)  # the words, the start and an unknown one
        kinds = np.maximum(left(words[4 + k, before], own_kinds), 1)
        bits = -np.log2((left(n, times[of_pair]) + kinds * plain) / (left(follows, own_before) + kinds))
        mean[row] = np.bincount(text, bits, len(lengths)) / np.maximum(lengths, 1)
    return mean


def corpus_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, n_tokens, target_bits, background_bits, difference) under models of all words and pairs of ``docs``.

    Documents are dealt to blocks by a hash of the key.  A block sends each shard of pairs its distinct ones with their
    counts and gets back the counts of the corpus, so a frequent pair is one row a block wherever it is counted.  The
    lowest block that holds a pair then adds its counts to those of its two words, which shards of words sum up likewise.
    """
    kind = docs.schema[key].dataType
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
    blocks, pair_shards, word_shards = (int(size // x) + 1 for x in (BLOCK_BYTES, PAIR_SHARD_BYTES, WORD_SHARD_BYTES))
    block = F.pmod(F.xxhash64(F.col("id")), F.lit(blocks)).cast("int").alias("block")
    # rows without an id are dealt by their text: a null leaves the hash as it is
    spread = F.pmod(F.xxhash64(F.col("id"), F.when(F.col("id").isNull(), F.col("text"))), F.lit(blocks)).cast("int").alias("block")
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text")).select(spread, "id", "text").groupBy("block")
    good = labels.where(F.col(label) == 1).select(F.col(key).cast(kind).alias("id")).select(block, "id").groupBy("block")

    def ask_pairs(name: tuple, own: pa.Table, good: pa.Table) -> pa.Table:
        if not own.num_rows:
            return rows_of([], [], [])
        found = block_of(own["text"])
        target = pc.is_in(own["id"], value_set=good["id"].combine_chunks(), skip_nulls=True).to_numpy()
        n = np.bincount(found.tokens, minlength=len(found.before))
        t = np.bincount(found.tokens[np.repeat(target, found.lengths)], minlength=len(found.before))
        keys = found.keys()
        asked = {k: pack(*short(keys[at]), *small(n[at]), *small(t[at])) for k, at in enumerate(dealt(keys, pair_shards)) if len(at)}
        # which of the block's documents are the target, to the block itself
        asked[-1 - name[0].as_py()] = ids_sent(own["id"].filter(pa.array(target)))
        return rows_of(list(asked), [name[0].as_py()] * len(asked), list(asked.values()))

    def joined(rows: pa.Table, kinds: str) -> tuple[list[np.ndarray], np.ndarray]:
        """The arrays of all requests, end to end, and the ends of the requests."""
        parts = [unpack(x.as_py(), kinds) for x in rows["body"]]
        return [np.concatenate(x) for x in zip(*parts)], np.cumsum([len(x[0]) for x in parts])

    def answer_pairs(rows: pa.Table) -> pa.Table:
        if rows["shard"][0].as_py() < 0:
            return rows
        rows = rows.sort_by("block")
        (keys, n, t), ends = joined(rows, "knn")
        _, first, at = np.unique(keys, return_index=True, return_inverse=True)
        n, t = (summed(at, x, len(first))[at] for x in (n, t))
        mine = np.zeros(len(keys), bool)
        mine[first] = True
        bodies = [pack(*small(n[a:b]), *small(t[a:b]), np.packbits(mine[a:b])) for a, b in zip([0, *ends], ends)]
        return rows_of(rows["shard"].to_pylist(), rows["block"].to_pylist(), bodies)

    def pairs_of(found: Block, bodies: dict[int, pa.BinaryScalar]) -> np.ndarray:
        """Of each pair its counts, in all and in the target, and whether this block is the one to tell them to its words."""
        pairs = np.zeros((3, len(found.before)), np.int64)
        for shard, at in enumerate(dealt(found.keys(), pair_shards)):
            if len(at):
                n, t, mine = unpack(bodies[shard].as_py(), "nnB")
                pairs[:, at] = n, t, np.unpackbits(mine, count=len(at))
        return pairs

    def ask_words(name: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return rows_of([], [], [])
        found = block_of(own["text"])
        n, t, mine = pairs_of(found, dict(zip(answers["shard"].to_pylist(), answers["body"])))
        sums = [(found.after, n), (found.after, t), (found.before, n), (found.before, t), (found.before, n > t), (found.before, t > 0)]
        counts = [summed(at, x * mine, len(found.words)) for at, x in sums]
        # an empty request too: the answer brings the shard's totals
        bodies = [pack(found.words[at], *(y for x in counts for y in small(x[at]))) for at in dealt(found.words, word_shards)]
        return rows_of(list(range(word_shards)), [name[0].as_py()] * word_shards, bodies)

    def answer_words(rows: pa.Table) -> pa.Table:
        (words, *counts), ends = joined(rows, "qnnnnnn")
        known, at = np.unique(words, return_inverse=True)
        counts = [summed(at, x, len(known)) for x in counts]
        totals = np.array([np.count_nonzero(known), counts[0].sum(), counts[1].sum()], np.int64)
        bodies = [pack(totals, *(y for x in counts for y in small(x[at[a:b]]))) for a, b in zip([0, *ends], ends)]
        return rows_of([pair_shards + x for x in rows["shard"].to_pylist()], rows["block"].to_pylist(), bodies)

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        found = block_of(own["text"])
        bodies = dict(zip(answers["shard"].to_pylist(), answers["body"]))
        pairs, words, totals = pairs_of(found, bodies), np.zeros((6, len(found.words))), np.zeros(3)
        for shard, at in enumerate(dealt(found.words, word_shards), pair_shards):
            own_totals, *counts = unpack(bodies[shard].as_py(), "qnnnnnn")
            totals += own_totals
            words[:, at] = counts
        good = ids_got(bodies[-1 - own["block"][0].as_py()].as_py())
        target = pc.is_in(own["id"], value_set=good, skip_nulls=True).to_numpy()
        mean = np.zeros((2, len(found.lengths)))
        ends = np.cumsum(found.lengths)
        first = 0
        while first < len(ends):  # some texts at a time: what follows is an array of all their tokens, many times
            start = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + TOKENS, "right")))
            mean[:, first:last] = text_losses(found, slice(first, last), slice(start, int(ends[last - 1])), target[first:last], pairs, words, totals)
            first = last
        none = found.lengths == 0
        columns = [pa.array(x, pa.float64(), mask=none) for x in (mean[0], mean[1], mean[0] - mean[1])]
        return pa.table([own["id"], pa.array(found.lengths), *columns], [key, "n_tokens", "target_bits", "background_bits", "difference"])

    pairs = texts.cogroup(good).applyInArrow(ask_pairs, ROW).groupBy("shard").applyInArrow(answer_pairs, ROW)
    words = texts.cogroup(pairs.groupBy("block")).applyInArrow(ask_words, ROW).groupBy("shard").applyInArrow(answer_words, ROW)
    schema = f"`{key}` {kind.simpleString()}, n_tokens long, target_bits double, background_bits double, difference double"
    return texts.cogroup(pairs.union(words).groupBy("block")).applyInArrow(score, schema)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
