"""Operator 13: ranked lexical search by WAND over an inverted index of document shards.

1. ``build_index`` deals documents to shards of a bounded size of text, in the order in which
   their task reads them, and writes each shard's posting lists: one scan of the texts.
2. ``search`` takes the items in blocks.  For a block the shards first say in how many
   documents each of its terms stands; terms are then weighted alike in all shards.
3. In a shard a term's list has its greatest impact.  Cursors over an item's lists are kept
   in document order; the pivot is the first cursor at which the sum of those impacts
   reaches the lowest score of the item's heap.  Documents before it can't enter the heap, so
   the cursors before it skip to it; a document is scored where all of them stand on it.
   A task carries an item's heap from shard to shard, and the tasks' heaps are merged.

Scores are whole numbers: a term's weight is ``floor(1000 ln((2 N + 2) / (2 df + 1)))``, its
impact in a document ``weight * (1e9 tf div (1000 tf + 8 m))`` with ``m`` growing with the
document's length.  A pivot of equal sum is scored, so ties are exact.

Bounds: a task makes one shard (``SHARD_BYTES`` of text or one longer document) at a time and reads two; the driver
holds one block of items (``BLOCK_BYTES`` of text or one longer item) and a number for each of
its terms, which is what is broadcast, and lets go of it when the block's rows are written.
Rows shuffled: one for each task and term of a block, and ``k`` for each task and item.

Cases: a null text, or one without a term, is no document and an item without results; rows
of one id are documents of their own, as are repeated items, each with ranks from 1; a null
document id ranks last among equals; a null item id is an item; a text of any length is read
whole; an empty table, of documents or items, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.llm.common import FOLD, pack, saved, table, unpack

SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
MOST = 10
#: A document's length counts for this share of its average, in hundredths.
LENGTH_SHARE = 75
UNIT = 1_000_000_000
_END = 1 << 62


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class _Ids(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def shard_lists(split: list[list[bytes]]) -> tuple[bytes, bytes, bytes]:
    """The words of some documents, where each one's postings start, and the postings (document and count)."""
    ids = _Ids()
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter(map(ids.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
    entry, count = np.unique(words * len(split) + np.repeat(np.arange(len(split)), lengths), return_counts=True)
    word, doc = np.divmod(entry, max(len(split), 1))
    starts = np.searchsorted(word, np.arange(len(ids) + 1))
    return b" ".join(ids), starts.astype(np.int32).tobytes(), pack(doc.astype(np.int32), count.astype(np.int32))


@contextmanager
def few_rows(spark: SparkSession, rows: int = 2):
    """Jobs that run inside send ``rows`` rows at a time to Python: a row of the index is megabytes."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each shard: keys and lengths of its documents, and its posting lists."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).where("text is not null")
    kind = rows.schema["key"].dataType.simpleString()
    most = SHARD_BYTES
    schema = f"keys array<{kind}>, n_docs long, n_terms long, lengths binary, words binary, starts binary, postings binary"

    def shard(keys: list, split: list[list[bytes]], of: pa.DataType) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        columns = [pa.array([keys], pa.list_(of)), pa.array([len(split)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
        columns += [pa.array([x], pa.binary()) for x in (lengths.tobytes(), *shard_lists(split))]
        return pa.RecordBatch.from_arrays(columns, names=["keys", "n_docs", "n_terms", "lengths", "words", "starts", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, split, size, of = [], [], 0, None
        for batch in batches:
            of = batch.column("key").type
            for name, body in zip(batch.column("key"), batch.column("text")):
                body = body.as_py()
                if terms := terms_of(body):
                    keys.append(name.as_py())
                    split.append(terms)
                    size += len(body)
                if size >= most:
                    yield shard(keys, split, of)
                    keys, split, size = [], [], 0
        if split:
            yield shard(keys, split, of)

    return saved(rows.mapInArrow(run, schema))


class Item(NamedTuple):
    key: object
    terms: dict[int, int]  # term and how often it stands in the item


class Block(NamedTuple):
    first: int  # number of its first item
    items: list[Item]
    terms: dict[bytes, int]


def blocks(items: DataFrame, key: str, text: str) -> Iterator[Block]:
    """The items in blocks of at most ``BLOCK_BYTES`` (or one item); one block is held at a time."""
    rows = items.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).where("text is not null")
    made, size, done = Block(0, [], _Ids()), 0, 0
    for name, body in rows.toLocalIterator():
        if terms := Counter(map(made.terms.__getitem__, terms_of(bytes(body)))):
            made.items.append(Item(name, dict(terms)))
            size += len(body)
            done += 1
        if size >= BLOCK_BYTES:
            yield made
            made, size = Block(done, [], _Ids()), 0
    if made.items:
        yield made


def document_counts(index: DataFrame, terms: dict[bytes, int]) -> dict[int, int]:
    """In how many documents of all shards each of ``terms`` stands."""
    shared = index.sparkSession.sparkContext.broadcast(dict(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for batch in batches:
            for words, starts in zip(batch.column("words"), batch.column("starts")):
                n = np.diff(np.frombuffer(starts.as_py(), np.int32)).tolist()
                for term, count in zip(map(shared.value.get, words.as_py().split(b" ")), n):
                    if term is not None:
                        totals[term] += count
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(totals), pa.int64()), "n": pa.array(list(totals.values()), pa.int64())})

    counts = index.select("words", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    with few_rows(index.sparkSession):
        found = dict(map(tuple, counts.collect()))  # a row for each term of the block at most
    shared.destroy()
    return found


class Best:
    """The best documents of an item so far: (-score, key is null, key), best first."""

    def __init__(self, most: int):
        self.most, self.found, self.floor = most, [], 1

    def offer(self, score: int, key: object) -> None:
        insort(self.found, (-score, key is None, key))
        del self.found[self.most :]
        if len(self.found) == self.most:
            self.floor = -self.found[-1][0]


#: A list's documents and their impacts, ended by a mark, and the greatest impact.
Postings = tuple[list[int], list[int], int]


def wand(lists: list[Postings], repeats: list[int], keys: list, best: Best) -> int:
    """Offer to ``best`` all documents of a shard that can enter it; returns how many were scored."""
    cursors = [[docs[0], 0, docs, impacts, bound * n, n] for (docs, impacts, bound), n in zip(lists, repeats)]
    by_document, scored = itemgetter(0), 0
    while True:
        cursors.sort(key=by_document)
        reach, pivot = 0, _END
        for cursor in cursors:
            reach += cursor[4]
            if reach >= best.floor:
                pivot = cursor[0]
                break
        if pivot == _END:
            return scored
        if cursors[0][0] < pivot:
            for cursor in cursors:
                if cursor[0] >= pivot:
                    break
                cursor[1] = bisect_left(cursor[2], pivot, cursor[1])
                cursor[0] = cursor[2][cursor[1]]
            continue
        score = 0
        for cursor in cursors:
            if cursor[0] != pivot:
                break
            score += cursor[3][cursor[1]] * cursor[5]
            cursor[1] += 1
            cursor[0] = cursor[2][cursor[1]]
        scored += 1
        if score >= best.floor:
            best.offer(score, keys[pivot])


class Shard:
    """The lists of a shard for the terms of a block, made when first asked for."""

    def __init__(self, row: dict, terms: dict[bytes, int], weights: dict[int, int], n_docs: int, n_terms: int):
        self.keys = row["keys"]
        lengths = np.frombuffer(row["lengths"], np.int64).tolist()
        self.slow = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms for n in lengths], np.int64)
        self.starts = np.frombuffer(row["starts"], np.int32)
        self.docs, self.counts = unpack(row["postings"], "ii")
        self.at = {t: k for k, t in enumerate(map(terms.get, row["words"].split(b" "))) if t is not None and weights[t]}
        self.weights, self.made = weights, {}

    def postings(self, term: int) -> Postings:
        if term not in self.made:
            part = slice(self.starts[self.at[term]], self.starts[self.at[term] + 1])
            docs, n = self.docs[part], self.counts[part].astype(np.int64)
            impacts = self.weights[term] * (UNIT * n // (1000 * n + 8 * self.slow[docs]))
            self.made[term] = [*docs.tolist(), _END], impacts.tolist(), int(impacts.max())
        return self.made[term]


def search(index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(item_id, rank, key, score): the ``most`` best documents of each item, those of score 0 left out."""
    spark = index.sparkSession
    n_docs, n_terms = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    key_kind = index.schema["keys"].dataType.elementType.simpleString()
    schema = f"item long, item_id {items.schema[item].dataType.simpleString()}, key {key_kind}, score long"
    parts = []
    for block in blocks(items, item, text) if n_docs else ():
        counts = document_counts(index, block.terms)
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts[t] + 1))) if t in counts else 0 for t in block.terms.values()}
        shared = spark.sparkContext.broadcast((block.first, block.items, dict(block.terms), weights))
        found = index.mapInArrow(_searching(shared, to_arrow_type(items.schema[item].dataType), n_docs, n_terms, most), schema)
        with few_rows(spark):
            parts.append(saved(_ranked(found, most)))
        shared.destroy()
    if not parts:
        parts = [_ranked(spark.createDataFrame([], schema), most)]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.select("item_id", "rank", "key", "score")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def _searching(shared, of_item: pa.DataType, n_docs: int, n_terms: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, items, terms, weights = shared.value
        heaps, kind = [Best(most) for _ in items], None
        for batch in batches:
            kind = batch.schema.field("keys").type.value_type
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("keys", "lengths", "words", "starts", "postings")}
                shard = Shard(row, terms, weights, n_docs, n_terms)
                for one, best in zip(items, heaps):
                    held = [t for t in one.terms if t in shard.at]
                    if held:
                        wand([shard.postings(t) for t in held], [one.terms[t] for t in held], shard.keys, best)
        rows = [(first + i, one.key, key, -low) for i, (one, best) in enumerate(zip(items, heaps)) for low, _, key in best.found]
        if rows:
            number, names, keys, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), pa.array(names, of_item), pa.array(keys, kind), pa.array(scores, pa.int64())], names=["item", "item_id", "key", "score"]
            )

    return run


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("key").alias("doc_id"), "score")


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, {100 - LENGTH_SHARE} + ({LENGTH_SHARE} * len(w)::BIGINT * n_docs) // n_terms AS m FROM d, c WHERE len(w) > 0),
q AS (SELECT i, item_id, t, count(*)::BIGINT AS k FROM (SELECT i, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, c),
s AS (
  SELECT i, item_id, r, doc_id, sum(k * w * (({UNIT} * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
WHERE rank <= {MOST}
"""
