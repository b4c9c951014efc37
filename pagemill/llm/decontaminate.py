"""Operator 3: benchmark decontamination with suffix arrays of the training texts.

Each shard (the documents of one Arrow batch, cut at ``SHARD_BYTES``) gets a suffix array
over its words.  Every test suffix is looked up in it by binary search: its range holds all
places where its next ``WINDOW`` words occur.  The range is then narrowed by one more word at a
time, suffixes with the same words together, until no place is left; so each place gets its
longest verbatim match.  The union of the matches gives the words hit; a document with any is
contaminated, and the report has its longest match with its place.  ``matches`` lists the maximal
matches with every item.

A training suffix that shares no opening ``PROBE`` words with any test suffix can't match,
so the array holds the stretches around suffixes that do: a lossless cut, found by hash
and then decided by comparing words.

Scale: a narrow map over documents, no shuffle.  The benchmark is the stated query set; it
is read in blocks of at most ``BLOCK_BYTES``, each broadcast on its own and applied in turn
to all rows; after ``BLOCKS`` of them the table so far is written and read again, so a task never
holds more.  A shard's memory is bounded by its size, not by the number of matches:
the places of a window are counted once, whatever number of items hold it.

Cases: null texts have no words and match nothing; an item of fewer than ten words is one
window, an item without words is none; null item ids are left out; repeated items count
once; repeated documents get equal results; an empty benchmark leaves all documents clean;
texts are read whole; other columns are kept by ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import FOLD, free_name, own_columns, saved, table

WINDOW, PROBE = 10, 4
BLOCK_BYTES, SHARD_BYTES, BLOCKS = 16 << 20, 4 << 20, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _codes(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` ids from each place on; the last places are left out."""
    n = max(len(ids) - length + 1, 0)
    code = np.zeros(n, np.uint64)
    for k in range(length):
        code = (code ^ ids[k : k + n].astype(np.uint64)) * _MIX
        code ^= code >> np.uint64(29)
    return code


class Tests(NamedTuple):
    """One block of the benchmark: words as ids from 1, in the order of the words."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray  # of all items, a 0 after each
    item: np.ndarray  # item number at each place
    names: list[str]
    probes: dict[int, np.ndarray]  # probe length: sorted hashes
    windows: dict[int, np.ndarray]  # window length: a start of each distinct window
    holders: dict[int, list[np.ndarray]]  # window length: for each of those, its items
    longest: int
    suffixes: np.ndarray  # start of each whole window
    opening: np.ndarray  # and its number among the distinct ones

    @staticmethod
    def build(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Tests:
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        parts, number, starts = [], [], {}
        names = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(names)}
        at = 0
        for name, ws in items:
            parts += [vocabulary[w] for w in ws] + [0]
            number += [place[name]] * (len(ws) + 1)
            length = min(window, len(ws))
            starts.setdefault(length, []).extend(range(at, at + len(ws) - length + 1))
            at += len(ws) + 1
        ids, item = np.array(parts, np.int32), np.array(number, np.int32)
        probes: dict[int, list[np.ndarray]] = {}
        windows, holders, suffixes, opening = {}, {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for length, places in starts.items():
            rows = ids[np.array(places)[:, None] + np.arange(length)]
            _, first, back = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            back = back.ravel()
            windows[length] = np.array(places)[first]
            if length == window:
                suffixes, opening = np.array(places), back
            order = np.argsort(back, kind="stable")
            split = np.split(item[np.array(places)[order]], np.cumsum(np.bincount(back))[:-1])
            holders[length] = [np.unique(x) for x in split]
            q = min(PROBE, length)
            # every suffix of a match has to be kept down to its last PROBE words
            probes.setdefault(q, []).append(_windows_codes(ids, places, length, q))
        longest = max((len(ws) for _, ws in items), default=0)
        return Tests(vocabulary, ids, item, names, {q: np.unique(np.concatenate(v)) for q, v in probes.items()}, windows, holders, longest, suffixes, opening)


def _windows_codes(ids: np.ndarray, places: list[int], length: int, q: int) -> np.ndarray:
    """Hashes of the q-grams inside the windows that start at ``places``."""
    inside = np.zeros(len(ids) + 1, bool)
    for k in range(length - q + 1):
        inside[np.array(places) + k] = True
    return _codes(ids, q)[np.flatnonzero(inside[: max(len(ids) - q + 1, 0)])]


class SuffixArray(NamedTuple):
    """Words of a shard and the order of its suffixes; a 0 ends every stretch."""

    words: np.ndarray
    order: np.ndarray

    @staticmethod
    def build(words: np.ndarray, depth: int) -> SuffixArray:
        """Prefix doubling, up to suffixes of ``depth`` words: no longer match is asked for."""
        rank, n, reach = words.astype(np.int64), len(words), 1
        order = np.argsort(rank, kind="stable")
        while reach < depth and n:
            ahead = np.zeros(n, np.int64)
            ahead[:-reach or None] = rank[reach:] if reach < n else 0
            both = rank * (int(rank.max()) + 2) + ahead + 1
            order = np.argsort(both, kind="stable")
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(both[order[1:]] != both[order[:-1]])
            rank, reach = new, reach * 2
            if rank[order[-1]] == n - 1:
                break
        return SuffixArray(words, order)

    def ranges(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of word ids: the first and past-the-last suffix that opens with it."""
        padded = np.concatenate([self.words, np.zeros(wanted.shape[1], self.words.dtype)])
        return self._bound(wanted, padded, False), self._bound(wanted, padded, True)

    def _bound(self, wanted: np.ndarray, padded: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.order), np.int64)
        across, rows = np.arange(wanted.shape[1]), np.arange(len(wanted))
        for _ in range(len(self.order).bit_length()):
            open_ = low < high
            middle = np.where(open_, (low + high) // 2, 0)
            seen = padded[self.order[middle][:, None] + across]
            first = (seen != wanted).argmax(axis=1)
            a, b = seen[rows, first], wanted[rows, first]
            right = open_ & ((a < b) | (after & (a == b)))
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        return low


    def narrowed(self, low: np.ndarray, high: np.ndarray, depth: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each range, whose suffixes share ``depth`` words, that goes on with the word."""
        last = len(self.words) - 1

        def bound(after: bool) -> np.ndarray:
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                middle = np.where(open_, (a + b) // 2, 0)
                seen = self.words[np.minimum(self.order[middle] + depth, last)]
                right = open_ & ((seen < words) | (after & (seen == words)))
                a, b = np.where(right, middle + 1, a), np.where(open_ & ~right, middle, b)
            return a

        return bound(False), bound(True)


def longest_matches(array: SuffixArray, tests: Tests, low: np.ndarray, high: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each place of the array the words of its longest match with a test suffix, 0 for none.

    ``low``, ``high``: the range of each distinct window.  Test suffixes that share their words so far are one range.
    """
    most = np.zeros(len(array.words), np.int64)
    group, suffix, depth = tests.opening, tests.suffixes, window
    while len(suffix):
        held = high > low
        sizes = np.where(held, high - low, 0)
        offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        most[array.order[np.repeat(low, sizes) + offset]] = depth
        word = tests.ids[np.minimum(suffix + depth, len(tests.ids) - 1)]
        on = held[group] & (word > 0)
        group, suffix, word = group[on], suffix[on], word[on]
        kinds, group = np.unique(group.astype(np.int64) << 32 | word.astype(np.int64), return_inverse=True)
        low, high = array.narrowed(low[kinds >> 32], high[kinds >> 32], depth, (kinds & 0xFFFFFFFF).astype(array.words.dtype))
        depth += 1
    return most


class Found(NamedTuple):
    """Places of one shard where a window occurs: parallel arrays."""

    place: np.ndarray  # in the shard's words, documents one after another
    length: np.ndarray  # of the window
    window: np.ndarray  # its number among the distinct windows of that length
    match: np.ndarray  # words of the longest match that starts there


def search(ids: np.ndarray, tests: Tests) -> Found:
    """All windows of ``tests`` in a shard's ids (0: a word that no item has, or a text's end)."""
    keep = np.zeros(len(ids) + PROBE, bool)
    for q, wanted in tests.probes.items():
        code = _codes(ids, q)
        if not len(code):
            continue
        quick = np.zeros(1 << 20, bool)
        quick[(wanted >> np.uint64(44)).astype(np.int64)] = True
        maybe = np.flatnonzero(quick[(code >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(wanted, code[maybe])
        maybe = maybe[wanted[np.minimum(at, len(wanted) - 1)] == code[maybe]]
        for k in range(q):
            keep[maybe + k] = True
    kept = np.flatnonzero(keep[: len(ids)])
    if not len(kept):
        return Found(*[np.zeros(0, np.int64)] * 4)
    # stretches one after another, each closed by a 0
    gap = np.concatenate([[0], np.cumsum(np.diff(kept) > 1)])
    words = np.zeros(len(kept) + int(gap[-1]) + 1, ids.dtype)
    words[np.arange(len(kept)) + gap] = ids[kept]
    origin = np.full(len(words), -1, np.int64)
    origin[np.arange(len(kept)) + gap] = kept
    array = SuffixArray.build(words, tests.longest)
    found = []
    for length, starts in tests.windows.items():
        low, high = array.ranges(tests.ids[starts[:, None] + np.arange(length)])
        number = high - low
        which = np.repeat(np.arange(len(starts)), number)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
        place = array.order[np.repeat(low, number) + offset]
        match = longest_matches(array, tests, low, high)[place] if length == WINDOW else np.full(len(which), length)
        found.append(Found(origin[place], np.full(len(which), length), which, match))
    return Found(*map(np.concatenate, zip(*found)))


def _shards(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    shard, size = [], 0
    for value in texts:
        text = value.as_py() or b""
        shard.append(words_of(text))
        size += len(text)
        if size >= SHARD_BYTES:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def _ids(shard: list[list[bytes]], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of a shard with a 0 after each text, and where each text starts."""
    get = vocabulary.get
    sizes = np.fromiter((len(ws) + 1 for ws in shard), np.int64, len(shard))
    ids = np.zeros(int(sizes.sum()), np.int32)
    starts = np.cumsum(sizes) - sizes
    for at, ws in zip(starts, shard):
        ids[at : at + len(ws)] = np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws))
    return ids, starts


def blocks(benchmark: DataFrame, key: str, text: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most ``most`` bytes (or one item); one block is held at a time."""
    rows = benchmark.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    block, size = [], 0
    for name, body in rows.select(F.col(key).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        if words := words_of(bytes(body)):
            block.append((name, words))
            size += len(body)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


HIT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()), T.StructField("longest_start", T.LongType())])
MATCH = "array<struct<item_id:string,item_start:int,doc_start:int,n_words:int>>"


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "hits") -> DataFrame:
    """``docs`` with ``into``: n_words, hit (spans as start, end, start, ... in words), items, longest and longest_start.

    One struct for each block of the benchmark, in an array; longest is 0 and its start null where nothing is hit.
    """
    spark = docs.sparkSession
    found, waiting, part = docs, [], free_name(docs, into + "_part")

    def column(block: list) -> Column:
        shared = spark.sparkContext.broadcast(Tests.build(block))
        return F.arrow_udf(_hit_udf(shared), HIT).asNondeterministic()(F.col(text).cast("binary"))

    def joined(found: DataFrame, columns: list[Column]) -> DataFrame:
        more = found.select("*", F.array(*columns).alias(part))
        if into not in found.columns:
            return more.withColumnRenamed(part, into)
        return more.withColumn(into, F.concat(into, part)).drop(part)

    for block in blocks(benchmark, item, item_text):
        if len(waiting) == BLOCKS:
            found, waiting = saved(joined(found, waiting)), []
        waiting.append(column(block))
    if waiting or into not in found.columns:
        found = joined(found, waiting or [column([])])
    return found


def _hit_udf(shared: Broadcast):
    def run(texts: pa.Array) -> pa.Array:
        tests: Tests = shared.value
        n_words, spans, items, longest, start = [], [], [], [], []
        for shard in _shards(texts):
            ids, starts = _ids(shard, tests.vocabulary)
            n_words += map(len, shard)
            found = search(ids, tests)
            edges = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edges, found.place, 1)
            np.add.at(edges, found.place + found.length, -1)
            hit = np.concatenate([[False], np.cumsum(edges) > 0])
            flips = np.flatnonzero(hit[1:] != hit[:-1])  # start, end, start, ...
            of_flip = np.searchsorted(starts, flips[::2], "right") - 1
            of_place = np.searchsorted(starts, found.place, "right") - 1
            spans_of: dict[int, list[int]] = {}
            for d, a, b in zip(of_flip.tolist(), flips[::2].tolist(), flips[1::2].tolist()):
                spans_of.setdefault(d, []).extend((a - int(starts[d]), b - int(starts[d])))
            items_of: dict[int, set[int]] = {}
            seen = np.unique(np.stack([of_place, found.length, found.window]), axis=1) if len(of_place) else np.zeros((3, 0), int)
            for d, length, w in seen.T.tolist():
                items_of.setdefault(d, set()).update(tests.holders[length][w].tolist())
            best = np.lexsort((found.place, -found.match, of_place))  # of each document the longest match, then the first
            best = best[np.concatenate([[True], np.diff(of_place[best]) != 0])] if len(best) else best
            most = {d: (n, at - int(starts[d])) for d, n, at in zip(of_place[best].tolist(), found.match[best].tolist(), found.place[best].tolist())}
            for d in range(len(shard)):
                longest.append(most.get(d, (0, None))[0])
                start.append(most.get(d, (0, None))[1])
                spans.append(spans_of.get(d, []))
                items.append(sorted(tests.names[k] for k in items_of.get(d, ())))
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64()), pa.array(start, pa.int64())],
            ["n_words", "hit", "items", "longest", "longest_start"],
        )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, item_start, doc_start, n_words): every longest verbatim match and its places."""
    spark = docs.sparkSession
    columns = []
    for block in blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(Tests.build(block))
        columns.append(F.arrow_udf(_match_udf(shared), MATCH).asNondeterministic()(F.col(text).cast("binary")))
    if not columns:
        columns = [F.lit(None).cast(MATCH)]
    found = docs.select(key, F.flatten(F.array(*columns)).alias("__m"))
    return found.select(key, F.explode("__m").alias("__m")).select(key, "__m.*")


def _match_udf(shared: Broadcast):
    def run(texts: pa.Array) -> pa.Array:
        tests: Tests = shared.value
        item_starts = {int(k): int(np.flatnonzero(tests.item == k)[0]) for k in np.unique(tests.item)}
        same_window: dict[tuple[int, bytes], list[int]] = {}
        for length in tests.windows:
            whole = np.flatnonzero(_inside(tests.ids, length))
            for at in whole.tolist():
                same_window.setdefault((length, tests.ids[at : at + length].tobytes()), []).append(at)
        out = []
        for shard in _shards(texts):
            ids, starts = _ids(shard, tests.vocabulary)
            rows: list[list[dict]] = [[] for _ in shard]
            found = search(ids, tests)
            for place, length, _ in sorted(zip(found.place.tolist(), found.length.tolist(), found.window.tolist())):
                d = int(np.searchsorted(starts, place, "right")) - 1
                for at in same_window.get((length, ids[place : place + length].tobytes()), ()):
                    if place and at and ids[place - 1] and ids[place - 1] == tests.ids[at - 1]:
                        continue  # part of a match that began before
                    n = length
                    while ids[place + n] and ids[place + n] == tests.ids[at + n]:
                        n += 1
                    k = int(tests.item[at])
                    rows[d].append({"item_id": tests.names[k], "item_start": at - item_starts[k], "doc_start": place - int(starts[d]), "n_words": n})
            out += [list({tuple(r.values()): r for r in x}.values()) for x in rows]
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))
        return pa.array(out, kind)

    return run


def _inside(ids: np.ndarray, length: int) -> np.ndarray:
    """Places from which ``length`` words follow in the same item."""
    ok = np.zeros(len(ids), bool)
    n = max(len(ids) - length + 1, 0)
    ok[:n] = True
    for k in range(length):
        ok[:n] &= ids[k : k + n] > 0
    return ok


def removed_report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items, contaminated, longest, longest_start) for each document.

    longest: words of its longest verbatim match with an item, 0 for none; longest_start: the first word of the first such one.
    """
    found = hits(docs.select(key, text), benchmark, text, into="hits")

    def add(total, span):
        start = F.greatest(span["a"], total["end"])
        return F.struct((total["n"] + F.greatest(span["b"] - start, F.lit(0))).alias("n"), F.greatest(total["end"], span["b"]).alias("end"))

    def pairs(block):
        n = (F.size(block["hit"]) / 2).cast("int")
        empty = F.array().cast("array<struct<a:int,b:int>>")
        each = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.struct(F.get(block["hit"], 2 * k).alias("a"), F.get(block["hit"], 2 * k + 1).alias("b")),
        )
        return F.when(n > 0, each).otherwise(empty)

    spans = F.array_sort(F.flatten(F.transform("hits", pairs)))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda b: b["items"]))))
    best = F.array_max(F.transform("hits", lambda b: F.struct(b["longest"].alias("n"), (-b["longest_start"]).alias("before"))))
    counted = found.select(
        key,
        F.get("hits", F.lit(0))["n_words"].alias("n_words"),
        F.aggregate(spans, zero, add)["n"].cast("long").alias("n_hit"),
        items.alias("items"),
        best["n"].alias("longest"),
        (-best["before"]).alias("longest_start"),
    )
    return counted.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_start")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any match of the benchmark, with their own columns."""
    into = free_name(docs, "hits")
    found = hits(docs, benchmark, text, into=into)
    return found.where(~F.exists(into, lambda b: F.size(b["hit"]) > 0)).select(*own_columns(docs))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", "longest", "longest_start")


OP3_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
bw AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bl AS (SELECT *, least(10, len(w)) AS k FROM bw WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bl)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
m AS (SELECT dg.r, dg.i, dg.k, win.item_id FROM dg JOIN win USING (k, g)),
h AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
p AS (
  SELECT item, k, j, array_to_string(w[j:j + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM (SELECT *, row_number() OVER () AS item FROM bl))),
l AS (
  SELECT r, k, min(i) AS i, count(*) + k - 1 AS n FROM (
    SELECT DISTINCT r, k, item, dg.i, dg.i - j AS diagonal, dg.i - dense_rank() OVER (PARTITION BY r, k, item, dg.i - j ORDER BY dg.i) AS run
    FROM dg JOIN p USING (k, g)) GROUP BY r, k, item, diagonal, run),
b AS (SELECT r, max(n)::BIGINT AS longest FROM l GROUP BY r),
f AS (SELECT r, longest, min(i)::BIGINT - 1 AS longest_start FROM b JOIN l USING (r) WHERE n = longest GROUP BY r, longest),
t AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(longest, 0) AS longest, longest_start
FROM dw LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN f USING (r)
"""
