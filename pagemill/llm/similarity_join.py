"""Operator 6: n-gram Jaccard self-join by signature trees, and its components.

1. Counting.  Documents are dealt to blocks; a block asks shards of tokens how many documents
   hold each of its tokens.  A text of which less than four fifths of the tokens are in
   another text links with nothing, so only the others go on; equal sets are one class.
2. Trees.  Two linked classes share a token among the first ``n - ceil(0.8 n) + 1`` of their
   tokens, rarest first; each such token has a tree, whose leaves are the classes that hold it
   there.  A node holds its leaves' size range, the OR of their token bitmaps and the largest
   size that a partner of theirs may have.  A dual traversal starts from the pair of each
   tree's root with itself.  It prunes node pairs by sizes, by the most tokens that the bitmaps
   let them share, and where all leaves are linked already; whole sets decide pairs of leaves.
3. Rounds.  The first has the trees of each class's first tokens that others hold, a large one
   cut into parts on their own: it links most copies.  The second has all trees in which
   several components still meet, each pair of parts of a large one by itself.

A partner's largest size: of a class of ``n`` tokens that stands under its token number ``i``
(from 0), at most ``n - i`` tokens are shared with a class that it meets there first, and
``9 (n - i) >= 4 (n + m)`` must hold for the other's size ``m``.

Scale: texts are shuffled once, and two bytes and a count for each distinct token of a block.
A token that many documents hold is one entry a block.  Trees are dealt in parts of at most
twice ``leaves`` leaves; those of the component that has most leaves in a large tree are not
compared with each other.  No group of copies is expanded into pairs: links are those that
join components.

Cases: null or empty texts have no shingles and are linked with nothing; a text of fewer than
five words is one shingle; null ids are linked with nothing (component null); repeated rows
get equal results; rows of one id with several texts are one node; an empty table gives an
empty result; other columns, whatever their names, are kept by ``drop_near_copies``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import LOWER, WordHashes, narrow, pack, saved, table, unpack, widen
from pagemill.llm.components import components

SHINGLE = 5
#: Bits of a token's slot in its shard; two tokens in a slot only count as more frequent.
SLOT = 28
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Sizes(NamedTuple):
    """Sizes of what one task holds; numbers of blocks, shards and parts follow the input."""

    block: int = 6 << 20  # bytes of text in a block
    shard: int = 16 << 20  # bytes of text whose tokens are counted in a shard
    forest: int = 8 << 20  # bytes of sets in a task that holds trees
    leaves: int = 512  # leaves of a part of a tree
    first: int = 4  # trees of a class in the first round
    fanout: int = 8
    pairs: int = 1 << 13  # node pairs that are compared at once


SIZES = Sizes()
HASHES = WordHashes()


def sets_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after another; and their numbers."""
    words, lengths = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = (text.as_py() or b"").translate(LOWER).split()
        lengths[k] = len(found)
        words.append(np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found)))
    every = np.concatenate(words) if words else np.zeros(0, np.uint64)
    n = max(len(every) - SHINGLE + 1, 0)
    codes = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        codes = (codes ^ every[k : k + n]) * _MIX
        codes ^= codes >> np.uint64(29)
    out = []
    for start, length in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist()):
        if length >= SHINGLE:
            own = np.sort(codes[start : start + length - SHINGLE + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            whole = np.full(min(length, 1), length, np.uint64)
            for word in every[start : start + length]:
                whole = (whole ^ word) * _MIX2
                whole ^= whole >> np.uint64(31)
            out.append(whole)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.fromiter(map(len, out), np.int64, len(out))


# counting


class Asked(NamedTuple):
    """The distinct tokens of a block, by shard and slot."""

    slots: np.ndarray
    counts: np.ndarray  # documents of the block that hold each
    of_token: np.ndarray  # place of each token of the block
    ends: np.ndarray  # of the shards

    @staticmethod
    def of(tokens: np.ndarray, shards: int) -> Asked:
        distinct, back, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        shard = distinct % np.uint64(shards)
        slots = (distinct >> np.uint64(32)) & np.uint64((1 << SLOT) - 1)
        order = np.lexsort((slots, shard))
        place = np.zeros(len(order), np.int64)
        place[order] = np.arange(len(order))
        ends = np.searchsorted(shard[order], np.arange(shards, dtype=np.uint64), "right")
        return Asked(slots[order].astype(np.int64), counts[order], place[back], ends)


REQUEST = "shard int, block int, body binary"


def _requests(shards, blocks, bodies) -> pa.Table:
    return pa.table([pa.array(shards, pa.int32()), pa.array(blocks, pa.int32()), pa.array(bodies, pa.binary())], ["shard", "block", "body"])


def ask(block: int, texts, shards: int) -> pa.Table:
    """For each shard the block's slots, as gaps, and how many documents hold each."""
    asked = Asked.of(sets_of(texts)[0], shards)
    found = {}
    for shard, (a, b) in enumerate(zip([0, *asked.ends], asked.ends)):
        if a < b:
            gaps = np.diff(asked.slots[a:b], prepend=0)
            found[shard] = pack(*narrow(gaps, np.uint16), *narrow(asked.counts[a:b], np.uint8))
    return _requests(list(found), [block] * len(found), list(found.values()))


def answer(requests: pa.Table) -> pa.Table:
    """For each request the frequency class of its slots: 0 where one document holds it, then 1 for 2, 2 for 3 and 4, ..."""
    parts = [unpack(x.as_py(), "HqBq") for x in requests["body"]]
    slots = [np.cumsum(widen(gaps, more)) for gaps, more, _, _ in parts]
    counts = np.concatenate([widen(n, more) for _, _, n, more in parts])
    _, back = np.unique(np.concatenate(slots), return_inverse=True)
    total = np.bincount(back, counts).astype(np.int64)
    classes = np.frexp(total - 1)[1].astype(np.uint8)[back]
    ends = np.cumsum([len(x) for x in slots])
    bodies = [classes[a:b].tobytes() for a, b in zip([0, *ends], ends)]
    return _requests(requests["shard"].to_pylist(), requests["block"].to_pylist(), bodies)


def sketches(texts, answers: pa.Table, shards: int) -> dict[str, pa.Array]:
    """Of each text its size, the tokens that no other has, hashes of its set; of those that may link the prefix and the set."""
    tokens, sizes = sets_of(texts)
    asked = Asked.of(tokens, shards)
    classes = np.zeros(len(asked.slots), np.uint8)
    for shard, body in zip(answers["shard"].to_pylist(), answers["body"]):
        start = int(asked.ends[shard - 1]) if shard else 0
        classes[start : int(asked.ends[shard])] = np.frombuffer(body.as_py(), np.uint8)
    classes = classes[asked.of_token]
    ends = np.cumsum(sizes)
    alone = np.concatenate([[0], np.cumsum(classes == 0)])
    alone = alone[ends] - alone[ends - sizes]
    hashes = [(tokens * _MIX) ^ (tokens >> np.uint64(31)), (tokens ^ (tokens >> np.uint64(27))) * _MIX2]
    totals = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)]) for h in hashes]
    prefixes, sets = [], []
    for end, n, u in zip(ends.tolist(), sizes.tolist(), alone.tolist()):
        if not n or u > n // 5:
            prefixes.append(None)
            sets.append(None)
            continue
        own, kind = tokens[end - n : end], classes[end - n : end]
        shared = own[kind > 0]
        order = np.lexsort((shared, kind[kind > 0]))[: n // 5 + 1 - u]
        prefixes.append(shared[order].view(np.int64))
        sets.append(own.tobytes())
    return {
        "n": pa.array(sizes),
        "alone": pa.array(alone),
        **{f"s{k}": pa.array((t[ends] - t[ends - sizes]).view(np.int64)) for k, t in enumerate(totals)},
        "prefix": pa.array(prefixes, pa.list_(pa.int64())),
        "set": pa.array(sets, pa.binary()),
    }


def sketched(docs: DataFrame, key: str, text: str, sizes: Sizes) -> DataFrame:
    """(id, n, alone, s0, s1, prefix, set) of each row; prefix and set are null where no link can be."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
    blocks, shards = int(size // sizes.block) + 1, int(size // sizes.shard) + 1
    own = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    texts = own.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", "text").groupBy("block")
    kind = docs.schema[key].dataType.simpleString()

    def asking(name: tuple, rows: pa.Table) -> pa.Table:
        return ask(name[0].as_py(), rows["text"], shards)

    def sketching(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.table({"id": rows["id"], **sketches(rows["text"], answers, shards)})

    answers = texts.applyInArrow(asking, REQUEST).groupBy("shard").applyInArrow(answer, REQUEST)
    schema = f"id {kind}, n long, alone long, s0 long, s1 long, prefix array<long>, set binary"
    return texts.cogroup(answers.groupBy("block")).applyInArrow(sketching, schema)


# trees


class Level(NamedTuple):
    """Nodes of one depth of all trees of a task."""

    tree: np.ndarray
    low: np.ndarray  # sizes of the leaves below
    high: np.ndarray
    reach: np.ndarray  # largest size of a partner
    bits: np.ndarray  # OR of the token bitmaps
    spare: np.ndarray  # most tokens of a leaf beyond one a bit
    child: np.ndarray  # first child of each, and the end


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of 64-bit words for each set: the highest bits of a token name its bit."""
    shift = np.uint64(65 - bits.bit_length())
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for k in range(0, len(sets), 256):
        part = sets[k : k + 256]
        flags = np.zeros((len(part), bits), bool)
        flags[np.repeat(np.arange(len(part)), [len(s) for s in part]), (np.concatenate(part) >> shift).astype(np.int64)] = True
        out[k : k + 256] = np.packbits(flags, axis=1).view(np.uint64)
    return out


class Forest:
    """The signature trees of one task, and the components of their leaves as far as known."""

    def __init__(self, rows: pa.Table, sets: pa.Table, sizes: Sizes):
        self.sizes = sizes
        named = zip(*(sets[c].to_pylist() for c in ("leaf", "hash", "set")))
        self.sets = {(key, s0): np.frombuffer(own, np.uint64) for key, s0, own in named}
        number = {key: k for k, key in enumerate(self.sets)}
        self.sets = list(self.sets.values())
        rows = rows.combine_chunks()
        size, places = rows["n"].to_numpy(), [rows[c].to_numpy() for c in ("j", "i", "token")]
        ids = [np.array(rows[c].to_pylist()) for c in ("id", "root")]
        self.names, codes = np.unique(np.concatenate(ids), return_inverse=True)  # in the order of the ids
        code, root = np.split(codes.ravel(), 2)
        self.root = np.arange(len(self.names))
        self.root[code] = root
        self.known = self.root.copy()
        # leaves of a tree: those alone in their component by size, then the others by component
        several = np.bincount(self.root[np.unique(code)], minlength=len(self.names)) > 1
        order = np.lexsort((code, size, np.where(several[root], root + 1, 0), *places))
        new = np.any([np.diff(x[order]) != 0 for x in places], axis=0)
        self.code, self.size = code[order], size[order]
        own = np.fromiter((number[key] for key in zip(rows["id"].to_pylist(), rows["s0"].to_pylist())), np.int64, len(code))
        self.own = own[order]
        self.unlike: set[int] = set()
        bits = bitmaps(self.sets, 1 << int(np.clip((4 * int(size.max()) - 1).bit_length(), 9, 15)))
        spare = np.fromiter(map(len, self.sets), np.int64, len(self.sets)) - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [
            Level(
                np.concatenate([[0], np.cumsum(new)]), self.size, self.size, rows["reach"].to_numpy()[order],
                bits[self.own], spare[self.own], np.arange(len(order) + 1),
            )
        ]
        while len(self.levels[-1].tree) > self.levels[-1].tree[-1] + 1:
            self.levels.append(self.above(self.levels[-1]))

    def above(self, level: Level) -> Level:
        number = np.arange(len(level.tree))
        first = np.flatnonzero((number - np.searchsorted(level.tree, level.tree)) % self.sizes.fanout == 0)
        least, most = np.minimum.reduceat, np.maximum.reduceat
        return Level(
            level.tree[first], least(level.low, first), most(level.high, first), most(level.reach, first),
            np.bitwise_or.reduceat(level.bits, first, axis=0), most(level.spare, first), np.append(first, len(number)),
        )

    def spans(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the lowest and highest component of each node's leaves."""
        found = [(self.root[self.code],) * 2]
        for level in self.levels[1:]:
            low, high = found[-1]
            found.append((np.minimum.reduceat(low, level.child[:-1]), np.maximum.reduceat(high, level.child[:-1])))
        return found

    def open(self, depth: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node pairs that may hold a link between two components."""
        x, (low, high) = self.levels[depth], self.span[depth]
        one = (low[p] == high[p]) & (low[q] == high[q]) & (low[p] == low[q])
        fit = (x.low[p] <= x.reach[q]) & (x.low[q] <= x.reach[p]) & (5 * x.high[p] >= 4 * x.low[q]) & (5 * x.high[q] >= 4 * x.low[p])
        p, q = p[fit & ~one], q[fit & ~one]
        shared = np.bitwise_count(x.bits[p] & x.bits[q]).sum(axis=1, dtype=np.int64) + np.minimum(x.spare[p], x.spare[q])
        enough = 9 * shared >= 4 * (x.low[p] + x.low[q])
        return p[enough], q[enough]

    def below(self, depth: int, p: np.ndarray, q: np.ndarray) -> tuple[tuple, tuple]:
        """Pairs of the children: of different nodes, and of nodes with themselves."""
        child = self.levels[depth].child
        step = np.arange(self.sizes.fanout)
        i, j = child[p][:, None, None] + step[:, None], child[q][:, None, None] + step
        there = (i < child[p + 1][:, None, None]) & (j < child[q + 1][:, None, None]) & ((p != q)[:, None, None] | (i <= j))
        i, j = (np.broadcast_to(x, there.shape)[there] for x in (i, j))
        same = i == j
        return (i[~same], j[~same]), (i[same], j[same])

    def traverse(self) -> None:
        """From each root with itself down, a node with itself first, so that later pairs meet known components."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top].tree))
        stack = [(top, roots, roots)] if top else []
        self.span, most = self.spans(), self.sizes.pairs
        while stack:
            depth, p, q = stack.pop()
            if len(p) > most:
                stack.append((depth, p[most:], q[most:]))
                p, q = p[:most], q[:most]
            p, q = self.open(depth, p, q)
            if not len(p):
                continue
            if depth:
                apart, same = self.below(depth, p, q)
                stack.append((depth - 1, *apart))
                if depth > 1:
                    stack.append((depth - 1, *same))
            elif self.decide(p, q):
                self.span = self.spans()

    def decide(self, p: np.ndarray, q: np.ndarray) -> bool:
        """Compare leaves on whole sets, few partners of each at first: a link spares the others."""
        order = np.argsort(q, kind="stable")
        p, q, linked, turn = p[order], q[order], False, 1
        while len(p):
            apart = self.root[self.code[p]] != self.root[self.code[q]]
            p, q = p[apart], q[apart]
            now = np.arange(len(q)) - np.searchsorted(q, q) < turn
            met = [(a, b) for a, b in zip(p[now].tolist(), q[now].tolist()) if self.alike(self.own[a], self.own[b])]
            for a, b in met:
                x, y = self.find(self.code[a]), self.find(self.code[b])
                self.root[max(x, y)] = min(x, y)
            if met:
                linked = True
                while (self.root != (up := self.root[self.root])).any():
                    self.root = up
            p, q, turn = p[~now], q[~now], 4 * turn
        return linked

    def find(self, code: int) -> int:
        while self.root[code] != code:
            code = self.root[code]
        return code

    def alike(self, a: int, b: int) -> bool:
        pair = int(min(a, b)) * len(self.sets) + int(max(a, b))
        if pair in self.unlike:  # compared in another tree
            return False
        x, y = self.sets[a], self.sets[b]
        shared = np.count_nonzero(y.take(y.searchsorted(x), mode="clip") == x)
        if 9 * shared >= 4 * (len(x) + len(y)):
            return True
        self.unlike.add(pair)
        return False

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each component that turned out to be part of a lower one, with that."""
        moved = np.flatnonzero((self.known == np.arange(len(self.known))) & (self.root != self.known))
        return self.names[moved], self.names[self.root[moved]]


def forest_links(rows: pa.Table, sets: pa.Table, sizes: Sizes) -> pa.Table:
    forest = Forest(rows, sets, sizes)
    forest.traverse()
    kind = rows.schema.field("id").type
    return pa.table([pa.array(x.tolist(), kind) for x in forest.links()], ["a", "b"])


# rounds


def _spots(heads: DataFrame) -> DataFrame:
    """(token, id, s0, n, root, reach): each class under the tokens of its prefix."""
    each = heads.select("id", "s0", "n", "alone", "root", F.posexplode("prefix").alias("k", "token"))
    reach = F.floor((5 * F.col("n") - 9 * (F.col("alone") + F.col("k"))) / 4)
    return each.select("token", "id", "s0", "n", "root", reach.alias("reach"))


def _merged_trees(spots: DataFrame) -> DataFrame:
    """(token, id, s0, n, root, reach) of trees in which components may meet, by size.

    Tokens that the same leaves have are one tree, named by the lowest; a leaf has its largest reach there.
    """
    facts = spots.groupBy("token").agg(
        F.min("n").alias("least"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.count(F.lit(1)).alias("leaves"), F.min(F.struct("n", "reach")).alias("small"), F.max(F.struct("n", "reach")).alias("large"),
    )
    apart = (F.col("leaves") == 2) & ((F.col("small.reach") < F.col("large.n")) | (F.col("large.reach") < F.col("small.n")))
    facts = facts.where((F.col("low") != F.col("high")) & ~apart).select("token", "least")
    met = saved(spots.join(facts.hint("merge"), "token").where("reach >= least").drop("least"))
    leaf = F.xxhash64("id", "s0")
    same = met.groupBy("token").agg(
        F.count(F.lit(1)).alias("leaves"), F.bit_xor(leaf).alias("x"), F.sum(F.pmod(leaf, F.lit((1 << 31) - 1))).alias("y"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    trees = same.where("low != high").select("token", F.struct("leaves", "x", "y").alias("tree"))
    names = trees.groupBy("tree").agg(F.min("token").alias("name"))
    named = trees.join(names.hint("merge"), "tree").select("token", "name")
    rows = met.join(named.hint("merge"), "token").groupBy(F.col("name").alias("token"), "id", "s0", "n", "root")
    return rows.agg(F.max("reach").alias("reach"))


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("id", "token"), parts)


CELL = ("id", "s0", "n", "root", "reach")


def first_cells(spots: DataFrame, sizes: Sizes) -> DataFrame:
    """Each tree, a large one in parts on their own: (home, token, i, j) and the leaf."""
    parts = spots.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / sizes.leaves).alias("parts"), F.xxhash64(F.min("id")).alias("home"))
    part = _part(F.col("parts"))
    return spots.join(parts.hint("merge"), "token").select("home", "token", part.alias("i"), part.alias("j"), *CELL)


def all_cells(spots: DataFrame, sizes: Sizes) -> DataFrame:
    """Each tree, a large one as pairs of its parts: (home, token, i, j) and the leaf.

    The leaves of the component that has most in a large tree have parts of their own, numbered
    after the others, and those are not paired with each other.
    """
    counts = spots.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    facts = counts.groupBy("token").agg(
        F.sum("n").alias("all"), F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.count(F.lit(1)).alias("roots"),
        F.xxhash64(F.min("low")).alias("home"),
    )
    large = F.col("all") > sizes.leaves
    facts = facts.where("roots > 1").select(
        "token",
        "home",
        F.when(large, F.col("main")).alias("main"),
        F.when(large, F.ceil((F.col("all") - F.col("most")) / sizes.leaves)).otherwise(1).alias("others"),
        F.when(large, F.ceil(F.col("most") / sizes.leaves)).otherwise(0).alias("mains"),
    )
    joined = spots.join(facts.hint("merge"), "token")
    is_main = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    own = F.when(is_main, F.col("others") + _part(F.greatest("mains", F.lit(1)))).otherwise(_part(F.col("others")))
    last = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    others = F.sequence(F.lit(0).cast("long"), last.cast("long"))
    each = joined.select("home", "token", *CELL, own.cast("long").alias("own"), F.explode(others).alias("other"))
    return each.select("home", "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *CELL)


def links(cells: DataFrame, leaves: DataFrame, sizes: Sizes) -> DataFrame:
    """(a, b): components that the trees of ``cells`` link.

    Whole trees of the same lowest leaf meet in a task, which gets each leaf's set once: trees of the
    tokens that some copies share have many leaves in common.
    """
    cells = saved(cells)
    size = cells.agg(F.sum("n")).first()[0] or 0
    forests = F.lit(int(8 * size // sizes.forest) + 1)
    spread = F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("home")).otherwise(F.xxhash64("token", "i", "j"))
    cells = cells.withColumn("forest", F.pmod(spread, forests).cast("int")).drop("home")
    wanted = cells.select("forest", "id", "s0").distinct().join(leaves.select("id", "s0", "set").hint("merge"), ["id", "s0"])
    sets = wanted.select(F.col("forest").alias("held_by"), F.col("id").alias("leaf"), F.col("s0").alias("hash"), "set")
    kind = cells.schema["id"].dataType.simpleString()

    def traverse(rows: pa.Table, sets: pa.Table) -> pa.Table:
        return forest_links(rows, sets, sizes)

    return cells.groupBy("forest").cogroup(sets.groupBy("held_by")).applyInArrow(traverse, f"a {kind}, b {kind}")


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, root) whose roots were linked to lower ones: ``more`` (node, root)."""
    up = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.union(more)


def _with_ids_between(may_link: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Components after ids with several texts have linked the classes of these."""
    several = may_link.groupBy("id").agg(F.min("s0").alias("low"), F.max("s0").alias("high")).where("low != high").select("id")
    stands = may_link.join(several.hint("merge"), "id", "left_semi").join(classes, ["s0", "s1", "n"])
    between = saved(stands.select(F.col("id").alias("a"), F.col("class").alias("b")).where("a != b").distinct())
    if between.isEmpty():
        return roots
    return components(between.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_copy_components(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """(key, n_shingles, component_id) for each row: components of the links of Jaccard 0.8 or more."""
    found = saved(sketched(docs, key, text, sizes))
    may_link = found.where("set is not null and id is not null")
    classes = saved(may_link.groupBy("s0", "s1", "n").agg(F.min("id").alias("class")))
    own = classes.select("s0", "s1", "n", F.col("class").alias("id"))
    leaves = may_link.join(own.hint("merge"), ["id", "s0", "s1", "n"], "left_semi").dropDuplicates(["id", "s0", "s1", "n"])
    leaves = saved(leaves.select("id", "s0", "n", "alone", "prefix", "set"))
    heads = leaves.drop("set")
    opening = _spots(heads.withColumns({"root": F.col("id"), "prefix": F.slice("prefix", 1, sizes.first)}))
    near = components(links(first_cells(saved(_merged_trees(opening)), sizes), leaves, sizes))
    placed = heads.join(near.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rest = components(links(all_cells(saved(_merged_trees(_spots(placed))), sizes), leaves, sizes))
    near = _with_ids_between(may_link, classes, _merged(near, rest))
    placed = classes.join(near.withColumnRenamed("node", "class"), "class", "left").select("s0", "s1", "n", F.coalesce("root", "class").alias("root"))
    every = found.select("id", "n", "s0", "s1").join(placed, ["s0", "s1", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return every.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """One document of each component: that of the smallest id.  Rows without an id stay."""
    found = near_copy_components(docs.select(key, text), key, text, sizes)
    kept = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    named = docs.join(kept.hint("merge"), key, "left_semi").dropDuplicates([key])
    return named.unionByName(docs.where(F.col(key).isNull()))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copy_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT d.b, r.c FROM r JOIN d ON r.v = d.a WHERE r.c < d.b),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.v = w.doc_id
"""
