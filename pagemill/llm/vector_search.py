"""Operator 11: exact top-k by inner product, with cover trees over queries and data.

1. Index.  A bounded sample gives the centres of at most ``cells`` cells; every row, query or not,
   goes to the cell of its nearest centre, and a cell is cut into blocks of bounded size by a hash of the row.
   A block's rows, and a group's queries, stand in a cover tree: a node's children are
   centred on points of its own, chosen farthest first, the first on the node's own centre;
   a point goes to the nearest, and a node keeps its covering radius.  A node has at most ``fanout`` children.
2. Bound.  For nodes with centres ``q``, ``d`` and radii ``r``, ``s`` no pair of their points has
   an inner product above ``q.d + |q| s + |d| r + r s``.  A pair is let go of where that is below
   the worst k-th score of the query node's queries so far; at equality it is kept, for ties.
3. First round: each group meets a block of the two cells of the highest bounds, which gives every query
   a k-th score.  Second round: the cells, then the blocks' roots, that the bound leaves meet the group;
   a task holds one block and some groups and descends both trees, node pairs of the highest bounds first.

Scores are exact: whole numbers multiplied as doubles where all sums stay below 2^53, else as
integers; a score beyond 64 bits is an error.

Scale: vectors are shuffled once to their blocks.  A block then goes to the groups that may need it, ``part`` of them at a time,
and a group to the blocks that its bound leaves: pairs of groups and blocks, never of rows.  A cell that holds
a third of all rows is cut into blocks like any other, so equal vectors aren't gathered.

Bounds: a block has at most about ``block`` rows and ``block_bytes`` bytes, a group ``group`` queries; the driver
holds the sample and a number for each cell.  The index isn't approximate: the sample moves cell borders, not results.

Cases: null or empty vectors and those with null or non-finite components take no part; vectors
of different lengths are an error; a null id is no query but a candidate, last among equals;
repeated rows are queries and candidates of their own, a row never a candidate of itself only;
fewer candidates than ``k`` give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import pack, saved, table, unpack
from pagemill.llm.vectors import small, whole_vectors

SCALE = 1024.0
MOST = 10
_KINDS = {2: "h", 4: "i", 8: "q"}


class Sizes(NamedTuple):
    """Bounds of what is held at once; numbers of blocks and groups follow the input."""

    sample: int = 1 << 14  # rows that the cells are fitted on
    cells: int = 256
    block: int = 1 << 12  # rows of a block
    block_bytes: int = 4 << 20  # bytes of a block, which bounds long vectors
    group: int = 256  # queries of a group
    part: int = 32  # groups that meet a block in one task
    leaf: int = 64  # points of a leaf
    fanout: int = 16
    pairs: int = 1 << 10  # node pairs that are looked at at once

    def rows(self, dim: int, most: int) -> int:
        return max(1, min(most, self.block_bytes // (8 * dim)))


SIZES = Sizes()


def _apart(x: np.ndarray, squares: np.ndarray, at: int) -> np.ndarray:
    """Distances of all points from point ``at``."""
    return np.sqrt(np.maximum(squares + squares[at] - 2 * (x @ x[at]), 0))


def spread_out(x: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` points farthest from each other, the first being the first row; all of them differ."""
    squares, chosen = np.einsum("ij,ij->i", x, x), [0]
    nearest = _apart(x, squares, 0)
    while len(chosen) < most and nearest.max(initial=0) > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _apart(x, squares, chosen[-1]))
        nearest[chosen] = 0
    return np.array(chosen)


class Tree(NamedTuple):
    """A cover tree: points in leaf order, and for each node its points, centre, radius and children."""

    x: np.ndarray  # int64 points, those of a node side by side
    of: np.ndarray  # each point's row in the table that the tree was made of
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray  # place of the centre in x
    radius: np.ndarray
    first: np.ndarray  # first child
    children: np.ndarray  # their number, 0 for a leaf

    @classmethod
    def build(cls, x: np.ndarray, sizes: Sizes) -> Tree:
        real = x.astype(np.float64)
        squares = np.einsum("ij,ij->i", real, real)
        order, nodes = np.arange(len(x)), []  # a node: low, high, centre's row, radius, first child, children
        middle = int(((real - real.mean(axis=0)) ** 2).sum(axis=1).argmin())
        nodes.append([0, len(x), middle, float(_apart(real, squares, middle).max()), 0, 0])
        for node in nodes:  # grows while it is walked
            low, high, centre, radius, *_ = node
            if high - low <= sizes.leaf or radius == 0:
                continue
            rows = order[low:high].copy()
            near = np.full(len(rows), np.inf)
            owner = np.zeros(len(rows), int)
            inside, own = real[rows], squares[rows]
            at, chosen = int(np.flatnonzero(rows == centre)[0]), []
            while len(chosen) < sizes.fanout:
                d = _apart(inside, own, at)
                d[at] = 0
                closer = d < near
                owner[closer], near[closer] = len(chosen), d[closer]
                chosen.append(at)
                at = int(near.argmax())
                if near[at] <= radius / 4:
                    break
            if len(chosen) == 1:
                continue
            by = np.argsort(owner, kind="stable")
            order[low:high] = rows[by]
            ends = np.searchsorted(owner[by], np.arange(len(chosen) + 1))
            node[4], node[5] = len(nodes), len(chosen)
            for k, at in enumerate(chosen):
                nodes.append([low + int(ends[k]), low + int(ends[k + 1]), int(rows[at]), float(near[owner == k].max()), 0, 0])
        low, high, centre, radius, first, children = map(np.array, zip(*nodes))
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        # distances are of rounded squares: a little more is sure to cover
        radius = radius * (1 + 1e-6) + 1e-6 * np.sqrt(squares.max(initial=0) + 1)
        return cls(x[order], order, low, high, place[centre], radius, first, children)

    def packed(self) -> bytes:
        x = small(self.x)
        shape = np.array([x.itemsize, x.shape[1]])
        return pack(shape, np.frombuffer(x.tobytes(), np.uint8), *(a.astype(np.float64 if a is self.radius else np.int64) for a in self[1:]))

    @classmethod
    def unpacked(cls, body: bytes) -> Tree:
        shape, x, *rest = unpack(body, "qBqqqqdqq")
        return cls(np.frombuffer(x.tobytes(), _KINDS[int(shape[0])]).reshape(-1, int(shape[1])).astype(np.int64), *rest)


class Side:
    """A tree made ready for search: real centres and their norms."""

    def __init__(self, body: bytes):
        self.tree = Tree.unpacked(body)
        self.centres = self.tree.x[self.tree.centre].astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.centres, self.centres))
        self.most = int(np.abs(self.tree.x).max())
        self.real = self.tree.x.astype(np.float64)


def bound(q: np.ndarray, r, d: np.ndarray, s) -> np.ndarray:
    """No inner product of points within ``r`` of ``q`` and within ``s`` of ``d`` is above this."""
    found = np.einsum("ij,ij->i", q, d) + np.sqrt(np.einsum("ij,ij->i", q, q)) * s + np.sqrt(np.einsum("ij,ij->i", d, d)) * r + r * s
    return _rounded_up(found)


def _rounded_up(found: np.ndarray) -> np.ndarray:
    return found + np.abs(found) * 1e-9 + 1


def _products(q: Side, d: Side):
    """A function of places in both trees that gives exact inner products."""
    largest = q.most * d.most * q.tree.x.shape[1]
    if largest < 1 << 53:
        return lambda a, b: (q.real[a] @ d.real[b].T).astype(np.int64)
    if largest < 1 << 63:
        return lambda a, b: q.tree.x[a] @ d.tree.x[b].T

    return lambda a, b: q.tree.x[a].astype(object) @ d.tree.x[b].T.astype(object)


LEAST = -(1 << 63)


def dual_search(q: Side, d: Side, q_rows: np.ndarray, d_rows: np.ndarray, d_rank: np.ndarray, floors: np.ndarray, k: int, sizes: Sizes):
    """(query, candidate, score): places in the trees of the ``k`` best candidates of each query that reach its floor.

    ``q_rows`` and ``d_rows`` name the table's rows, for a row isn't its own candidate; ``d_rank``
    orders candidates of equal scores; ``floors`` are scores that ``k`` other candidates have.
    """
    a, b, times = q.tree, d.tree, _products(q, d)
    best = np.full((len(a.x), k), LEAST)  # each query's k best scores here
    floors, parts, waiting = floors.copy(), [], 0
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]

    def best_of(parts: list[np.ndarray]) -> list[np.ndarray]:
        query, place, score = np.hstack(parts)
        order = np.lexsort((d_rank[place], -score, query))
        query, place, score = query[order], place[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return [np.stack([query, place, score])[:, rank < k]]

    while stack:
        p, o = stack.pop()
        lowest = np.array([floors[x:y].min() for x, y in zip(a.low, a.high)])
        product = np.einsum("ij,ij->i", q.centres[p], d.centres[o])
        top = _rounded_up(product + q.norms[p] * b.radius[o] + d.norms[o] * a.radius[p] + a.radius[p] * b.radius[o])
        may = np.flatnonzero(top >= lowest[p])
        may = may[np.argsort(-top[may], kind="stable")]
        if len(may) > sizes.pairs:
            stack.append((p[may[sizes.pairs :]], o[may[sizes.pairs :]]))
            may = may[: sizes.pairs]
        p, o, top = p[may], o[may], top[may]
        leaves = (a.children[p] == 0) & (b.children[o] == 0)
        for x in np.unique(p[leaves]).tolist():  # a query leaf with all data leaves that it has left, in one product
            mine, own = leaves & (p == x), slice(a.low[x], a.high[x])
            found = o[mine][top[mine] >= floors[own].min()]
            n = b.high[found] - b.low[found]
            other = np.repeat(b.low[found] - np.cumsum(n) + n, n) + np.arange(n.sum())
            if not len(other):
                continue
            score = times(own, other)
            same = q_rows[own, None] == d_rows[None, other]
            if score.dtype == object:
                score[same] = 0
                if (abs(score) >= 1 << 63).any():
                    raise OverflowError("an inner product doesn't fit in 64 bits")
                score = score.astype(np.int64)
            reach = (score >= floors[own, None]) & ~same
            if not reach.any():
                continue
            i, j = np.nonzero(reach)
            parts.append(np.stack([i + own.start, other[j], score[i, j]]))
            waiting += len(i)
            here = np.where(reach, score, LEAST)
            if here.shape[1] > k:
                here = np.partition(here, here.shape[1] - k, axis=1)[:, -k:]
            best[own] = np.sort(np.hstack([best[own], here]), axis=1)[:, -k:]
            floors[own] = np.maximum(floors[own], best[own, 0])
            if waiting > 1 << 17:
                parts = best_of(parts)
                waiting = parts[0].shape[1]
        p, o = p[~leaves], o[~leaves]
        if len(p):
            first = (b.children[o] == 0) | ((a.children[p] > 0) & (a.radius[p] > b.radius[o]))
            opened = [_opened(a, p[first], o[first]), _opened(b, o[~first], p[~first])[::-1]]
            stack.append(tuple(map(np.concatenate, zip(*opened))))
    if not parts:
        return np.zeros((3, 0), np.int64)
    query, place, score = best_of(parts)[0]
    kept = score >= floors[query]
    return query[kept], place[kept], score[kept]


def _opened(tree: Tree, nodes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of ``nodes``, each with the other node of its pair."""
    n = tree.children[nodes]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(tree.first[nodes], n) + inside, np.repeat(others, n)


class Cells(NamedTuple):
    """Centres, and once all rows are dealt the number of rows and the covering radius of each."""

    centres: np.ndarray
    count: np.ndarray
    radius: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        squares = np.einsum("ij,ij->i", self.centres, self.centres)
        cell = np.empty(len(x), np.int64)
        for at in range(0, len(x), 4096):
            cell[at : at + 4096] = (squares - 2 * (x[at : at + 4096] @ self.centres.T)).argmin(axis=1)
        return cell, np.sqrt(((x - self.centres[cell]) ** 2).sum(axis=1))


def fitted_cells(rows: DataFrame, sizes: Sizes) -> Cells | None:
    """Cells of a sample by hash: farthest points, moved to the means of what is nearest to them."""
    n = rows.count()
    share = int(min(1.0, sizes.sample / max(n, 1)) * (1 << 30))
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share).select("vector").limit(2 * sizes.sample).toArrow()
    _, x = whole_vectors(sample.column(0).combine_chunks(), SCALE)
    if not len(x):  # all of a small table, or a table of which next to nothing can be used
        sample = rows.where(F.size("vector") > 0).where(~F.exists("vector", lambda v: v.isNull() | F.isnan(v))).select("vector").limit(sizes.sample).toArrow()
        _, x = whole_vectors(sample.column(0).combine_chunks(), SCALE)
        if not len(x):
            return None
    x = x.astype(np.float64)
    most = min(sizes.cells, -(-n // sizes.rows(x.shape[1], sizes.block)))
    centres = x[spread_out(x, most)]
    cells = Cells(centres, np.zeros(len(centres)), np.zeros(len(centres)))
    owner, _ = cells.nearest(x)
    means = np.array([x[owner == k].mean(axis=0) if (owner == k).any() else centres[k] for k in range(len(centres))])
    return cells._replace(centres=means)


def _dealt(rows: DataFrame, cells: Cells) -> DataFrame:
    """(row, id, query, cell, far, x): usable rows as whole numbers, each in its nearest cell."""
    shared, id_kind = rows.sparkSession.sparkContext.broadcast(cells), rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole_vectors(batch.column("vector"), SCALE)
            if not len(at):
                continue
            if x.shape[1] != shared.value.centres.shape[1]:
                raise ValueError(f"vectors of {x.shape[1]} components and of {shared.value.centres.shape[1]} in one column")
            cell, far = shared.value.nearest(x.astype(np.float64))
            rest = batch.select(["row", "id", "query"]).take(pa.array(at))
            bodies = pa.array([small(v).tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(cell), pa.array(far), bodies], names=["row", "id", "query", "cell", "far", "x"])

    return saved(rows.mapInArrow(run, f"row long, id {id_kind}, query boolean, cell long, far double, x binary"))


def _trees(dealt: DataFrame, slices: Column, dim: int, sizes: Sizes) -> DataFrame:
    """A row for each block of a cell: its rows' ids, and their tree."""
    kind = dealt.schema["id"].dataType.simpleString()

    def run(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        bodies = [b.as_py() for b in rows.column("x")]
        x = np.array([np.frombuffer(b, _KINDS[len(b) // dim]) for b in bodies], np.int64)
        tree = Tree.build(x, sizes)
        rows = rows.take(pa.array(tree.of))
        rank = np.empty(len(x), np.int64)
        rank[pc.sort_indices(rows.select(["id", "row"]), sort_keys=[("id", "ascending"), ("row", "ascending")]).to_numpy()] = np.arange(len(x))
        ids = rows.column("id").combine_chunks()
        one = {"cell": name[0].as_py(), "slice": name[1].as_py(), "n": len(x), "centre": tree.x[tree.centre[0]].astype(np.float64).tobytes(), "radius": float(tree.radius[0])}
        one |= {"rows": rows.column("row").to_numpy().astype(np.int64).tobytes(), "ranks": rank.tobytes(), "tree": tree.packed()}
        held = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids)
        return pa.Table.from_arrays([*(pa.array([v]) for v in one.values()), held], names=[*one, "ids"])

    sliced = dealt.withColumn("slice", F.pmod(F.xxhash64("row"), slices)).select("cell", "slice", "row", "id", "x")
    made = sliced.groupBy("cell", "slice").applyInArrow(
        run, f"cell long, slice long, n long, centre binary, radius double, rows binary, ranks binary, tree binary, ids array<{kind}>"
    )
    return saved(made.withColumn("block", F.col("slice") * (1 << 20) + F.col("cell")))


def _slices(cells: np.ndarray) -> Column:
    """The number of slices of the row's cell, from a small array."""
    return F.element_at(F.array(*[F.lit(int(n)) for n in cells]), (F.col("cell") + 1).cast("int"))


def _candidate_cells(groups: DataFrame, cells: Cells) -> DataFrame:
    """``groups`` with ``cells``: (cell, most) of each cell with rows, the highest bound first."""
    shared = groups.sparkSession.sparkContext.broadcast(cells)

    def run(centres: pa.Array, radii: pa.Array) -> pa.Array:
        c = shared.value
        held = np.flatnonzero(c.count)
        out = []
        for body, r in zip(centres, radii.to_numpy(zero_copy_only=False)):
            q = np.frombuffer(body.as_py(), np.float64)
            most = bound(np.broadcast_to(q, (len(held), len(q))), r, c.centres[held], c.radius[held])
            order = np.argsort(-most, kind="stable")
            out.append([{"cell": int(held[i]), "most": float(most[i])} for i in order])
        return pa.array(out, pa.list_(pa.struct([("cell", pa.int64()), ("most", pa.float64())])))

    return groups.withColumn("cells", F.arrow_udf(run, "array<struct<cell:long,most:double>>")("centre", "radius"))


def _root_bound(q: pa.Array, r: pa.Array, d: pa.Array, s: pa.Array) -> pa.Array:
    q, d = (np.frombuffer(b"".join(x.as_py() for x in c), np.float64).reshape(len(c), -1) for c in (q, d))
    return pa.array(bound(q, r.to_numpy(zero_copy_only=False), d, s.to_numpy(zero_copy_only=False)))


def _met(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, k: int, sizes: Sizes, kind: str) -> DataFrame:
    """(group, place, query_row, query_id, id, row, score): the best candidates of each pair of group and block."""
    parts = F.lit(max(1, -(-groups.count() // sizes.part)))
    pairs = pairs.select("group", "block", F.pmod(F.xxhash64("group"), parts).alias("part"))
    left = pairs.select("block", "part").distinct().join(blocks.select("block", "rows", "ranks", "tree", "ids"), "block")
    right = pairs.withColumnsRenamed({"block": "with_block", "part": "in_part"}).join(groups.select("group", "q_rows", "q_tree", "q_ids", "floors"), "group")

    names = f"group long, place long, query_row long, query_id {kind}, id {kind}, row long, score long"
    schema = groups.sparkSession.createDataFrame([], names).toArrow().schema

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        out = {c: [] for c in ("group", "place", "query_row", "query_id", "id", "row", "score")}
        if not block.num_rows or not asked.num_rows:
            return pa.Table.from_pydict(out, schema)
        of = block.slice(0, 1).to_pylist()[0]
        d, d_rows, d_rank = Side(of["tree"]), np.frombuffer(of["rows"], np.int64), np.frombuffer(of["ranks"], np.int64)
        for at in range(asked.num_rows):
            one = asked.slice(at, 1).to_pylist()[0]
            q, q_rows = Side(one["q_tree"]), np.frombuffer(one["q_rows"], np.int64)
            floors = np.frombuffer(one["floors"], np.int64) if one["floors"] is not None else np.full(len(q_rows), LEAST)
            query, place, score = dual_search(q, d, q_rows, d_rows, d_rank, floors, k, sizes)
            out["group"] += [one["group"]] * len(query)
            out["place"] += query.tolist()
            out["query_row"] += q_rows[query].tolist()
            out["query_id"] += [one["q_ids"][i] for i in query.tolist()]
            out["id"] += [of["ids"][i] for i in place.tolist()]
            out["row"] += d_rows[place].tolist()
            out["score"] += score.tolist()
        return pa.Table.from_pydict(out, schema)

    return saved(left.groupBy("block", "part").cogroup(right.groupBy("with_block", "in_part")).applyInArrow(run, names))


def _with_floors(groups: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``groups`` with each query's k-th score of ``found`` in the order of its tree, and the worst of these."""
    scores = found.groupBy("group", "place").agg(F.collect_list("score").alias("s"))  # two blocks, k scores of each
    kth = scores.select("group", "place", F.coalesce(F.get(F.sort_array("s", asc=False), F.lit(k - 1)), F.lit(LEAST)).alias("kth"))
    lists = kth.groupBy("group").agg(F.collect_list(F.struct("place", "kth")).alias("known"))  # the queries of a group

    def run(n: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for size, rows in zip(n.to_pylist(), known.to_pylist()):
            floors = np.full(size, LEAST)
            for row in rows or ():
                floors[row["place"]] = row["kth"]
            out.append({"floors": floors.tobytes(), "worst": float(floors.min())})
        return pa.array(out, pa.struct([("floors", pa.binary()), ("worst", pa.float64())]))

    made = F.arrow_udf(run, "struct<floors:binary,worst:double>")("n", "known")
    return saved(groups.drop("floors").join(lists, "group", "left").withColumn("__f", made).select("*", "__f.*").drop("__f", "known"))


def top_k(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = MOST, sizes: Sizes = SIZES) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` other rows of the highest inner products with each row of ``is_query``."""
    kind = rows.schema[key].dataType.simpleString()
    named = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector).alias("vector"))
    cells = fitted_cells(named, sizes)
    if cells is None:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score long")
    dealt = _dealt(named, cells)
    facts = dealt.groupBy("cell").agg(F.count(F.lit(1)), F.max("far"), F.count_if("query")).collect()  # a row for each cell
    count, queries, radius = (np.zeros(len(cells.centres)) for _ in range(3))
    for cell, n, far, asked in facts:
        count[cell], radius[cell], queries[cell] = n, far, asked
    cells = cells._replace(count=count, radius=radius * (1 + 1e-6) + 1e-6)
    dim = cells.centres.shape[1]
    slices = np.maximum(1, -(-count // sizes.rows(dim, sizes.block))).astype(int)
    blocks = _trees(dealt, _slices(slices), dim, sizes)
    asked = np.maximum(1, -(-queries // sizes.rows(dim, sizes.group))).astype(int)
    groups = _trees(dealt.where("query"), _slices(asked), dim, sizes)
    groups = groups.select(F.col("block").alias("group"), "n", "centre", "radius", F.col("rows").alias("q_rows"), F.col("tree").alias("q_tree"), F.col("ids").alias("q_ids"), F.lit(None).cast("binary").alias("floors"))
    groups = saved(_candidate_cells(groups, cells))
    # first round: a block of each of the two best cells
    opening = groups.select("group", F.explode(F.slice("cells", 1, 2)).alias("c")).select("group", F.col("c.cell").alias("cell"))
    visited = saved(opening.select("group", (F.pmod(F.xxhash64("group"), _slices(slices)) * (1 << 20) + F.col("cell")).alias("block")))
    found = _met(visited, groups, blocks, k, sizes, kind)
    # second round: whatever may still hold one of the k best
    groups = _with_floors(groups, found, k)
    open_cells = groups.select("group", F.col("centre").alias("q"), F.col("radius").alias("r"), "worst", F.explode("cells").alias("c")).where("c.most >= worst")
    roots = blocks.select("cell", "block", F.col("centre").alias("d"), F.col("radius").alias("s"))
    may = open_cells.select("group", "q", "r", "worst", F.col("c.cell").alias("cell")).join(roots, "cell")
    may = may.where(F.arrow_udf(_root_bound, "double")("q", "r", "d", "s") >= F.col("worst")).select("group", "block")
    pairs = saved(may.join(visited, ["group", "block"], "left_anti"))
    every = found.union(_met(pairs, groups, blocks, k, sizes, kind))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP11_SQL = f"""
WITH x AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor({int(SCALE)} * c::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.r AS r, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM x q JOIN x c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r)::INTEGER AS rank FROM s)
WHERE rank <= {MOST}
"""
