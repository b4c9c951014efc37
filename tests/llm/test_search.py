"""Vector search, whitening and lexical search against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from pagemill.llm import lexical_search, vector_search, whitening
from pagemill.llm.vector_search import Side, Sizes, Tree

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"
NAN, INF = float("nan"), float("inf")
#: Small enough for several cells, blocks, groups, parts and levels on a few hundred rows.
TINY = Sizes(sample=40, cells=5, block=30, group=3, part=2, leaf=4, fanout=3, pairs=7)


def vector_rows(n=260, dim=6, seed=1):
    """Clusters, a group of equal vectors, ties, repeats, and rows that can't be used."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    x = (centres[r.integers(0, 6, n)] + 0.1 * r.normal(size=(n, dim))).astype(np.float32)
    x[40:120] = x[40]
    x[130:160] = np.round(x[130:160])
    rows = [(100 * i if i % 4 == 0 else i * 7 + 1, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0], rows[0], rows[5], (None, x[0].tolist()), (None, x[40].tolist()), (0, [0.0] * dim), (300, (-x[0]).tolist())]
    return rows + [(500, None), (600, []), (700, [1.0] * (dim - 1) + [NAN]), (800, [INF] + [0.0] * (dim - 1)), (900, [None] + [0.0] * (dim - 1))]


def usable(v):
    return v and all(c is not None and math.isfinite(c) for c in v)


def brute_search(rows, k):
    x = [(key, [math.floor(1024 * float(np.float32(c))) for c in v]) for key, v in rows if usable(v)]
    for i, (name, q) in enumerate(x):
        if name is not None and name % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), key is None, key or 0) for j, (key, v) in enumerate(x) if j != i)
            yield from ((name, rank, None if none else key, -low) for rank, (low, none, key) in enumerate(found[:k], 1))


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("sizes", [TINY, vector_search.SIZES])
def test_vector_search(spark, sizes):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(7) for c in ("row", "id", "query", "vector", "cell", "block", "score", "rank")})
    found = vector_search.top_k(df.repartition(3), F.col("vec_id") % 100 == 0, k=5, sizes=sizes)
    assert found.columns == ["query_id", "rank", "id", "score"]
    assert ordered(found.collect()) == ordered(brute_search(rows, 5))


def test_vector_search_cases(spark):
    by = F.col("vec_id") % 100 == 0
    search = lambda rows, **more: [tuple(r) for r in vector_search.top_k(spark.createDataFrame(rows, VECTORS), by, **more).collect()]
    assert search([]) == [] and search([(100, None), (None, [NAN])]) == []
    assert search([(100, [1.0])]) == [] and search([(1, [1.0]), (2, [1.0])]) == []
    assert search([(100, [1.0]), (2, [0.5]), (1, [0.5])]) == [(100, 1, 1, 1024 * 512), (100, 2, 2, 1024 * 512)]
    large = [(100, [2.0**40, -(2.0**20)]), (1, [2.0**2, 3.0]), (2, [3.75, 0.5])]
    assert ordered(search(large)) == ordered(brute_search(large, 10))
    with pytest.raises(PythonException, match="64 bits"):
        search([(100, [2.0**40]), (1, [2.0**40])])
    with pytest.raises((PythonException, ValueError), match="components"):
        search([(100, [1.0, 2.0]), (1, [1.0])])


def test_cover_trees():
    """Nodes cover their points, children part their parents' points, and the search equals all products."""
    r = np.random.default_rng(3)
    x, y = (np.vstack([r.integers(-50, 50, (n, 5)), np.full((40, 5), 9)]) for n in (300, 60))
    a, b = (Tree.unpacked(Tree.build(v, TINY).packed()) for v in (y, x))
    assert (b.x == x[b.of]).all() and sorted(b.of) == list(range(len(x)))
    for n in range(len(b.low)):
        inside = b.x[b.low[n] : b.high[n]]
        assert np.sqrt(((inside - b.x[b.centre[n]]) ** 2).sum(axis=1)).max() <= b.radius[n]
        if b.children[n]:
            first, last = b.first[n], b.first[n] + b.children[n]
            assert [*b.low[first:last], b.high[n]] == [b.low[n], *b.high[first:last]] and b.children[n] <= TINY.fanout
    q, d = Side(a.packed()), Side(b.packed())
    rank = np.argsort(np.argsort(b.of))
    query, place, score = vector_search.dual_search(q, d, np.arange(len(y)) - 1000, np.arange(len(x)), rank, np.full(len(y), vector_search.LEAST), 4, TINY)
    got = sorted(zip(a.of[query].tolist(), (-score).tolist(), b.of[place].tolist()))
    want = [(i, -s, j) for i in range(len(y)) for s, j in sorted(((int(y[i] @ x[j]), j) for j in range(len(x))), key=lambda t: (-t[0], t[1]))[:4]]
    assert got == sorted(want)


def brute_whitening(rows, most=4):
    x = [[math.floor(256 * float(np.float32(c))) for c in v] if usable(v) else None for _, v in rows]
    fit = np.array(sorted(set(map(tuple, filter(None, x)))), float)
    n, sums = len(fit), fit.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    for (key, _), v in zip(rows, x):
        for k in range(most if v else 0):
            yield key, k + 1, n, sum((n * c - int(s)) ** 2 for c, s in zip(v, sums)), abs(float((v - sums / n) @ u[:, k] / np.sqrt(e[k]))), float(e[k] / e.sum())


def test_whitening(spark, monkeypatch):
    for name, size in (("CHUNK", 16), ("PIECE", 9), ("SALTS", 2)):
        monkeypatch.setattr(whitening, name, size)
    rows = vector_rows(dim=7)
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(7) for c in ("x", "most", "dim", "component", "n")})
    found = whitening.whiten(df.repartition(5)).collect()
    shown = lambda rows: sorted((str(r[0]), *r[1:4], round(abs(r[4]), 6), round(r[5], 9)) for r in rows)
    assert shown(found) == shown(brute_whitening(rows))
    assert {r["identity_error"] for r in found} and max(r["identity_error"] for r in found) < 1e-9
    by = {(r["vec_id"], r["component"]): r["whitened"] for r in found}
    once = Counter(key for key, _ in rows)
    x = {key: np.floor(256 * np.array(v, np.float32).astype(float)) for key, v in rows if usable(v) and once[key] == 1}
    model = whitening.fitted(whitening.scatter(whitening.fit_list(df, "embedding")))
    assert all(np.allclose(by[key, k + 1], (v - model.sums.astype(float) / model.n) @ model.components[:, k] / np.sqrt(model.variances[k])) for key, v in x.items() for k in range(4))


def test_whitening_cases(spark):
    of = lambda rows: [tuple(r) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert of([]) == [] and of([(1, None), (2, []), (3, [NAN]), (4, [None])]) == []
    assert of([(1, [0.5]), (None, [0.5])]) == [(1, 1, 1, 0, None, None, None), (None, 1, 1, 0, None, None, None)]
    flat = of([(1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert [r[4] if r[4] is None else round(abs(r[4]), 9) for r in flat] == [1, None, 1, None] and flat[0][5:] == (1.0, pytest.approx(0, abs=1e-12))
    huge = of([(1, [2.0**50, 0.0]), (2, [0.0, 2.0**49]), (3, [0.0, 0.0])])
    assert {r[3] for r in huge} == {None} and huge[0][6] < 1e-4
    with pytest.raises((PythonException, ValueError), match="components"):
        of([(1, [1.0, 2.0]), (2, [1.0])])


def test_residues():
    """Chinese remainders give back large sums of either sign, exactly."""
    r = np.random.default_rng(2)
    x = r.integers(-(2**60), 2**60, (70, 3))
    exact = np.hstack([np.ones((70, 1), int), x]).astype(object)
    want = exact.T @ exact
    moduli = whitening.primes(np.log2(70) + 122)
    assert len(set(moduli)) == len(moduli) and all(p < 2**20 and all(p % k for k in range(2, 1025)) for p in moduli)
    found = whitening.chinese_remainders({p: whitening.residue_scatter(x, p).ravel() for p in moduli})
    assert (found.reshape(4, 4) == want).all() and found.min() < 0


PROSE = "alpha Beta gamma délta EPS zeta eta theta iota Straße mü 日本 a1 b2 É".split()


def texts():
    r = random.Random(9)
    made = [None, "", " ,. ", "alpha", "ALPHA, alpha!", "beta-gamma " * 3, " ".join(r.choice(PROSE) for _ in range(40_000))]
    made += [" ".join(r.choice(PROSE[: r.randint(2, 15)]) for _ in range(r.randint(1, 60))) for _ in range(150)]
    return list(enumerate(made)) + [(None, "alpha zeta"), (None, "zeta"), (8, made[8]), (8, made[8]), (9, "alpha zeta")]


def brute_ranks(docs, items, most):
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    split = [(key, Counter(of(t)), len(of(t))) for key, t in docs if of(t)]
    n_docs, n_terms = len(split), sum(n for *_, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    for name, text in items:
        scores = []
        for key, counts, n in split:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in of(text) if counts[t])
            if score > 0:
                scores.append((-score, key is None, key or 0))
        yield from ((name, rank, None if none else key, -low) for rank, (low, none, key) in enumerate(sorted(scores)[:most], 1))


@pytest.mark.parametrize(("shard", "block"), [(8 << 20, 4 << 20), (900, 40)])
def test_lexical_search(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    docs, items = texts(), [(1, "alpha zeta"), (2, "Alpha alpha É 日本 unknown"), (2, "mü"), (None, "straße b2, b2"), (3, None), (4, "?"), (5, "unknown"), (6, " ".join(PROSE))]
    more = {c: F.lit(7) for c in ("key", "item", "score", "rank", "words", "item_id")}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(more)
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("key", F.lit(7))
    found = lexical_search.search(lexical_search.build_index(df.repartition(3)), asked, most=7)
    assert ordered(found.collect()) == ordered(brute_ranks(docs, items, 7))


def test_lexical_search_cases(spark):
    docs, none = spark.createDataFrame(texts(), "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(none), items).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), items.limit(0)).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs.where("text = '' or text is null")), items).count() == 0


def test_wand_skips():
    """Once the heap holds three documents of both lists, those of the common one alone aren't scored."""
    keys = list(range(1000))
    common = ([*range(1000), lexical_search._END], [1] * 1000, 1)
    rare = ([*range(0, 1000, 100), lexical_search._END], [50] * 10, 50)
    best = lexical_search.Best(3)
    scored = lexical_search.wand([common, rare], [1, 1], keys, best)
    assert [k for *_, k in best.found] == [0, 100, 200] and scored == 201 + 7


def test_searches_over_tables(spark):
    """The registered queries read whole tables: a rank for each query, a row for each vector and component."""
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    n, asked = vectors.count(), vectors.where("vec_id % 100 = 0").count()
    assert vector_search.op11_vector_search(spark, DATA).count() == asked * min(10, n - 1)
    found = whitening.op12_embedding_whitening(spark, DATA)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.count() == 4 * n and found.agg(F.max("identity_error")).first()[0] < 1e-4
