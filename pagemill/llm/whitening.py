"""Operator 12: whitening of embeddings from an exact scatter matrix in residue numbers.

1. A vector becomes whole numbers ``x = floor(256 c)``; the fit list is each distinct ``x`` once.
2. Residue-number scatter.  Each partition multiplies ``[1, x]`` with itself modulo several primes below
   2^20, ``CHUNK`` rows at a time: a product of residues has 40 bits and a sum of 4,096 of them 52, so a
   GEMM in doubles is exact.  The partitions' residues are summed, and Chinese remainders give
   back the exact counts, sums and products of all rows; so many primes are taken that their
   product exceeds twice the largest possible entry.
3. ``n^2 V = n T - S S'`` is exact in whole numbers and rounded once; a double ``eigh`` gives the components.

Bounds: a task holds one chunk of rows and a (d + 1)-square matrix of each prime; the driver one such
matrix, whatever the number of rows.  Rows shuffled: the distinct vectors once, with repeats merged
before the shuffle, and the upper half of each partition's matrices in pieces, which are added up in two steps.

Cases: rows with null or empty vectors, or with null or non-finite entries, are left out; a
null id stays as it is; repeated rows are one vector of the fit list and a result each; vectors
of different lengths are an error; an empty table gives an empty result; a component without
variance (all vectors alike, or fewer vectors than components) has no whitened values, which are
null, and where there is no variance at all ``explained`` is null; ``deviation`` is null where it
doesn't fit in 64 bits; components of equal variance come in the order of ``eigh``; a component's sign makes
its largest entry positive; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import saved, table
from pagemill.llm.vectors import small, whole_vectors

SCALE = 256.0
MOST = 4
#: Rows of a modular product, and the bits of a prime: 2 * 20 + 12 bits are exact in a double.
CHUNK, BITS = 1 << 12, 20
#: Entries of a piece of a matrix, and into how many sums the partitions' pieces go first.
PIECE, SALTS = 1 << 12, 64
#: Variance below this share of the largest is none: eigh can't tell it from rounding.
LEAST = 1e-12


def primes(total_bits: float) -> list[int]:
    """The largest primes below ``2**BITS`` whose product has more than ``total_bits`` bits."""
    found, bits, n = [], 0.0, (1 << BITS) - 1
    while bits <= total_bits:
        if all(n % k for k in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
            bits += np.log2(n)
        n -= 2
    return found


def fit_list(rows: DataFrame, vector: str) -> DataFrame:
    """(x binary, most, dim): each distinct vector of whole numbers once, in its narrowest type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole_vectors(batch.column(0), SCALE)
            bodies = [small(v).tobytes() for v in x]
            most, dim = np.abs(x).max(axis=1, initial=0), np.full(len(x), x.shape[1], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()), pa.array(most, pa.int64()), pa.array(dim, pa.int32())], names=["x", "most", "dim"])

    return rows.select(F.col(vector)).mapInArrow(run, "x binary, most long, dim int").dropDuplicates(["x", "most", "dim"])


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch of the fit list."""
    bodies = [x.as_py() for x in batch.column("x")]
    kinds = {2: np.int16, 4: np.int32, 8: np.int64}
    return np.array([np.frombuffer(b, kinds[len(b) // dim]) for b in bodies], np.int64).reshape(len(bodies), dim)


def residue_scatter(x: np.ndarray, prime: int) -> np.ndarray:
    """``[1, x]' [1, x]`` modulo ``prime``, exact."""
    total = np.zeros((x.shape[1] + 1,) * 2, np.int64)
    for at in range(0, len(x), CHUNK):
        part = (x[at : at + CHUNK] % prime).astype(np.float64)
        part = np.hstack([np.ones((len(part), 1)), part])
        total += (part.T @ part).astype(np.int64) % prime
    return total % prime


def scatter_residues(fit: DataFrame, dim: int, moduli: list[int]) -> DataFrame:
    """(prime, piece, body): residues of the upper half of the scatter matrix, summed over all rows."""
    upper = np.triu_indices(dim + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((dim + 1,) * 2, np.int64) for _ in moduli]
        for batch in batches:
            x = _matrix(batch, dim)
            for k, prime in enumerate(moduli):
                sums[k] = (sums[k] + residue_scatter(x, prime)) % prime
        for prime, total in zip(moduli, sums):
            flat = total[upper]
            pieces = [flat[at : at + PIECE].tobytes() for at in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([prime] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.binary())], names=["prime", "piece", "body"]
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = 0, None
        for batch in batches:
            for body in batch.column("body"):
                total = total + np.frombuffer(body.as_py(), np.int64)
            last = batch
        if last is not None:
            prime = last.column("prime")[0].as_py()
            body = pa.array([(total % prime).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([last.column("prime")[:1], last.column("piece")[:1], body], names=["prime", "piece", "body"])

    kind = "prime long, piece long, body binary"
    partial = fit.mapInArrow(run, kind).withColumn("salt", F.spark_partition_id() % SALTS)
    return partial.groupBy("prime", "piece", "salt").applyInArrow(added, kind).groupBy("prime", "piece").applyInArrow(added, kind)


def chinese_remainders(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The whole numbers, of either sign, that leave ``residues`` by prime; an array of Python's integers."""
    found, product = np.zeros(len(next(iter(residues.values()))), object), 1
    for prime, values in residues.items():
        step = (values.astype(object) - found) % prime * pow(product, -1, prime) % prime
        found, product = found + product * step, product * prime
    return np.where(found > product // 2, found - product, found)


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray  # object: exact sums by dimension
    components: np.ndarray  # a column each
    variances: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def scaled(self, most: int) -> np.ndarray:
        """The components over their deviation; NaN for those without variance."""
        e = self.variances[:most]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(e > LEAST * max(float(self.variances[0]), 0.0), self.components[:, :most] / np.sqrt(e), np.nan)

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        if self.n * (int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))) < 1 << 53:
            centred = (self.n * x - self.sums.astype(np.int64)) / self.n
        else:
            centred = ((x.astype(object) * self.n - self.sums) / self.n).astype(np.float64)
        return centred @ self.scaled(most)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if self.dim * most * most < 1 << 63:
            return ((self.n * x - self.sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        found = ((x.astype(object) * self.n - self.sums) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in found]


def scatter(fit: DataFrame) -> np.ndarray | None:
    """The exact matrix ``[1, x]' [1, x]`` over the fit list; None for an empty one."""
    n, most, low, dim = fit.agg(F.count(F.lit(1)), F.max("most"), F.min("dim"), F.max("dim")).first()
    if not n:
        return None
    if low != dim:
        raise ValueError(f"vectors of {low} components and of {dim} in one column")
    rows = scatter_residues(fit, dim, primes(np.log2(n) + 2 * np.log2(max(most, 1)) + 2)).collect()  # a matrix of each prime
    residues: dict[int, list] = {}
    for row in sorted(rows, key=lambda r: (r["prime"], r["piece"])):
        residues.setdefault(row["prime"], []).append(np.frombuffer(row["body"], np.int64))
    found = np.zeros((dim + 1,) * 2, object)
    upper = np.triu_indices(dim + 1)
    found[upper] = chinese_remainders({p: np.concatenate(v) for p, v in residues.items()})
    found.T[upper] = found[upper]
    return found


def fitted(exact: np.ndarray) -> Whitening:
    """Components of the covariance by falling variance, from the exact scatter matrix."""
    n, sums = int(exact[0, 0]), exact[0, 1:]
    top = n * exact[1:, 1:] - np.outer(sums, sums)
    covariance = (top / (n * n)).astype(np.float64)  # whole numbers, divided and rounded once
    variances, components = np.linalg.eigh(covariance)
    variances, components = variances[::-1], components[:, ::-1]
    largest = components[np.abs(components).argmax(axis=0), np.arange(len(sums))]
    return Whitening(n, sums, components * np.sign(largest), variances, float(np.trace(covariance)))


def identity_error(fit: DataFrame, model: Whitening, most: int) -> float | None:
    """The largest entry of the whitened fit list's covariance less the identity, measured on its rows."""
    used = np.flatnonzero(np.isfinite(model.scaled(most)).all(axis=0))
    if not len(used):
        return None
    shared = fit.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(used) + 1,) * 2)
        for batch in batches:
            w = shared.value.whitened(_matrix(batch, shared.value.dim), most)[:, used]
            w = np.hstack([np.ones((len(w), 1)), w])
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int64()), pa.array(j.ravel(), pa.int64()), pa.array(total.ravel(), pa.float64())], names=["i", "j", "v"])

    rows = fit.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((len(used) + 1,) * 2)
    for i, j, v in rows:
        total[i, j] = v
    mean = total[0, 1:] / model.n
    return float(np.abs(total[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(len(used))).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = saved(fit_list(rows, vector))
    exact = scatter(fit)
    if exact is None:
        return rows.sparkSession.createDataFrame([], schema)
    model = fitted(exact)
    kept, error = min(most, model.dim), identity_error(fit, model, most)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.variances[:kept]]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole_vectors(batch.column(1), SCALE)
            if not len(at):
                continue
            whitened = shared.value.whitened(x, kept).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, kept))),
                    pa.array(np.tile(np.arange(1, kept + 1), len(at)), pa.int32()),
                    pa.array(np.full(len(at) * kept, shared.value.n), pa.int64()),
                    pa.array([v for v in shared.value.deviations(x) for _ in range(kept)], pa.int64()),
                    pa.array(whitened, pa.float64(), mask=np.isnan(whitened)),
                    pa.array(explained * len(at), pa.float64()),
                    pa.array([error] * (len(at) * kept), pa.float64()),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col(key), F.col(vector)).mapInArrow(run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
