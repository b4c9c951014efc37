"""Operator 8: document quality from a linear-chain CRF over lines.

Every line is good or bad.  Features of the line and of its neighbours give each line's
score, two transition weights (bad after bad, good after good) tie neighbouring labels, and
forward-backward gives each line's probability of being good.  A document's quality is the mean of these, weighted by
line length, put on a scale where 0.3 is the cut learned from the training documents.

Training: lines of a labelled document carry its label; the conditional likelihood is
maximised by gradient steps, documents of both classes weighing the same in total.  Only rows
with ``crc32(id) mod 5 <> 0`` are used, lowest by hash of the id first: whole texts, as many as have
``lines`` lines in all and ``sample`` rows at most, one an id; a text of over a twentieth of ``lines`` is left out alone.  This is the one bounded sample.  Scoring reads whole texts, in a
narrow map without a shuffle.

Cases: null text counts as one empty line, as does empty text; very long texts are one chain;
repeated rows get equal results; without labels of both classes every score is 0.5; null
labels and ids are not used; the label, language, source and id are never features; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import SPACE_BYTES, saved, table

SAMPLE, LINES, FOLDS = 5_000, 200_000, 5
CUT = 0.3
CHUNK = 4 << 20  # bytes of texts that are scored together
_UPPER, _MARKS, _DIGITS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"0123456789", b"#*$%&|<>"
NAMES = ("symbols", "marks", "digits", "upper", "repeated", "same_line", "short", "long_words", "ended", "blank", "known")


def line_counts(text: bytes) -> list[tuple[int, ...]]:
    """For each line: bytes, words, letters of words, symbols, marks, digits, capitals, distinct words, copies, ended, known words."""
    lines = text.split(b"\n")
    copies = Counter(lines)
    seen: set[bytes] = set()
    rows = []
    for line in lines:
        size = len(line)
        words = line.split()
        distinct = set(words)
        known = len(distinct & seen)
        seen |= distinct
        rows.append(
            (
                size,
                len(words),
                len(line.translate(None, SPACE_BYTES)),
                size - len(line.translate(None, _SYMBOLS)),
                size - len(line.translate(None, _MARKS)),
                size - len(line.translate(None, _DIGITS)),
                size - len(line.translate(None, _UPPER)),
                len(distinct),
                copies[line],
                line.rstrip()[-1:] in (b".", b"!", b"?"),
                known,
            )
        )
    return rows


def line_features(counts: np.ndarray) -> np.ndarray:
    size, words, letters, symbols, marks, digits, upper, distinct, copies, ended, known = counts.T.astype(float)
    w, c = np.maximum(words, 1), np.maximum(letters, 1)
    return np.stack(
        [
            np.minimum(symbols / w, 3) / 3,
            np.minimum(marks / w, 2) / 2,
            digits / c,
            upper / c,
            np.where(words > 7, 1 - distinct / w, 0.0),
            np.minimum(copies - 1, 3) / 3 * (words > 0),
            1 / (1 + words / 8),
            np.minimum(letters / w, 16) / 16,
            ended,
            words == 0,
            known / np.maximum(distinct, 1),
        ],
        axis=1,
    )


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own, previous and next features of each line; ``starts``: the first line of each document."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts] = 0
    after[starts[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


class Chain(NamedTuple):
    weights: np.ndarray  # of the good label
    stay: tuple[float, float]  # added where neighbouring lines are both bad, both good
    cut: float  # document mean that is put at CUT

    def marginals(self, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return forward_backward(score, lengths, self.stay)[0]

    def quality(self, mean: np.ndarray) -> np.ndarray:
        low = CUT * mean / self.cut
        high = CUT + (1 - CUT) * (mean - self.cut) / (1 - self.cut)
        return np.clip(np.where(mean < self.cut, low, high), 0.0, 1.0)


def forward_backward(score: np.ndarray, lengths: np.ndarray, stay: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, P(both bad) and P(both good) of each pair of neighbours (at the later), log partitions.

    ``score``: each line's score for good over bad.  Chains are laid side by side, longest
    first, so one step works on all chains that still run.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    most = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(most), "left")  # chains longer than t
    forward = np.zeros((len(score), 2))
    backward = np.zeros((len(score), 2))
    for t in range(most):
        at = starts[: running[t]] + t
        if t:
            f = forward[at - 1]
            forward[at, 0] = np.logaddexp(f[:, 0] + stay[0], f[:, 1])
            forward[at, 1] = np.logaddexp(f[:, 0], f[:, 1] + stay[1])
        forward[at, 1] += score[at]
    for t in range(most - 2, -1, -1):
        at = starts[: running[t + 1]] + t
        b0, b1 = backward[at + 1, 0], backward[at + 1, 1] + score[at + 1]
        backward[at, 0] = np.logaddexp(b0 + stay[0], b1)
        backward[at, 1] = np.logaddexp(b0, b1 + stay[1])
    each = forward + backward
    total = np.logaddexp(each[:, 0], each[:, 1])
    good = np.exp(each[:, 1] - total)
    later = np.ones(len(score), bool)
    later[starts] = False
    k = np.flatnonzero(later)
    both = np.zeros((len(score), 2))
    b = backward[k].copy()
    b[:, 1] += score[k]
    both[k] = np.exp(forward[k - 1] + b + np.array(stay) - total[k, None])
    return good, both, total[np.cumsum(lengths) - 1]


def train(x: np.ndarray, lengths: np.ndarray, good: np.ndarray, size: np.ndarray, steps: int = 150, rate: float = 0.15, l2: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by Adam.  ``good``: label of each chain; ``size``: bytes of each line."""
    starts = np.cumsum(lengths) - lengths
    chain = np.repeat(np.arange(len(lengths)), lengths)
    y = good[chain].astype(float)
    # each chain counts once, each class half
    each = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1)) / lengths
    weigh = each[chain]
    paired = np.ones(len(x))
    paired[starts] = 0
    seen = np.stack([1 - y, y], axis=1)  # the label that both of a pair have: a chain has one label
    theta = np.zeros(x.shape[1] + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, both, _ = forward_backward(x @ theta[:-2], lengths, theta[-2:])
        slope = np.append(x.T @ (weigh * (p - y)), (weigh * paired) @ (both - seen)) + l2 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[-2:] = np.clip(theta[-2:], 0.0, 1.5)  # weak ties: line labels copy the document's
    model = Chain(theta[:-2], (float(theta[-2]), float(theta[-1])), 0.5)
    means = document_means(model.marginals(x @ model.weights, lengths), size, lengths)
    return model._replace(cut=best_cut(means, good))


def document_means(marginals: np.ndarray, size: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    starts = np.cumsum(lengths) - lengths
    weight = size + 1.0
    return np.add.reduceat(marginals * weight, starts) / np.add.reduceat(weight, starts)


def best_cut(means: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best balanced accuracy, in the middle of the widest such gap."""
    values = np.unique(np.concatenate([[0.0], means, [1.0]]))
    cuts = (values[1:] + values[:-1]) / 2
    a, b = np.sort(means[good]), np.sort(means[~good])
    right = (len(a) - np.searchsorted(a, cuts)) / max(len(a), 1) + np.searchsorted(b, cuts) / max(len(b), 1)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    widest = best[np.argmax((values[1:] - values[:-1])[best])]
    return float(np.clip(cuts[widest], 0.01, 0.99))


#: A labelled text of more than this part of all lines isn't learned from.
LONGEST = 20


def _prepared(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = [line_counts(t) for t in texts]
    return _arranged(np.array([c for r in rows for c in r], np.int64), np.array([len(r) for r in rows]))


def _arranged(counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = with_neighbours(line_features(counts), np.cumsum(lengths) - lengths)
    return x, lengths, counts[:, 0].astype(float)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, lines: int = LINES) -> Chain | None:
    fold = F.crc32(F.col(key).cast("string")) % FOLDS
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold != 0))
        .groupBy(key)
        .agg(F.min(label).alias("__label"))
        .orderBy(F.xxhash64(key), key)
        .limit(sample)
    )
    # at most ``sample`` rows of two numbers: the bound that makes the broadcasts safe
    texts = docs.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text"))
    joined = texts.join(F.broadcast(chosen.withColumnRenamed(key, "__key")), "__key")
    rows = saved(joined.groupBy("__key", "__label").agg(F.min("__text").alias("__text")))  # of several texts of an id one
    size = F.when(F.octet_length("__text") > 0, F.regexp_count(F.col("__text").cast("string"), F.lit("\n")) + 1).otherwise(1)
    # a text of more than a twentieth of ``lines`` is left out alone; of the others those whose lines, by hash of the id, fit in all
    so_far = F.sum("__n").over(Window.orderBy(F.xxhash64("__key"), "__key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = rows.select("__key", size.alias("__n")).where(F.col("__n") <= max(lines // LONGEST, 1))
    kept = sizes.withColumn("__sum", so_far).where(F.col("__sum") <= lines).select("__key")
    rows = rows.join(F.broadcast(kept), "__key", "left_semi").select("__label", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.array(line_counts(t.as_py() or b""), np.int32).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0).cast(pa.int32()), pa.array(each, pa.binary())], ["label", "counts"])

    found = sorted((bytes(r["counts"]), r["label"]) for r in rows.mapInArrow(run, "label int, counts binary").collect())
    good = np.array([label != 0 for _, label in found], bool)
    if not len(good) or good.all() or not good.any():
        return None
    counts = [np.frombuffer(c, np.int32).reshape(-1, len(NAMES)) for c, _ in found]
    x, lengths, size = _arranged(np.concatenate(counts), np.array([len(c) for c in counts]))
    return train(x, lengths, good, size)


def scored(docs: DataFrame, model: Chain | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the quality of each text."""
    kind = docs.schema[key].dataType.simpleString()

    def score(texts: list[bytes]) -> np.ndarray:
        if model is None or not texts:
            return np.full(len(texts), 0.5)
        x, lengths, size = _prepared(texts)
        return model.quality(document_means(model.marginals(x @ model.weights, lengths), size, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, chunk, held = [], [], 0
            for value in batch.column(1):
                chunk.append(value.as_py() or b"")
                held += len(chunk[-1])
                if held >= CHUNK:
                    parts.append(score(chunk))
                    chunk, held = [], 0
            parts.append(score(chunk))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(parts))], [key, "score"])

    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {kind}, score double")


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
