"""Arrow UDFs that make Python objects of a small part of a batch at a time.

Spark sends up to 10,000 rows or 64 MB at once.  As Python objects, with what is built of them, that is several times as
much in each worker, so a function is given slices of about ``BYTES``, and each slice's result goes back on its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes and rows of a slice; a slice has one row at least.
BYTES, ROWS = 1 << 20, 1024


def slices(arrays: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of equal length, cut alike into runs of rows, each ended by the row with which it holds ``BYTES`` or ``ROWS``."""
    at, rows = 0, len(arrays[0])
    while at < rows:
        most = min(ROWS, rows - at)
        step = 1 + bisect_left(range(1, most), BYTES, key=lambda n: sum(a.slice(at, n).nbytes for a in arrays))
        yield tuple(a.slice(at, step) for a in arrays)
        at += step


def by_slices(function: Callable[..., pa.Array], kind: str, *columns: Column) -> Column:
    """``function(array, ...)`` of columns, as ``F.arrow_udf`` with the type ``kind`` would give it, called for a slice at a time."""

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            for part in slices((array,)):
                yield function(*part)

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            for part in slices(arrays):
                yield function(*part)

    return F.arrow_udf(one if len(columns) == 1 else many, kind).asNondeterministic()(*columns)
