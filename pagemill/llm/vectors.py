"""Vectors of whole numbers from array columns, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def whole_vectors(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors, and ``floor(scale * component)`` of those as an int64 matrix.

    Null and empty vectors and those with null or non-finite components aren't usable.  Vectors
    of different lengths, and numbers beyond 64 bits, are errors.
    """
    lists = column.cast(pa.list_(pa.float64()))
    values = lists.values.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    length = np.diff(offsets)
    known = ~lists.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(known & (length > 0) & (odd[offsets[1:]] == odd[offsets[:-1]]))
    if not len(rows):
        return rows, np.zeros((0, 0), np.int64)
    dim = int(length[rows[0]])
    if (length[rows] != dim).any():
        raise ValueError(f"vectors of {dim} components and of {int(length[rows][length[rows] != dim][0])} in one column")
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values[offsets[rows][:, None] + np.arange(dim)])
    if not (np.abs(scaled) < 2.0**63).all():
        raise OverflowError("a component doesn't fit in 64 bits")
    return rows, scaled.astype(np.int64)


def small(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type."""
    most = max(-int(matrix.min()), int(matrix.max())) if matrix.size else 0
    return matrix.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
