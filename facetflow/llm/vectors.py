"""Columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import DataType, FloatType


def kind_of(column_type: DataType) -> type:
    """float32 for arrays of floats; float64 for any other numbers, which keep all their digits."""
    return np.float32 if isinstance(column_type.elementType, FloatType) else np.float64


def matrices(column: pa.Array, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
    """The usable vectors, one matrix a length: (rows, row numbers in the column), -0 as 0.

    Unusable: null, empty, all zero, with null or non-finite components.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.nan_to_num(np.array(pc.list_value_length(column).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    out = []
    for width in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == width)
        flat = column.take(pa.array(at)).flatten()
        rows = np.array(flat.to_numpy(zero_copy_only=False), dtype=kind).reshape(len(at), width)
        usable = np.isfinite(rows).all(1) & (rows != 0).any(1)
        out.append((rows[usable] + kind(0), at[usable]))
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def binary_rows(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def from_binary(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of equal length back from ``binary_rows``."""
    if not len(column):
        return np.empty((0, 0), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
