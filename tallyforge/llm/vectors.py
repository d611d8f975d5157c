"""Vectors as matrices of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    held = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(held, F.lit(False))


def totals(rows: DataFrame, vector: str = "vector") -> tuple[int, int, float]:
    """Number of rows, length of the longest vector, largest magnitude of a component."""
    largest = F.greatest(F.abs(F.array_max(vector)), F.abs(F.array_min(vector)))
    found = rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("d"),
        F.coalesce(F.max(largest), F.lit(0.0)).alias("m"),
    ).first()
    return found["n"], found["d"], found["m"]


def floored(vectors: pa.ListArray, dimensions: int, scale: int, limit: int) -> np.ndarray:
    """floor(scale * component), held to -limit..limit, as a matrix of 64-bit numbers; short vectors are filled with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    cells = np.zeros((len(vectors), dimensions), np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        cells[np.arange(dimensions) < lengths[:, None]] = np.clip(np.floor(scale * values), -float(limit), float(limit))
    return cells


def packed(cells: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    joined = np.ascontiguousarray(cells)
    width = joined.shape[1] * joined.itemsize
    ends = np.arange(len(joined) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(joined), [None, pa.py_buffer(ends), pa.py_buffer(joined)]
    ).cast(pa.binary())


def unpacked(column: pa.Array, dimensions: int, kind: type) -> np.ndarray:
    """The matrix that `packed` took apart, whose numbers were of the type `kind`."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dimensions)
