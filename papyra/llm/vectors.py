"""Which vectors take part in a search, and vectors of a batch as numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not all zero."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def by_length(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each vector length in the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    size = pc.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    at = np.cumsum(size) - size
    out = []
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        out.append((rows, flat[at[rows][:, None] + np.arange(n)[None, :]]))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
