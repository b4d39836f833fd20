"""Vectors as whole numbers: 1024ths of every component, floored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, functions as F

SCALE = 1024
#: Components from 65,536 on have no place: their squares and sums would leave a long.
MOST = 1 << 26


def usable(vector: Column) -> Column:
    """Not null and without null, non-finite or too large components. An empty vector is usable."""
    fine = lambda x: F.coalesce(F.abs(x.cast("double")) < MOST / SCALE, F.lit(False))  # NaN is greater than all
    return vector.isNotNull() & F.forall(vector, fine)


def whole_numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their int64 vectors, for every length among usable vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values.cast(pa.float64()))
    lengths = np.diff(offsets)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        places = offsets[rows][:, None] + np.arange(length)
        yield rows, np.floor(values[places] * SCALE).astype(np.int64)


def exact_float(left: int, right: int, width: int) -> bool:
    """Sums of ``width`` products of whole numbers up to these sizes are exact in doubles."""
    return left * right * max(width, 1) < 1 << 53
