"""Vector columns as numpy matrices, one matrix per vector length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Beyond this a double has no exact whole number of its own.
EXACT = float(1 << 53)


def finite_vector(vector: Column, scale: float = 1.0) -> Column:
    """Is this a vector, not empty, with finite entries only, none null, whose ``scale``-fold is an exact whole number when cut?"""
    bound = F.lit(EXACT / 2 / scale)
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & whole, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def by_length(batches: Iterator[pa.RecordBatch], vector: str = "vector") -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """``(length, rows, their matrix)`` for each vector length of each batch; the lengths of a batch are few."""
    for batch in batches:
        lengths = batch.column(vector).value_lengths().to_numpy(zero_copy_only=False)
        table = pa.Table.from_batches([batch])
        for length in np.unique(lengths):
            part = table.filter(pa.array(lengths == length))
            yield int(length), part, matrix(part.column(vector))
