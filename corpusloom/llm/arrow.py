"""Text columns of Arrow batches as byte arrays, cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Text bytes that one piece holds, unless a single row is longer.
PIECE_BYTES = 1 << 19


@dataclass(frozen=True)
class Texts:
    """UTF-8 texts of rows ``first .. last``: one byte array and the bounds of each row."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the bounds of its rows. Null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Texts]:
    """Runs of whole rows of about ``limit`` bytes, at least one row each."""
    if not len(column):
        return
    data, bounds = text_bytes(column)
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield Texts(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], first)
        first = last
