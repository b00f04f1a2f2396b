"""Rows that share a bucket meet in one task, large buckets in several.

A bucket of more than ``limit`` rows is cut into parts, and each pair of parts
becomes a group of its own, so that a group holds at most about two parts, every
pair of rows still meets exactly once, and no task holds a whole hot bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

PART_ROWS = 4096


def meet(rows: DataFrame, keys: Sequence[str], salt: Column, limit: int = PART_ROWS) -> DataFrame:
    """Add ``lo, hi, part``, and put every group ``(keys, lo, hi)`` together, in order.

    Rows of equal ``part`` in a group with ``lo < hi`` have met elsewhere. ``rows``
    is evaluated twice and should come from a written table.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    # Written first, so that its size is known when the join is planned; usually it is empty.
    hot = materialize(sizes, "hot-buckets")
    parts = F.coalesce(F.ceil(F.col("_rows") / F.lit(limit)).cast("int"), F.lit(1))
    placed = (
        rows.join(hot, list(keys), "left")
        .withColumn("part", F.pmod(F.xxhash64(salt), parts.cast("long")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("lo", F.least("part", "_other"))
        .withColumn("hi", F.greatest("part", "_other"))
        .drop("_rows", "_other")
    )
    group = [*keys, "lo", "hi"]
    return placed.repartition(*group).sortWithinPartitions(*group)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, with the bounds of their groups.

    The last group of a batch waits for the next batch, so memory is bounded by a
    batch and a group.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        starts = _starts(table, keys)
        rest = table.slice(starts[-1])
        if starts[-1]:
            yield table.slice(0, starts[-1]).combine_chunks(), starts
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def group_of(bounds: np.ndarray) -> np.ndarray:
    """The number of the group of each row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def near_pairs(bounds: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray], largest: int):
    """Pairs of rows of one group, for groups up to ``largest`` rows, that pass ``test``.

    Row i is held against row i + 1, i + 2, .. for all groups at once.
    """
    sizes = np.diff(bounds)
    left = np.repeat(bounds[1:], sizes) - np.arange(bounds[-1])
    left[np.repeat(sizes > largest, sizes)] = 0
    found = []
    step = 1
    at = np.flatnonzero(left > step)
    while len(at):
        hit = test(at, at + step)
        if hit.any():
            found.append((at[hit], at[hit] + step))
        step += 1
        at = at[left[at] > step]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
