"""Dense global positions and per-group order statistics.

A window over one group is one task, and a group may hold a third of the
corpus. Here the rows are range-partitioned on their whole sort key instead, so
a large group spreads over many partitions, and only one number per partition
is summed up centrally.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

# monotonically_increasing_id keeps the partition above bit 33.
ROW_BITS = 33


def global_index(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Add ``name`` = 1.. in the order of ``keys``, which must be unique together.

    The sorted rows go to the shared folder once, so that sizes and rows come
    from the same evaluation even if executors are lost. ``finish`` may add
    columns row by row on the way there, after the shuffle and its sampling.
    """
    stamped = _sorted_table(df, keys, name, finish)
    columns = [c for c in stamped.columns if c != "_stamp"]
    stamped = stamped.select(
        *columns,
        F.shiftright("_stamp", ROW_BITS).cast("int").alias("_part"),
        F.col("_stamp").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"),
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort.
    offsets = (
        stamped.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return stamped.join(F.broadcast(offsets), "_part").select(
        *columns, (F.col("_offset") + F.col("_row") + 1).alias(name)
    )


def _sorted_table(
    df: DataFrame, keys: Sequence[str], name: str, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """Rows in the order of ``keys``, written with ``_stamp``: the partition above ``ROW_BITS``, the row in it below."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(finish(ordered.withColumn("_stamp", F.monotonically_increasing_id())), name)


def group_rank(df: DataFrame, group: str, keys: Sequence[str], name: str) -> DataFrame:
    """Add the 1-based rank by ``keys`` inside each ``group``.

    ``group`` is a class label: the broadcast side has one row per class.
    """
    placed = global_index(df.where(F.col(group).isNotNull()), [group, *keys], "place")
    firsts = placed.groupBy(group).agg(F.min("place").alias("_first"))
    return placed.join(F.broadcast(firsts), group).select(
        *df.columns, (F.col("place") - F.col("_first") + 1).alias(name)
    )


def value_at_rank(
    df: DataFrame, group: str, keys: Sequence[str], rank: Column, n: str = "n", value: str = "cut"
) -> DataFrame:
    """``(group, n, value)``: the first key of the row whose rank is ``rank``.

    ``rank`` is an expression over ``n``, the rows of the group. ``value`` is
    null where no row has that rank.

    The sorted table is read twice: for the rows of each group in each
    partition, two numbers that tell which row is wanted, and for that row.
    """
    stamped = _sorted_table(df.where(F.col(group).isNotNull()), [group, *keys], "ranked")
    spans = stamped.groupBy(group, F.shiftright("_stamp", ROW_BITS).alias("_part")).agg(
        F.min("_stamp").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    own = Window.partitionBy(group)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A group has at most one row per partition of the sort.
    spans = spans.select(
        group, "_first", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(own).alias(n)
    )
    at = rank - F.col("_before")
    stamp = F.when((at > 0) & (at <= F.col("_rows")), F.col("_first") + at - 1)
    wanted = materialize(spans.groupBy(group).agg(F.first(n).alias(n), F.max(stamp).alias("_stamp")), "wanted")
    hits = stamped.select("_stamp", F.col(keys[0]).alias(value)).join(F.broadcast(wanted.select(group, "_stamp")), "_stamp")
    return wanted.select(group, n).join(hits.drop("_stamp"), group, "left")
