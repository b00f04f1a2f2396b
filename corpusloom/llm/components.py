"""Connected components of an edge table by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize, release

# Tasks that the edges of one node are dealt over when its minimum comes back to them.
SALTS = 16


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node with an edge, smallest member excluded.

    ``edges`` holds ``a, b`` of one orderable type without nulls; loops are
    ignored. ``component`` is the smallest node reachable. Each round is written
    to the shared folder in place of the last, and the edges shrink towards one star per component;
    rounds grow with the logarithm of the longest chain. Minima combine on the
    map side, so a hub is one row per task in that shuffle, and the join that
    carries them back deals a hub's rows over ``SALTS`` tasks.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    current = materialize(edges.where(F.col("a") != F.col("b")).select(high, low).distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        last, current = current, materialize(_small_star(_large_star(current)), "edges")
        release(last)
        before, mark = mark, _mark(current)
        if mark == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Count and hash sum of an edge set: two numbers."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` with the ``m`` of their ``u``: one row of two values per node is repeated, hubs are salted."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    repeated = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(repeated, ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest of it and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = _with_least(both, least).where(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
