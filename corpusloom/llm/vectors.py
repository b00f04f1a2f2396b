"""Embedding near duplicates by random-hyperplane sign hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.buckets import PART_ROWS, meet, near_pairs, whole_groups
from corpusloom.llm.components import connected_components
from corpusloom.session import materialize

# At a cosine of 0.9 two signs agree with p = 1 - acos(0.9) / pi = 0.856, so that
# 1 - (1 - p^14)^32 = 98 % of such pairs share a bucket in some table; closer pairs more.
TABLES = 32
SIGNS = 14
SMALL_GROUP = 32
# Rows of one side of a matrix product.
BLOCK = 512


def hyperplanes(dim: int, tables: int, signs: int, seed: int = 10) -> np.ndarray:
    """Normals of all tables as columns, the same in every task."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * signs))


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Double-precision unit vectors; scaled first, so that squares neither overflow nor vanish."""
    rows = values.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def sign_keys(rows: np.ndarray, tables: int, signs: int) -> np.ndarray:
    """One integer per row and table: the sides of its hyperplanes."""
    sides = rows @ hyperplanes(rows.shape[1], tables, signs) >= 0
    weights = 1 << np.arange(signs)
    return sides.reshape(len(rows), tables, signs) @ weights


def _matrix(column: pa.ChunkedArray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)[rows]


def sign_buckets(classes: DataFrame, tables: int = TABLES, signs: int = SIGNS) -> DataFrame:
    """``(dim, node, copies, vector, keys)`` of every class, ``keys`` with one bucket number per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            # One matrix per vector length; the lengths of a batch are few.
            for dim in np.unique(table.column("dim").to_numpy()):
                part = table.filter(pa.array(table.column("dim").to_numpy() == dim))
                keys = sign_keys(unit_rows(_matrix(part.column("vector"))), tables, signs)
                listed = pa.ListArray.from_arrays(
                    np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.astype(np.int32).ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).combine_chunks() for c in ("dim", "node", "copies", "vector")), listed],
                    names=["dim", "node", "copies", "vector", "keys"],
                )

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("dim", "node", "copies", "vector").mapInArrow(
        run, f"dim int, node long, copies long, vector {kind}, keys array<int>"
    )


def bucket_links(hashed: DataFrame, threshold: float, limit: int = PART_ROWS) -> DataFrame:
    """``(node, other, links)`` from all buckets of all tables.

    ``links`` counts the vectors of linked classes whose pair no earlier table
    holds, so sums over tables count every pair once without listing pairs.
    ``other`` is the smallest linked class, or null: these edges keep a linked
    component together only with :func:`_forest`, which adds what is missing.
    """
    rows = hashed.select("dim", "node", "copies", "vector", "keys", F.posexplode("keys").alias("t", "k"))
    placed = meet(rows, ["dim", "t", "k"], F.col("node"), limit)
    keys = ["dim", "t", "k", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, keys):
            for first, last in _same_dim(table.column("dim").to_numpy(), bounds):
                part = table.slice(bounds[first], bounds[last] - bounds[first])
                yield from _group_rows(part, bounds[first : last + 1] - bounds[first], threshold)

    return placed.mapInArrow(run, "node long, other long, links long")


def _same_dim(dims: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of groups whose vectors have one length."""
    of_group = dims[bounds[:-1]]
    cuts = [0, *(np.flatnonzero(np.diff(of_group)) + 1), len(of_group)]
    yield from zip(cuts[:-1], cuts[1:])


def _group_rows(table: pa.Table, bounds: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    vectors, keys = unit_rows(_matrix(table.column("vector"))), _matrix(table.column("keys"))
    node, copies, t = (table.column(c).to_numpy() for c in ("node", "copies", "t"))
    part, cross = table.column("part").to_numpy(), table.column("lo").to_numpy() != table.column("hi").to_numpy()
    links = np.zeros(len(node), np.int64)
    left, right = [], []

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", vectors[i], vectors[j]) >= threshold

    def first_table(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Is this the first table in which the pair shares a bucket?"""
        return (keys[i] == keys[j]).argmax(axis=1) == t[i]

    def count(i: np.ndarray, j: np.ndarray) -> None:
        new = first_table(i, j)
        np.add.at(links, i[new], copies[j[new]])
        np.add.at(links, j[new], copies[i[new]])

    a, b = near_pairs(bounds, lambda i, j: ~(cross[i] & (part[i] == part[j])) & linked(i, j), SMALL_GROUP)
    count(a, b)
    left.append(node[a])
    right.append(node[b])
    for g in np.flatnonzero(np.diff(bounds) > SMALL_GROUP):
        lo, hi = bounds[g], bounds[g + 1]
        root = np.arange(lo, hi)
        for x in range(lo, hi, BLOCK):
            for y in range(x, hi, BLOCK):
                i, j = np.nonzero(vectors[x : min(x + BLOCK, hi)] @ vectors[y : min(y + BLOCK, hi)].T >= threshold - 1e-9)
                i, j = i + x, j + y
                ok = (i < j) & ~(cross[i] & (part[i] == part[j]))
                i, j = i[ok], j[ok]
                ok = linked(i, j)
                i, j = i[ok], j[ok]
                count(i, j)
                _join(root, i - lo, j - lo, lo)
        tied = root != np.arange(lo, hi)
        left.append(node[lo:hi][tied])
        right.append(node[root[tied]])
    own = np.flatnonzero(links)
    none = pa.nulls(len(own), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(node[own]), none, pa.array(links[own])], names=["node", "other", "links"]
    )
    a, b = np.concatenate(left), np.concatenate(right)
    yield pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], names=["node", "other", "links"]
    )


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray, base: int) -> None:
    """Lower ``root`` (positions from ``base``) until linked rows share the smallest."""
    while True:
        a, b = root[i], root[j]
        least = np.minimum(a, b)
        if (a == b).all():
            return
        np.minimum.at(root, a - base, least)
        np.minimum.at(root, b - base, least)
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        while True:
            up = root[root - base]
            if (up == root).all():
                break
            root[:] = up


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    tables: int = TABLES,
    signs: int = SIGNS,
    limit: int = PART_ROWS,
) -> DataFrame:
    """``(<id_col>, n_links, component_id, kept)``, one row per input row.

    Rows link if their cosine in double precision is ``threshold`` or more and a
    table puts them into one bucket; equal vectors always link. A vector that is
    null, empty, zero, or holds null or non-finite components links with
    nothing and is its own component, as are vectors of different lengths to
    each other. Every row counts as a vector, repeated ids included. A null id
    has a null component unless it links with a row that has an id, and is kept
    if its component is null. Other columns are not read.
    """
    usable = (
        F.col("vector").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), F.col("vector")))
    classes = (
        rows.where("vector IS NOT NULL")
        .groupBy("vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
        .select("vector", "copies", "least", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node"))
    )
    classes = materialize(classes, "vector-classes")
    hashed = materialize(sign_buckets(classes, tables, signs), "signs")
    found = materialize(bucket_links(hashed, threshold, limit), "links")
    joined = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = (
        classes.drop("dim")
        .join(counted, "node", "left")
        .join(joined, "node", "left")
        .select("vector", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialize(rooted.join(names, "root").select("vector", "n_links", "component_id"), "labels")
    good = rows.where("vector IS NOT NULL").join(labels, "vector").select("id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionAll(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
