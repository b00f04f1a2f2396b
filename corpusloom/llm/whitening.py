"""Embedding whitening: principal components of a distributed covariance, scaled to unit variance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.eigen import leading_pairs
from corpusloom.llm.matrices import by_length, finite_vector
from corpusloom.session import materialize

COMPONENTS = 8
# Fixed values of the whole-number entries: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
# A component with less than this part of the largest variance is rounding and no direction of the data.
LEAST_VARIANCE = 1e-10
LONG = float(1 << 63)


def whole_entries(vectors: np.ndarray) -> np.ndarray:
    """Entries as the whole numbers that are fitted, held exactly by doubles."""
    return np.floor(vectors.astype(np.float64) * SCALE) + SHIFT


def _whole_sums(x: np.ndarray) -> list[int]:
    """Exact column sums, whatever their size."""
    if np.abs(x).max() * len(x) < LONG / 2:
        return x.astype(np.int64).sum(axis=0).tolist()
    return [sum(int(v) for v in column) for column in x.T]


def sums(rows: DataFrame) -> DataFrame:
    """``(dim, k, n, s)``: rows and exact sum of every dimension, for each vector length. A task gives one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for dim, _, vectors in by_length(batches):
            n, s = found.get(dim, (0, [0] * dim))
            own = _whole_sums(whole_entries(vectors))
            found[dim] = n + len(vectors), [a + b for a, b in zip(s, own)]
        for dim, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(dim, dim, np.int32)),
                    pa.array(np.arange(dim, dtype=np.int32)),
                    pa.array(np.full(dim, n)),
                    pa.array([Decimal(v) for v in s], pa.decimal128(38, 0)),
                ],
                names=["dim", "k", "n", "s"],
            )

    parts = rows.mapInArrow(run, "dim int, k int, n long, s decimal(38,0)")
    return parts.groupBy("dim", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def products(rows: DataFrame, means: dict[int, np.ndarray]) -> DataFrame:
    """``(dim, k, v)``: sums of products of centred entries, ``k`` in the order of the upper triangle.

    A task gives one triangle per vector length; the triangles are added up in the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for dim, _, vectors in by_length(batches):
            centred = whole_entries(vectors) - means[dim]
            found[dim] = found.get(dim, 0.0) + centred.T @ centred
        for dim, total in found.items():
            values = total[np.triu_indices(dim)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(values), dim, np.int32)),
                    pa.array(np.arange(len(values), dtype=np.int32)),
                    pa.array(values),
                ],
                names=["dim", "k", "v"],
            )

    return rows.mapInArrow(run, "dim int, k int, v double").groupBy("dim", "k").agg(F.sum("v").alias("v"))


@dataclass(frozen=True)
class Whitening:
    """What one vector length needs: counts, exact sums, and the projection with its shares of the variance."""

    n: int
    sums: list[int]
    means: np.ndarray
    variances: np.ndarray
    directions: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.means) @ (self.directions.T / np.sqrt(self.variances))

    def deviations(self, x: np.ndarray) -> np.ma.MaskedArray:
        """Sum over dimensions of (n x - S)^2 as exact longs; masked where a long cannot hold it.

        Unsigned arithmetic keeps the value modulo 2^64, so it is right whenever it fits.
        """
        total = np.array([s % (1 << 64) for s in self.sums], np.uint64)
        apart = x.astype(np.int64).view(np.uint64) * np.uint64(self.n % (1 << 64)) - total
        exact = (apart * apart).sum(axis=1).view(np.int64)
        size = (((x - self.means) * float(self.n)) ** 2).sum(axis=1)
        return np.ma.MaskedArray(exact, size >= LONG * (1 - 1e-9))


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """One whitening per vector length. The driver holds a length's covariance: the square of one vector."""
    counted: dict[int, dict[int, tuple[int, int]]] = {}
    for r in sums(rows).toLocalIterator():
        counted.setdefault(r["dim"], {})[r["k"]] = r["n"], int(r["s"])
    totals = {dim: (own[0][0], [own[k][1] for k in range(dim)]) for dim, own in counted.items()}
    means = {dim: np.array([v / n for v in s]) for dim, (n, s) in totals.items()}
    squares = {dim: np.zeros(dim * (dim + 1) // 2) for dim in totals}
    if totals:
        for r in products(rows, means).toLocalIterator():
            squares[r["dim"]][r["k"]] = r["v"]
    out = {}
    for dim, (n, s) in totals.items():
        covariance = np.zeros((dim, dim))
        covariance[np.triu_indices(dim)] = squares[dim] / n
        covariance = np.triu(covariance) + np.triu(covariance, 1).T
        values, directions = leading_pairs(covariance, components)
        real = values > LEAST_VARIANCE * values[0]
        trace = float(covariance.trace())
        out[dim] = Whitening(n, s, means[dim], values[real], directions[real], values[real] / trace if trace else values[real])
    return out


def projected(rows: DataFrame, fits: dict[int, Whitening]) -> DataFrame:
    """``(id, dim, deviation, whitened)`` of every row, from the broadcast projections."""
    shared = rows.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, table, vectors in by_length(batches):
            own, x = shared.value[dim], whole_entries(vectors)
            whitened, deviation = own.project(x), own.deviations(x)
            bounds = np.arange(len(x) + 1, dtype=np.int32) * whitened.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("id").combine_chunks(),
                    pa.array(np.full(len(x), dim, np.int32)),
                    pa.array(deviation.data, mask=np.ma.getmaskarray(deviation)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(whitened.ravel())),
                ],
                names=["id", "dim", "deviation", "whitened"],
            )

    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("dim", T.IntegerType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ]
    )
    return rows.mapInArrow(run, schema)


def identity_errors(table: DataFrame, components: int) -> DataFrame:
    """``(dim, identity_error)``: how far the covariance of the whitened rows is from the identity at most."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    entry = lambda i: F.get("whitened", F.lit(i))
    moments = [F.covar_pop(entry(i), entry(j)).alias(f"c{i}_{j}") for i, j in pairs]
    # A component that a length does not have gives null, which greatest() leaves out.
    apart = [F.abs(F.col(f"c{i}_{j}") - F.lit(float(i == j))) for i, j in pairs]
    worst = F.greatest(*apart) if len(apart) > 1 else apart[0]
    return table.groupBy("dim").agg(*moments).select("dim", worst.alias("identity_error"))


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``(<id_col>, component, n, deviation, whitened, explained, identity_error)``, a row per vector and component.

    Entries c become x = floor(1024 c) + 100000. The covariance is that of all
    vectors, centred before multiplying: one scan gives exact sums, a second the
    products, each task one triangle. Householder reflections, Sturm bisection
    and inverse iteration find the components on the driver, whose matrix has
    the size of one vector squared. A third scan projects, and the covariance of
    what it wrote gives ``identity_error``.

    Rows whose vector is null, empty, or holds null or non-finite entries, or
    entries beyond 2^42, whose x no double holds exactly, are left out. Vectors
    of one length are fitted on their own. Components without variance do not
    exist: equal vectors, or a single one, give no rows. ``deviation`` is null
    where a long cannot hold it. Repeated rows and null ids are rows like any
    other; equal eigenvalues give some orthonormal basis, the same for all rows;
    other columns are not read; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(finite_vector(F.col("vector"), SCALE))
    fits = fit(rows, components)
    table = materialize(projected(rows, fits), "whitened")
    spark = vectors.sparkSession
    # One row per vector length.
    known = [(dim, own.n, own.explained.tolist()) for dim, own in fits.items()]
    lengths = spark.createDataFrame(known, "dim int, n long, explained array<double>")
    lengths = lengths.join(identity_errors(table, components), "dim")
    return (
        table.join(F.broadcast(lengths), "dim")
        .select("id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("pos", "whitened"))
        .select(
            F.col("id").alias(id_col), (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
            F.get("explained", F.col("pos")).alias("explained"), "identity_error",
        )
    )
