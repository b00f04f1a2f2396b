"""Hard negatives: exact top inner products over lists that the anchors of a cluster share."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.matrices import by_length, finite_vector, matrix
from corpusloom.session import materialize

POSITIVES, NEGATIVES = 5, 3
# Components are compared as floor(SCALE * x).
SCALE = 256
# Above this squared length an inner product may not fit into a long once it is multiplied by 100.
LARGEST = float(1 << 55)
# Anchors from which centroids are learned, at most; the centroids order the work and never change a result.
SAMPLE = 4096
# Sampled anchors per centroid.
PER_CENTROID = 64
ROUNDS = 8
# Anchors and candidates that meet in one task.
BUNDLE, CHUNK = 2048, 16384
# Chunks of a small table, unless they would hold fewer rows than this.
LEAST_CHUNKS, LEAST_ROWS = 24, 512
# Steps of a walk down a shared list.
STEP = 512
# What arc cosines near 1 are wrong by, and more.
SLACK = 1e-7


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay."""
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def centroids(rows: np.ndarray) -> np.ndarray:
    """Directions of spherical k-means, started from evenly spaced rows."""
    rows = unit(rows)
    k = max(1, len(rows) // PER_CENTROID)
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        own = (rows @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        some = np.abs(total).max(axis=1) > 0
        centres = np.where(some[:, None], unit(total), centres)
    return centres


class SharedList:
    """A chunk's candidates by the falling bound that holds for every anchor of a cluster.

    No anchor of the cluster lies further from the centroid than the widest one,
    so its angle to a candidate is at least the candidate's own angle to the
    centroid less that width, and its score is at most ``bound`` times its length.
    """

    def __init__(self, anchors: np.ndarray, centroid: np.ndarray, directions: np.ndarray, lengths: np.ndarray):
        some = np.abs(anchors).max(axis=1, initial=0) > 0
        width = np.arccos(np.clip(unit(anchors[some]) @ centroid, -1, 1)).max(initial=0.0)
        angles = np.arccos(np.clip(directions @ centroid, -1, 1))
        bounds = lengths * (np.cos(np.maximum(angles - width, 0.0)) + SLACK)
        self.order = np.argsort(-bounds, kind="stable")
        self.bounds = bounds[self.order]

    def walk(self, reach: np.ndarray, floor) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(anchors, candidates)`` for step after step of the list.

        An anchor leaves once the bound of all that is left times its length
        ``reach`` is below ``floor()``, the score it still needs: nothing further
        down can enter its result, which is thereby certified. Equal scores go on.
        """
        alive = np.arange(len(reach))
        for at in range(0, len(self.order), STEP):
            alive = alive[self.bounds[at] * reach[alive] >= floor()[alive]]
            if not len(alive):
                return
            yield alive, self.order[at : at + STEP]


class Best:
    """The ``keep`` best (score, id) of each slot, higher scores first, ties by smaller id."""

    def __init__(self, least: np.ndarray, keep: int):
        self.least, self.keep = least, keep
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        kept = place < self.keep
        self.slot, self.score, self.id = slot[kept], score[order][kept], ids[order][kept]
        last = place[kept] == self.keep - 1
        self.least[self.slot[last]] = self.score[last]


@dataclass(frozen=True)
class Side:
    """One side of a meeting: ids, labels and whole-number vectors."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> "Side":
        vectors = matrix(table.column("vector")).astype(np.float64)
        return cls(*(table.column(c).to_numpy() for c in ("id", "label")), vectors, np.linalg.norm(vectors, axis=1))

    def scores(self, rows: np.ndarray, other: "Side", others: np.ndarray) -> np.ndarray:
        """Exact inner products: by doubles where these hold them, by longs elsewhere."""
        a, b = self.vectors[rows], other.vectors[others]
        if self.lengths.max(initial=0.0) * other.lengths.max(initial=0.0) < 1 << 52:
            return (a @ b.T).astype(np.int64)
        return a.astype(np.int64) @ b.astype(np.int64).T


def _clusters(anchors: Side, of: np.ndarray, centres: np.ndarray, candidates: Side) -> Iterator[tuple[np.ndarray, SharedList]]:
    directions = unit(candidates.vectors)
    for cluster in np.unique(of):
        own = np.flatnonzero(of == cluster)
        yield own, SharedList(anchors.vectors[own], centres[cluster], directions, candidates.lengths)


def best_positives(anchors: Side, of: np.ndarray, centres: np.ndarray, candidates: Side, keep: int) -> Best:
    """For each anchor the best candidates of its label but itself."""
    # Before the walk no score is too low.
    best = Best(np.full(len(anchors.ids), np.iinfo(np.int64).min), keep)
    for own, shared in _clusters(anchors, of, centres, candidates):
        for alive, block in shared.walk(anchors.lengths[own], lambda: best.least[own]):
            rows = own[alive]
            scores = anchors.scores(rows, candidates, block)
            fits = (anchors.labels[rows][:, None] == candidates.labels[block]) & (anchors.ids[rows][:, None] != candidates.ids[block])
            i, j = np.nonzero(fits & (scores >= best.least[rows][:, None]))
            best.add(rows[i], scores[i, j], candidates.ids[block[j]])
    return best


def best_negatives(
    anchors: Side, of: np.ndarray, centres: np.ndarray, candidates: Side, positives: np.ndarray, known: np.ndarray, keep: int
) -> Best:
    """For each anchor and positive the best candidates of other labels between 50 and 95 % of the positive's score.

    ``positives`` has a row of scores per anchor, of which ``known`` are there.
    Slot ``i * width + p`` is anchor i with positive p.
    """
    width = positives.shape[1]
    half, most = -(-positives // 2), positives * 19 // 20
    # A slot that no score can fill is done before the walk.
    open_ = known & (half <= most)
    least = np.where(open_, half, np.iinfo(np.int64).max)
    best = Best(least.reshape(-1), keep)
    for own, shared in _clusters(anchors, of, centres, candidates):
        for alive, block in shared.walk(anchors.lengths[own], lambda: best.least.reshape(least.shape)[own].min(axis=1, initial=np.iinfo(np.int64).max)):
            rows = own[alive]
            scores = anchors.scores(rows, candidates, block)
            other = anchors.labels[rows][:, None] != candidates.labels[block]
            for p in range(width):
                slots = rows * width + p
                i, j = np.nonzero(other & (scores >= best.least[slots][:, None]) & (scores <= np.where(open_[rows, p], most[rows, p], np.iinfo(np.int64).min)[:, None]))
                best.add(slots[i], scores[i, j], candidates.ids[block[j]])
    return best


def _rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``(row, id, label, dim, vector)`` of the rows that take part, vectors as whole numbers."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite_vector(F.col("vector"), SCALE))
    whole = F.transform("vector", lambda x: F.floor(x * SCALE).cast("double"))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    return (
        rows.withColumn("vector", whole)
        .where(square < LARGEST)
        .select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("vector").alias("dim"), F.col("vector").cast("array<int>").alias("vector"))
    )


def _centroids(anchors: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Centroids per vector length, learned on the driver from at most ``sample`` anchors."""
    some = anchors.orderBy(F.xxhash64("row"), "row").limit(sample).select("vector").toArrow()
    found: dict[int, list[np.ndarray]] = {}
    for dim, _, vectors in by_length(some.to_batches()):
        found.setdefault(dim, []).append(vectors.astype(np.float64))
    return {dim: centroids(np.concatenate(parts)) for dim, parts in found.items()}


def _clustered(anchors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Anchors with the number of their nearest centroid; lengths that the sample does not have are one cluster."""
    shared = anchors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, table, vectors in by_length(batches):
            own = shared.value.get(dim, np.zeros((1, dim)))
            cluster = (unit(vectors.astype(np.float64)) @ own.T).argmax(axis=1).astype(np.int32)
            yield from table.append_column("cluster", pa.array(cluster)).combine_chunks().to_batches()

    return anchors.mapInArrow(run, "row long, id long, label long, dim int, vector array<int>, cluster int")


def _bundles(sizes: list[tuple[int, int, int]], bundle: int) -> list[tuple[int, int, int, int]]:
    """``(dim, cluster, first, parts)``: small clusters share a bundle of anchors, large ones fill several.

    ``sizes`` holds ``(dim, cluster, anchors)``, at most one row per centroid and length.
    """
    out, number, last, room = [], -1, None, 0
    for dim, cluster, n in sorted(sizes):
        parts = math.ceil(n / bundle)
        if parts > 1 or dim != last or n > room:
            number, last, room = number + 1, dim, bundle
        out.append((dim, cluster, number, parts))
        room -= n
        if parts > 1:
            number, room = number + parts - 1, 0
    return out


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    every: int = 50,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    bundle: int = BUNDLE,
    chunk: int = CHUNK,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``. Scores are integer
    inner products of ``floor(256 x)``, higher first, ties by smaller id. An
    anchor's positives are its first rows of the same label, rows of its own id
    left out; for each, the first rows of other labels with ``50 * positive_score
    <= 100 * negative_score <= 95 * positive_score`` are returned.

    Anchors are clustered around centroids learned from a bounded sample, and
    bundles of at most about ``bundle`` anchors meet chunks of about ``chunk``
    candidates, each pair of a bundle and a chunk in a task of its own; a cluster
    of many equal anchors is dealt over several bundles. In a task every cluster
    sorts the chunk by angular bound once, and its anchors walk that list until
    what is left cannot enter their results. The best of all chunks are then
    ranked. This is done for positives, and again for negatives within the
    scores that the positives allow.

    Rows without an id or label, with a vector that is null, empty or holds null
    or non-finite components, or whose squared length after scaling is 2^55 or
    more, so that scores do not fit into longs, take no part. Vectors of
    different lengths have no score. Every row counts: repeated rows are
    positives or negatives as often as they occur, and repeated anchors give
    their rows each. Other columns are not read; an empty table, or one without
    anchors, gives an empty result.
    """
    rows = materialize(_rows(vectors, id_col, label_col, vector_col), "whole-vectors")
    spark = vectors.sparkSession
    chosen = rows.where(F.col("id") % every == 0)
    centres = _centroids(chosen, sample)
    clustered = materialize(_clustered(chosen, centres), "anchors")
    sizes = clustered.groupBy("dim", "cluster").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per centroid
    placed = _bundles([(r["dim"], r["cluster"], r["n"]) for r in sizes], bundle)
    plan = spark.createDataFrame(placed, "dim int, cluster int, first int, parts int")
    groups = plan.groupBy("dim").agg(F.min("first").alias("low"), F.max(F.col("first") + F.col("parts") - 1).alias("high"))
    n = rows.count()
    chunks = max(math.ceil(n / chunk), min(LEAST_CHUNKS, math.ceil(n / LEAST_ROWS)), 1)
    part = F.pmod(F.xxhash64("row"), F.col("parts").cast("long")).cast("int")
    anchors = clustered.join(F.broadcast(plan), ["dim", "cluster"]).withColumn("bundle", F.col("first") + part).drop("first", "parts")
    candidates = (
        rows.join(F.broadcast(groups), "dim")
        .select("id", "label", "vector", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence("low", "high")).alias("bundle"))
        .groupBy("bundle", "chunk")
    )
    shared = spark.sparkContext.broadcast(centres)

    def meet(given: DataFrame):
        dealt = given.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        return dealt.groupBy("bundle", "chunk").cogroup(candidates)

    def sides(left: pa.Table, right: pa.Table):
        anchors, own = Side.of(left), Side.of(right)
        dim = anchors.vectors.shape[1]
        return anchors, left.column("cluster").to_numpy(), shared.value.get(dim, np.zeros((1, dim))), own

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        best = best_positives(*sides(left, right), positives)
        return pa.table({"row": left.column("row").to_numpy()[best.slot], "id": best.id, "score": best.score})

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        lists = left.column("scores").combine_chunks()
        counts = lists.value_lengths().to_numpy(zero_copy_only=False)
        known = np.arange(positives) < counts[:, None]
        scores = np.zeros(known.shape, np.int64)
        scores[known] = lists.flatten().to_numpy()
        best = best_negatives(*sides(left, right), scores, known, negatives)
        return pa.table(
            {
                "row": left.column("row").to_numpy()[best.slot // positives], "place": (best.slot % positives).astype(np.int32),
                "id": best.id, "score": best.score,
            }
        )

    def ranked(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", place).where(F.col("rank") <= keep)

    near = ranked(meet(anchors).applyInArrow(find_positives, "row long, id long, score long"), ["row"], positives)
    listed = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    named = materialize(anchors.join(listed, "row").withColumn("scores", F.col("near.score")), "positives")
    kept = ranked(meet(named.drop("near")).applyInArrow(find_negatives, "row long, place int, id long, score long"), ["row", "place"], negatives)
    owners = named.select("row", F.col("id").alias("anchor_id"), F.posexplode("near").alias("place", "positive"))
    return owners.join(kept, ["row", "place"]).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
