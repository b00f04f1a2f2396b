"""SimHash near duplicates with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.buckets import PART_ROWS, group_of, meet, near_pairs, whole_groups
from corpusloom.llm.components import connected_components
from corpusloom.session import materialize

BITS = 64
PIVOTS = 16
# Up to this size the pairs of all groups of a batch are tested side by side.
SMALL_GROUP = 48


def simhash(text: bytes, shingle: int, seed: int) -> int:
    """Fingerprint of one text: a bit is 1 if over half of the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.array([digest(joined[s:e], seed) for s, e in spans], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(id, fp)``: the signed 64-bit SimHash of every whole text; null and empty texts give 0.

    A-Z are lower-cased, other letters stay. Bytes split at ASCII white space only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            # One text at a time as bytes: memory holds the batch and one text's hashes.
            values = np.fromiter(
                (simhash(t.as_py() or b"", shingle, seed) for t in texts), dtype=np.uint64, count=len(texts)
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def pivot_table(values: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to ``count`` fixed reference fingerprints."""
    references = np.random.default_rng(64).integers(0, 2**64, size=count, dtype=np.uint64)
    return np.bitwise_count(values[:, None] ^ references[None, :]).astype(np.int8)


def block_masks(distance: int) -> list[int]:
    """Masks over pairs of bit blocks; fingerprints within ``distance`` bits agree on one of them.

    There are ``distance + 2`` blocks, so at least two are untouched.
    """
    edges = [BITS * i // (distance + 2) for i in range(distance + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def link_edges(values: DataFrame, distance: int = 4, limit: int = PART_ROWS) -> DataFrame:
    """``(a, b)``: edges that join exactly the fingerprints linked at ``distance`` bits or fewer.

    ``values`` is a written table with one row ``fp`` per different fingerprint.
    Pivot coordinates alone cannot place pairs together, as fingerprints lie at
    32 +- 8 bits from any reference; so pairs meet in buckets of equal bit
    blocks. There the pivot tables discard pairs whose largest coordinate
    difference exceeds ``distance``, and survivors are verified bit by bit. In a
    large group each row found is not tested again, so a group gives at most one
    edge per row and not all its pairs.
    """
    tables = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(block_masks(distance))]
    rows = values.select("fp", F.explode(F.array(*tables)).alias("s")).select("s.t", "s.k", "fp")
    placed = meet(rows, ["t", "k"], F.col("fp"), limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["t", "k", "lo", "hi"]):
            fp = table.column("fp").to_numpy().view(np.uint64)
            part, cross = table.column("part").to_numpy(), table.column("lo").to_numpy() != table.column("hi").to_numpy()
            a, b = group_links(fp, part, cross, bounds, distance)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def group_links(fp: np.ndarray, part: np.ndarray, cross: np.ndarray, bounds: np.ndarray, distance: int):
    """Positions of linked rows: all pairs of small groups, a spanning forest of large ones."""
    pivots = pivot_table(fp)

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        keep = np.abs(pivots[i] - pivots[j]).max(axis=1) <= distance
        keep &= ~(cross[i] & (part[i] == part[j]))
        keep[keep] = np.bitwise_count(fp[i[keep]] ^ fp[j[keep]]) <= distance
        return keep

    a, b = near_pairs(bounds, linked, SMALL_GROUP)
    left, right = [a], [b]
    for g in np.flatnonzero(np.diff(bounds) > SMALL_GROUP):
        rest = np.arange(bounds[g], bounds[g + 1])
        queue: list[int] = []
        while len(rest):
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
            at = queue.pop()
            hit = linked(np.full(len(rest), at), rest)
            found, rest = rest[hit], rest[~hit]
            queue.extend(found.tolist())
            left.append(np.full(len(found), at))
            right.append(found)
    return np.concatenate(left), np.concatenate(right)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    seed: int = 42,
    distance: int = 4,
    limit: int = PART_ROWS,
) -> DataFrame:
    """``(<id_col>, fingerprint, component_id)``, one row per input row.

    Documents link at ``distance`` or fewer differing bits, and a component is
    named by its smallest id. Copies share a fingerprint and are one node, so a
    group of copies adds no pairs. Null texts count as empty; texts without a
    word have fingerprint zero and link like any other. A null id stays null and
    never names a component that has another id; repeated rows give repeated
    rows; other columns are not read; an empty table gives an empty result.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = materialize(marks.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    joined = connected_components(link_edges(nodes.select("fp"), distance, limit))
    rooted = nodes.join(joined, nodes["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # One row per fingerprint; written, as the wide join below should see its size.
    labels = materialize(rooted.join(names, "root").select("fp", "component_id"), "labels")
    return marks.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
