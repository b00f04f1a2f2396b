"""Dictionary lookup, term weights, normalisation and document vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.arrays import let
from corpusloom.functions.scoring import term_weight
from corpusloom.operators.term_filter import block_count, build_filter, maybe_among
from corpusloom.session import materialize
from corpusloom.settings import MAX_BROADCAST_BYTES

# The smallest positive double, where the training maximum starts.
SMALLEST_DOUBLE = 4.9e-324


# What a broadcast row holds besides its term.
ROW_BYTES = 32


# Fixed value: entries of documents that a task weighs, sorts and scales at once.
PACKED_ENTRIES = 1 << 16
# Entries of documents, and documents, that ask a shuffled dictionary for their terms together.
BUNDLED_ENTRIES = 1 << 19
# Fixed value: a bundle's number has the task that made it above this bit.
BUNDLE_BITS = 33


@dataclass(frozen=True)
class Lookup:
    """A dictionary whose size was measured, for callers that look up many batches."""

    entries: DataFrame
    size: int
    count: int

    @classmethod
    def of(cls, dictionary: "DataFrame | Lookup") -> "Lookup":
        if isinstance(dictionary, cls):
            return dictionary
        entries = dictionary.select("term", "id", "score")
        size = F.coalesce(F.sum(F.octet_length("term") + ROW_BYTES), F.lit(0))
        return cls(entries, *entries.agg(size, F.count(F.lit(1))).first())

    @cached_property
    def shared(self) -> Broadcast:
        """``(terms, first, uses, ids, scores)`` for Python tasks, made once; only where ``size`` allows a broadcast.

        ``terms`` differ; the entries of term k are the ``uses[k]`` ones from ``first[k]`` on.
        """
        known = self.entries.where("term IS NOT NULL AND id IS NOT NULL")
        table = known.select("term", "id", F.col("score").cast("double").alias("score")).toArrow().combine_chunks()
        terms = table["term"]
        coded = (terms.chunk(0) if terms.num_chunks else pa.array([], terms.type)).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        value = (coded.dictionary, *_by_code(codes, len(coded.dictionary), table))
        return self.entries.sparkSession.sparkContext.broadcast(value)


def _by_code(codes: np.ndarray, count: int, entries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first, uses, ids, scores)`` of dictionary entries whose terms have ``codes`` below ``count``."""
    entries = entries.take(pa.array(np.argsort(codes, kind="stable")))
    uses = np.bincount(codes, minlength=count)
    # A null score is a null weight, and no number.
    scores = np.ma.masked_array(entries["score"].to_numpy(), entries["score"].is_null().to_numpy())
    return np.cumsum(uses) - uses, uses, entries["id"].to_numpy(), scores


def lookup_terms(
    terms: DataFrame, dictionary: DataFrame | Lookup, max_broadcast_bytes: int, keep: Column | None = None
) -> DataFrame:
    """Add ``id`` and ``score``; terms outside the dictionary keep nulls there.

    The dictionary is broadcast only if its measured size allows it; beyond
    that both sides are shuffled on the term, frequent terms spread by salt.
    ``keep`` tells which rows the caller needs even if their term is unknown,
    all by default; others may be left out before the shuffle.
    """
    known = Lookup.of(dictionary)
    if known.size <= max_broadcast_bytes:
        return terms.join(F.broadcast(known.entries), "term", "left")
    blocks = 0 if keep is None else block_count(known.count, max_broadcast_bytes)
    if blocks:
        terms = maybe_among(terms, build_filter(known.entries, blocks), blocks, keep)
    return _salted_lookup(materialize(terms, "looked-up"), known.entries, max_broadcast_bytes)


def _salted_lookup(terms: DataFrame, entries: DataFrame, max_broadcast_bytes: int) -> DataFrame:
    """Shuffled lookup in which no term fills a task, known or not.

    ``terms`` is read twice, to count and to join, and should be a written table.
    A term in more than ``hot`` documents gets several salts: its dictionary
    row is repeated for each and every document picks one. ``hot`` is chosen
    from the summed size of all rows, so that the hot terms together stay
    within ``max_broadcast_bytes``. The counts are of these rows and not the
    dictionary's, as unknown terms that pass the filter may be frequent too,
    and pages need not be like the corpus.
    """
    uses = materialize(terms.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "uses")
    size = uses.agg(F.sum(F.col("n") * (F.octet_length("term") + ROW_BYTES))).first()[0] or 0
    hot = max(1, math.ceil(size / max(1, max_broadcast_bytes)))
    salts = F.broadcast(
        uses.where(F.col("n") > hot).select("term", (F.floor(F.col("n") / hot) + 1).cast("int").alias("_salts"))
    )
    many = F.coalesce("_salts", F.lit(1))
    repeated = entries.join(salts, "term", "left").select(
        "term", "id", "score", F.explode(F.sequence(F.lit(0), many - 1)).alias("_salt")
    )
    # Documents without a term match nothing and may go anywhere.
    pick = F.when(F.col("term").isNull(), F.hash("doc_id")).otherwise(F.pmod(F.hash("doc_id"), many))
    salted = terms.join(salts, "term", "left").withColumn("_salt", pick)
    return salted.join(repeated.hint("merge"), ["term", "_salt"], "left").drop("_salts", "_salt")


def weigh_terms(terms: DataFrame, dictionary: DataFrame, max_broadcast_bytes: int) -> DataFrame:
    """``(doc_id, label, term, id, tf, w)`` for the terms of the dictionary."""
    found = lookup_terms(terms, dictionary, max_broadcast_bytes, F.lit(False)).where("id IS NOT NULL")
    return found.select(
        "doc_id", "label", "term", "id", "tf", term_weight(F.col("tf"), F.col("score")).alias("w")
    )


def scale_minmax(features: Column) -> Column:
    """Training scale: (w - min) / (max - min), raw where all weights are equal.

    The smallest weight becomes 0.0 and stays in the vector.
    """
    high = F.greatest(F.array_max(F.transform(features, lambda f: f["w"])), F.lit(SMALLEST_DOUBLE))
    low = F.array_min(F.transform(features, lambda f: f["w"]))
    return _rescale(features, low, high)


def scale_by_max(features: Column) -> Column:
    """Serving scale: both extremes start at 0, so positive weights become w / max."""
    high = F.greatest(F.array_max(F.transform(features, lambda f: f["w"])), F.lit(0.0))
    low = F.least(F.array_min(F.transform(features, lambda f: f["w"])), F.lit(0.0))
    return _rescale(features, low, high)


def _rescale(features: Column, low: Column, high: Column) -> Column:
    def scaled(ends: Column) -> Column:
        span = ends["high"] - ends["low"]
        return F.when(span == 0, features).otherwise(
            F.transform(features, lambda f: F.struct(f["id"].alias("id"), ((f["w"] - ends["low"]) / span).alias("w")))
        )

    return let(F.struct(low.alias("low"), high.alias("high")), scaled)


SCALES = {"minmax": scale_minmax, "max": scale_by_max, "none": lambda features: features}


def document_vectors(
    bags: DataFrame,
    dictionary: DataFrame,
    scale: str = "minmax",
    keep_empty: bool = False,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    row_key: str | None = None,
) -> DataFrame:
    """``(<keys>, features)``: sparse vectors in id order.

    All columns of ``bags`` but the bag are keys, or ``row_key`` alone is one
    and the others go along with it; its values must differ. Documents without any known
    term are dropped for training and kept with an empty vector for serving.
    A document stays one row on its way to the dictionary, and only repeated keys are grouped
    after that. A dictionary too large to broadcast is asked for the terms of many documents at once.
    """
    keys = [c for c in bags.columns if c != "bag"]
    known = Lookup.of(dictionary)
    if known.size <= max_broadcast_bytes:
        packed = _packed_in_place
    else:
        packed = partial(_packed_in_bundles, max_broadcast_bytes=max_broadcast_bytes)
    # A scan of the keys alone.
    if row_key is not None or not bags.select(*keys).groupBy(*keys).count().where("count > 1").limit(1).count():
        return packed(bags, known, keys, keep_empty, scale)
    raw = packed(bags, known, keys, keep_empty, "none")
    raw = raw.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("features"))).alias("features"))
    return raw.withColumn("features", SCALES[scale](F.col("features")))


def _scaled(w: np.ndarray, absent: np.ndarray | None, starts: np.ndarray, sizes: np.ndarray, scale: str) -> np.ndarray:
    """:data:`SCALES` for documents of one entry or more, which stand one after the other in ``w``; ``absent`` ones do not count."""
    if scale == "none" or not len(w):
        return w
    floor = SMALLEST_DOUBLE if scale == "minmax" else 0.0
    for_high, for_low = (w, w) if absent is None else (np.where(absent, -np.inf, w), np.where(absent, np.inf, w))
    high, low = np.maximum(np.maximum.reduceat(for_high, starts), floor), np.minimum.reduceat(for_low, starts)
    if scale == "max":
        low = np.minimum(low, 0.0)
    span = high - low
    with np.errstate(divide="ignore", invalid="ignore"):
        moved = (w - np.repeat(low, sizes)) / np.repeat(span, sizes)
    return np.where(np.repeat(span == 0, sizes), w, moved)


def _entry_rows(bags: DataFrame, keys: list[str]) -> DataFrame:
    return bags.select(*keys, F.col("bag.term").alias("_terms"), F.col("bag.tf").alias("_tf"))


def _vector_schema(bags: DataFrame, known: Lookup, keys: list[str]) -> T.StructType:
    pair = T.StructType([T.StructField("id", known.entries.schema["id"].dataType), T.StructField("w", T.DoubleType())])
    return T.StructType([*(bags.schema[k] for k in keys), T.StructField("features", T.ArrayType(pair))])


def _numbers(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _pack(
    rows: pa.RecordBatch, keys: list[str], sizes: np.ndarray, at: np.ndarray, tf: np.ndarray,
    entries: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], keep_empty: bool, scale: str,
) -> pa.RecordBatch:
    """``(<keys>, features)``; ``at`` is the code of each entry's term in ``entries``, see :func:`_by_code`, or -1."""
    first, uses, ids, scores = entries
    hit = np.flatnonzero(at >= 0)
    own, code = np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]
    many = uses[code]
    # A term that the dictionary has more than once counts as often.
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    place = np.repeat(first[code], many) + step
    own, number = np.repeat(own, many), ids[place]
    absent = scores.mask[place] if scores.mask.any() else None
    w = np.sqrt(np.repeat(tf[hit], many)).astype(np.float32).astype(np.float64) * scores.data[place]
    # Terms of a bag are in order, and so are ids that were given in term order.
    if not ((np.diff(own) > 0) | (np.diff(number) > 0)).all():
        order = np.lexsort((w, number, own))
        number, w, absent = number[order], w[order], None if absent is None else absent[order]
    found = np.bincount(own, minlength=len(sizes))
    ends = np.concatenate([[0], np.cumsum(found)])
    some = found > 0
    w = _scaled(w, absent, ends[:-1][some], found[some], scale)
    pairs = pa.StructArray.from_arrays([pa.array(number), pa.array(w, mask=absent)], names=["id", "w"])
    columns = [*(rows.column(k) for k in keys), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
    out = pa.RecordBatch.from_arrays(columns, names=[*keys, "features"])
    return out if keep_empty else out.filter(pa.array(some))


def _packed(
    rows: pa.RecordBatch, keys: list[str], sizes: np.ndarray, at: np.ndarray, tf: np.ndarray,
    entries: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], keep_empty: bool, scale: str,
) -> Iterator[pa.RecordBatch]:
    """:func:`_pack` of some documents at a time, at least one whole document."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PACKED_ENTRIES, side="right")))
        here = slice(base, ends[stop - 1])
        yield _pack(rows.slice(start, stop - start), keys, sizes[start:stop], at[here], tf[here], entries, keep_empty, scale)
        start = stop


def _packed_in_place(bags: DataFrame, known: Lookup, keys: list[str], keep_empty: bool, scale: str) -> DataFrame:
    """``(<keys>, features)``, one row for each row of ``bags``, by a broadcast lookup without a shuffle.

    A document stays one row: a row for each of its terms would cost more on
    its way to Python than the lookup itself.
    """
    shared = known.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, *entries = shared.value
        for batch in batches:
            listed, tf = batch.column("_terms"), _numbers(batch.column("_tf"))
            at = pc.fill_null(pc.index_in(listed.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
            yield from _packed(batch, keys, _sizes(listed), at, tf, tuple(entries), keep_empty, scale)

    return _entry_rows(bags, keys).mapInArrow(run, _vector_schema(bags, known, keys))


def _bundles(bags: DataFrame, keys: list[str]) -> DataFrame:
    """``(<keys>, _tf, _bundle, _codes, _asked)``: bags whose terms are numbered within bundles of neighbouring documents.

    The first row of a bundle has its different terms in ``_asked``, in the
    order of their codes. A bundle has ``BUNDLED_ENTRIES`` entries and
    documents, or one document more.
    """
    rows = _entry_rows(bags, keys)
    made = T.StructType.fromDDL("_bundle bigint, _codes array<int>, _asked array<string>")
    schema = T.StructType([*(rows.schema[k] for k in (*keys, "_tf")), *made.fields])

    def bundle(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        listed = rows.column("_terms")
        coded = listed.flatten().dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(_sizes(listed))])
        codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.fill_null(coded.indices, -1))
        asked = np.full(len(rows) + 1, len(coded.dictionary))
        asked[0] = 0
        columns = [
            *(rows.column(k) for k in keys), rows.column("_tf"), pa.array(np.full(len(rows), number)),
            codes, pa.ListArray.from_arrays(pa.array(asked, pa.int32()), coded.dictionary),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << BUNDLE_BITS
        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(_sizes(batch.column("_terms")) + 1)
            start = 0
            while start < len(ends):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + BUNDLED_ENTRIES - size, side="right")))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - base)
                start = stop
                if size >= BUNDLED_ENTRIES:
                    yield bundle(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield bundle(held, number)

    return rows.mapInArrow(run, schema)


def _packed_in_bundles(
    bags: DataFrame, known: Lookup, keys: list[str], keep_empty: bool, scale: str, max_broadcast_bytes: int
) -> DataFrame:
    """``(<keys>, features)``, one row for each row of ``bags``, by a shuffled lookup.

    A bundle of documents asks once for each of its terms, so that what meets
    the dictionary are its different terms and not its entries, and a term in
    every document brings one row per bundle to the task that has it. Bundles
    meet their answers as a whole; both are bounded.
    """
    rows = materialize(_bundles(bags, keys), "bundles")
    asked = rows.where(F.size("_asked") > 0).select("_bundle", F.posexplode("_asked").alias("_code", "term"))
    blocks = block_count(known.count, max_broadcast_bytes)
    if blocks:
        asked = maybe_among(asked, build_filter(known.entries, blocks), blocks, F.lit(False))
    entries = known.entries.where("id IS NOT NULL").select("term", "id", F.col("score").cast("double").alias("score"))
    answers = materialize(asked, "looked-up").join(entries.hint("merge"), "term").select("_bundle", "_code", "id", "score")

    def pack(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().to_batches()[0]
        listed, tf = rows.column("_codes"), _numbers(rows.column("_tf"))
        at = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        entries = _by_code(answers["_code"].to_numpy(), int(at.max(initial=-1)) + 1, answers)
        return pa.Table.from_batches(_packed(rows, keys, _sizes(listed), at, tf, entries, keep_empty, scale))

    rows = rows.select(*keys, "_tf", "_bundle", "_codes")
    return rows.groupBy("_bundle").cogroup(answers.groupBy("_bundle")).applyInArrow(pack, _vector_schema(bags, known, keys))


def vector_entries(vectors: DataFrame) -> DataFrame:
    """Long form of vectors: one row per feature."""
    keys = [c for c in vectors.columns if c != "features"]
    return vectors.select(*keys, F.inline_outer("features")).where("id IS NOT NULL")
