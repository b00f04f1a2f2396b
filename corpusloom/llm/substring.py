"""Removal of repeated word sequences, found by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrow import Texts, pieces
from corpusloom.llm.words import (
    WINDOW_BASES,
    Words,
    find_words,
    whole_windows,
    window_hashes,
    window_rows,
    word_hashes,
)

WINDOW = 20
# Bits of the broadcast filters: 32 MB each, whatever the input.
FILTER_BITS = 28
# Fixed value: bits of one row of bitmap_construct_agg.
BITMAP_BITS = 32768


class Piece:
    """Words, word hashes and block windows of a run of rows."""

    def __init__(self, texts: Texts, window: int):
        self.texts, self.window = texts, window
        # Any window of the full size holds a whole block that starts at a multiple of this.
        self.block = (window + 1) // 2
        self.words: Words = find_words(texts)
        self.hashes = word_hashes(texts, self.words)
        self.at, self.inside = whole_windows(self.words, self.block)
        self.anchors = window_hashes(self.hashes, self.block, WINDOW_BASES[0])[self.at]
        # Rows too short for a full window hold no repeat.
        self.useful = (self.words.counts >= window)[window_rows(self.words, self.block)]
        self.aligned = self.useful & (self.inside % self.block == 0)

    def candidates(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Full windows around the ``live`` block windows: first word, and position in the row.

        A window is told by the first aligned block of its earliest occurrence,
        which begins at one of its first ``block`` words.
        """
        hit = np.zeros(len(self.words.starts) + 1, np.int64)
        hit[self.at[live] + 1] = 1
        seen = np.cumsum(hit)
        at, inside = whole_windows(self.words, self.window)
        keep = seen[at + self.block] > seen[at]
        return at[keep], inside[keep]


def _filter(marks: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bloom filter of a column of hashes: ``2^bits`` bits, two for each hash, combined on the map side."""
    mask = (1 << bits) - 1
    places = [F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(mask)) for shift in _shifts(bits)]
    rows = (
        marks.select(F.explode(F.array(*[F.greatest(p, F.lit(1)) for p in places])).alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = BITMAP_BITS // 8
    for row in rows.toLocalIterator():  # at most 2^bits / 32768 rows of 4 kB
        start = (row["bucket"] - 1) * size
        out[start : start + size] = np.frombuffer(row["map"], np.uint8)
    return out


def _shifts(bits: int) -> tuple[int, int]:
    """The two parts of a hash that choose its bits."""
    return 64 - bits, 0


def _in_filter(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes whose bits are both set; bitmap numbering starts at 1, so places 0 and 1 share a bit."""
    found = np.ones(len(hashes), bool)
    for shift in _shifts(bits):
        rest = np.flatnonzero(found)
        at = np.maximum(((hashes[rest] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64), 1) - 1
        found[rest] = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def _scan(docs: DataFrame, schema: str | T.StructType, rows) -> DataFrame:
    """``rows(texts, their rows)`` over all pieces of ``(id, text, ..)`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column("text")):
                yield rows(texts, batch.slice(texts.first, len(texts)))

    return docs.mapInArrow(run, schema)


def _longs(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays]


def reference_blocks(docs: DataFrame, window: int) -> DataFrame:
    """``(anchor)``: hashes of the non-overlapping blocks of all rows."""

    def rows(texts: Texts, _rows: pa.RecordBatch) -> pa.RecordBatch:
        piece = Piece(texts, window)
        return pa.RecordBatch.from_arrays(_longs(np.unique(piece.anchors[piece.aligned])), names=["anchor"])

    return _scan(docs, "anchor long", rows)


def probe_hits(docs: DataFrame, window: int, blocks: Broadcast, bits: int) -> DataFrame:
    """``(anchor, n, aligned)``: rolling windows that may equal a block, and the blocks themselves."""

    def rows(texts: Texts, _rows: pa.RecordBatch) -> pa.RecordBatch:
        piece = Piece(texts, window)
        # Aligned windows are in the filter by construction.
        keep = piece.useful & _in_filter(blocks.value, piece.anchors, bits)
        anchors, first, n = np.unique(piece.anchors[keep], return_index=True, return_counts=True)
        aligned = np.zeros(len(anchors), bool)
        aligned[np.searchsorted(anchors, piece.anchors[piece.aligned])] = True
        return pa.RecordBatch.from_arrays(
            [*_longs(anchors, n.astype(np.int64)), pa.array(aligned)], names=["anchor", "n", "aligned"]
        )

    return _scan(docs, "anchor long, n long, aligned boolean", rows)


# Room for a position below an id in one decimal, and a place before all ids.
POSITIONS = 1 << 31
BEFORE_ALL = Decimal(-(1 << 64))


def _earliest(id_type: T.DataType) -> tuple[Column, Column, Column]:
    """How (id, pos) is aggregated to its minimum, and read back as id and position.

    Whole-number ids and positions make one decimal, which is smaller to shuffle
    than a struct and is aggregated by hashing; other ids stay in a struct. A
    null id comes before all others.
    """
    at = F.col("at")
    if not isinstance(id_type, T.IntegralType):
        return F.min(F.struct("id", "pos")), F.col("at.id"), F.col("at.pos")
    whole = F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(BEFORE_ALL).cast("decimal(20,0)"))
    size = F.lit(POSITIONS).cast("decimal(10,0)")
    pos = F.pmod(at, size)
    number = ((at - pos) / size).cast("decimal(20,0)")
    own = F.when(number != F.lit(BEFORE_ALL).cast("decimal(20,0)"), number).cast(id_type)
    return F.min((whole * size + F.col("pos")).cast("decimal(32,0)")), own, pos.cast("int")


def first_windows(docs: DataFrame, window: int, live: Broadcast, bits: int) -> DataFrame:
    """``(id, firsts)``: where the windows around live anchors start for the first time.

    Windows are told apart by 96 bits of hash over two independent values of each word, and the smallest (id, position)
    of each is an aggregate that combines on the map side.
    """
    schema = T.StructType(
        [
            T.StructField("id", docs.schema["id"].dataType),
            T.StructField("h1", T.LongType()),
            T.StructField("h2", T.IntegerType()),
            T.StructField("pos", T.IntegerType()),
        ]
    )

    def rows(texts: Texts, given: pa.RecordBatch) -> pa.RecordBatch:
        piece = Piece(texts, window)
        at, inside = piece.candidates(piece.useful & _in_filter(live.value, piece.anchors, bits))
        row = np.searchsorted(piece.words.bounds, at, side="right") - 1
        h1 = window_hashes(piece.hashes, window, WINDOW_BASES[0])[at]
        # Of word values of its own: what makes two words equal in h1 does not do so here.
        others = word_hashes(texts, piece.words, seed=1) if len(at) else piece.hashes
        h2 = window_hashes(others, window, WINDOW_BASES[1])[at]
        half = (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return pa.RecordBatch.from_arrays(
            [given.column("id").take(pa.array(row)), *_longs(h1, half, inside.astype(np.int32))], names=["id", "h1", "h2", "pos"]
        )

    earliest, own_id, own_pos = _earliest(docs.schema["id"].dataType)
    found = _scan(docs, schema, rows).groupBy("h1", "h2").agg(earliest.alias("at"))
    # Moved as plain rows: lists made before the shuffle would be many and short.
    starts = found.select(own_id.alias("id"), own_pos.alias("pos")).repartition("id")
    return starts.groupBy("id").agg(F.collect_list("pos").alias("firsts"))


def kept_words(docs: DataFrame, firsts: DataFrame, window: int, live: Broadcast, bits: int, as_written: bool) -> DataFrame:
    """``(id, .., n_words, n_removed, kept)`` after the words of later windows are cut out.

    Every candidate window that is not the first of its kind is removed. Only
    texts with a candidate window meet the starts of their first windows in a
    join; the others are finished where they are read. Columns of ``docs``
    besides ``id`` and ``text`` go along.
    """
    along = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType(
        [
            *along,
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    names = [f.name for f in along]

    def touched(piece: Piece) -> np.ndarray:
        at, _ = piece.candidates(piece.useful & _in_filter(live.value, piece.anchors, bits))
        out = np.zeros(len(piece.texts), bool)
        out[np.searchsorted(piece.words.bounds, at, side="right") - 1] = True
        return out

    def finished(texts: Texts, given: pa.RecordBatch) -> pa.RecordBatch:
        piece = Piece(texts, window)
        plain = pa.array(~touched(piece))
        keep = np.ones(len(piece.words.starts), bool)
        return _result(given.select(names), piece, keep, as_written).filter(plain)

    def pending(texts: Texts, given: pa.RecordBatch) -> pa.RecordBatch:
        return given.take(pa.array(np.flatnonzero(touched(Piece(texts, window)))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("firsts")
            for texts in pieces(batch.column("text")):
                piece = Piece(texts, window)
                words = piece.words
                at, _ = piece.candidates(piece.useful & _in_filter(live.value, piece.anchors, bits))
                own = lists.slice(texts.first, len(texts))
                sizes = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                first = np.repeat(words.bounds[:-1], sizes) + own.flatten().to_numpy()
                later = at[~np.isin(at, first)]
                depth = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(depth, later, 1)
                np.add.at(depth, later + window, -1)
                given = batch.slice(texts.first, len(texts)).select(names)
                yield _result(given, piece, np.cumsum(depth)[:-1] == 0, as_written)

    waiting = _scan(docs, docs.schema, pending)
    starts = firsts.withColumnRenamed("id", "first_id")
    joined = waiting.join(starts, F.col("id").eqNullSafe(F.col("first_id")), "left").select(*docs.columns, "firsts")
    return _scan(docs, schema, finished).unionAll(joined.mapInArrow(cut, schema))


def _result(given: pa.RecordBatch, piece: Piece, keep: np.ndarray, as_written: bool) -> pa.RecordBatch:
    words = piece.words
    gone = np.concatenate([[0], np.cumsum(~keep)])
    removed = gone[words.bounds[1:]] - gone[words.bounds[:-1]]
    kept = _joined(piece.texts, words, keep)
    if as_written:
        data, bounds = piece.texts.data.tobytes(), piece.texts.bounds
        kept = [k if n else data[a:b].decode() for k, n, a, b in zip(kept, removed.tolist(), bounds[:-1], bounds[1:])]
    return pa.RecordBatch.from_arrays(
        [*given.columns, *_longs(words.counts.astype(np.int64), removed.astype(np.int64)), pa.array(kept, pa.string())],
        names=[*given.schema.names, "n_words", "n_removed", "kept"],
    )


def _joined(texts: Texts, words: Words, keep: np.ndarray) -> list[str]:
    """The kept words of each row, joined by one space."""
    out = []
    data, starts, ends, bounds = texts.data.tobytes(), words.starts.tolist(), words.ends.tolist(), words.bounds.tolist()
    row_keep = keep.tolist()
    for a, b in zip(bounds[:-1], bounds[1:]):
        out.append(b" ".join([data[starts[i] : ends[i]] for i in range(a, b) if row_keep[i]]).decode())
    return out


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    filter_bits: int = FILTER_BITS,
    carry: Sequence[str] = (),
    as_written: bool = False,
) -> DataFrame:
    """``(<id_col>, <carry>, n_words, n_removed, kept)``: each text without the windows that occur earlier.

    A window is ``window`` consecutive words of one row; all words of a window
    whose word sequence also starts earlier (smaller id, or the same row further
    left) are removed, judged on the input.

    1. Non-overlapping blocks of ``(window + 1) // 2`` words index every row.
       Every window holds one of its own row's blocks whole.
    2. Every rolling window of that size probes the index. A Bloom filter of fixed
       size lets through what may hit; equal 64-bit hashes then decide, and an
       anchor is live if its block stands in at least two places.
    3. Live anchors are extended to the full windows around them, and the first
       start of each window is found by its 96-bit hash. Neighbouring windows
       make up the maximal exact repeats.

    The filters never lose a hit: where they fill up on larger inputs, more
    windows are aggregated than needed and the result is the same.

    Null and empty texts have no words and give an empty text. A null id is
    smaller than any other. Rows with equal ids count as one row for "earlier":
    repeated rows are not repeats of each other. ``kept`` holds the words joined
    by one space; with ``as_written`` a text that nothing is removed from stays
    as it is, null as empty. Columns other than ``carry`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    blocks = context.broadcast(_filter(reference_blocks(rows, window), "anchor", filter_bits))
    hits = probe_hits(rows, window, blocks, filter_bits)
    repeated = (
        hits.groupBy("anchor")
        .agg(F.sum("n").alias("n"), F.max("aligned").alias("aligned"))
        .where("n > 1 AND aligned")
    )
    live = context.broadcast(_filter(repeated, "anchor", filter_bits))
    firsts = first_windows(rows, window, live, filter_bits)
    along = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{c}") for c in carry))
    kept = kept_words(along, firsts, window, live, filter_bits, as_written)
    return kept.select(F.col("id").alias(id_col), *(F.col(f"_{c}").alias(c) for c in carry), "n_words", "n_removed", "kept")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
