"""Benchmark passages in documents by the q-gram lemma, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrow import Texts, pieces

# Characters of a passage unit, edits allowed in it, and the q-gram length: any
# unit of an item within EDITS edits shares at least UNIT + 1 - Q * (EDITS + 1) q-grams.
UNIT = 80
EDITS = 4
Q = 12
# Benchmark characters held by a task at once; larger benchmarks go in several passes.
BLOCK_CHARS = 4_000_000
# Text bytes screened at once: their arrays stay in the processor's cache.
SCREEN_BYTES = 1 << 17
# Alignments carried out side by side.
VERIFY_ROWS = 256
# Shorter items say too little to tell a leak from chance if they are changed: they are found as they are, at word bounds.
LEAST_CHARS = 40
# Pairs of a text place and an item place that are listed at once.
PAIRS = 1 << 20
# Entries of an item that a hit meets on average where both repeat themselves.
REPEATING = 4
# Longest exact stretch that is compared at once.
COPY_CHARS = 4_096
TABLE_BITS = 22
# Fixed value: multiplier of a multiplicative hash.
SPREAD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    table[65:91] += 32
    # All white space is in the basic plane.
    table[[c for c in range(0x10000) if chr(c).isspace()]] = 32
    return table


def fold(points: np.ndarray) -> np.ndarray:
    """ASCII capitals become small letters, white space becomes a blank."""
    return _folding()[points]


def code_points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def gram_keys(points: np.ndarray, q: int) -> np.ndarray:
    """64-bit keys of all q-grams; equal grams have equal keys.

    Grams of 1, 2, 4, .. characters are joined to the length asked for.
    """
    count = max(0, len(points) - q + 1)
    part, size = points.astype(np.uint64), 1
    keys, done = np.zeros(count, np.uint64), 0
    while count and done < q:
        if (q - done) & size:
            keys *= np.uint64(pow(SPREAD, size, 1 << 64))
            keys += part[done : done + count]
            done += size
        if done < q:
            part = part[:-size] * np.uint64(pow(SPREAD, size, 1 << 64)) + part[size:]
            size *= 2
    return keys ^ (keys >> np.uint64(32))


@dataclass(frozen=True)
class Unit:
    """One benchmark item, any ``size`` characters of which are searched for with ``edits`` edits."""

    item: int
    size: int
    points: np.ndarray
    edits: int
    # Only between other characters than letters and digits.
    whole_words: bool = False


@dataclass(frozen=True)
class Index:
    """Sorted q-grams of all items: key, item and place in the item."""

    units: tuple[Unit, ...]
    keys: np.ndarray
    unit: np.ndarray
    place: np.ndarray
    table: np.ndarray
    q: int
    bound: int
    span: int

    @classmethod
    def of(cls, items: list[tuple[int, str]], unit: int, edits: int, q: int) -> "Index":
        units = [u for number, text in items for u in search_units(number, text, unit, edits, q)]
        keys = [gram_keys(u.points, q) for u in units]
        owner = np.repeat(np.arange(len(units)), [len(k) for k in keys]) if units else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(k)) for k in keys]) if units else np.empty(0, np.int64)
        flat = np.concatenate(keys) if units else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        table = np.zeros(1 << TABLE_BITS, bool)
        table[_slot(flat)] = True
        bounds = [lemma_bound(u.size, u.edits, q) for u in units]
        return cls(
            tuple(units), flat[order], owner[order], place[order], table, q,
            min(bounds, default=1), max((u.size + u.edits for u in units), default=1),
        )


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(SPREAD)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def lemma_bound(length: int, edits: int, q: int) -> int:
    """Fewest q-grams that a stretch of ``length`` keeps after ``edits`` edits."""
    return length + 1 - q * (edits + 1)


def search_units(item: int, text: str, unit: int, edits: int, q: int) -> Iterator[Unit]:
    """The item, to be searched for by all its stretches of ``unit`` characters, or as a whole if it is shorter.

    A shorter item gets the share of the edits that keeps the lemma useful, one
    below ``LEAST_CHARS`` none, and one below a q-gram is left out.
    """
    points = fold(code_points(" ".join(text.split()).encode()))
    if len(points) > unit:
        yield Unit(item, unit, points, edits)
    elif q <= len(points) < LEAST_CHARS:
        yield Unit(item, len(points), points, 0, whole_words=True)
    elif len(points) >= q:
        own = min(edits * len(points) // unit, max(0, (len(points) + 1) // q - 2))
        yield Unit(item, len(points), points, own)


def squeeze(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded text with runs of blanks as one, and where each character stood."""
    folded = fold(points)
    blank = folded == 32
    double = np.flatnonzero(blank[1:] & blank[:-1]) + 1
    if not len(double):
        return folded, np.arange(len(folded))
    keep = np.ones(len(folded), bool)
    keep[double] = False
    return folded[keep], np.flatnonzero(keep)


def gram_hits(points: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text that hold a gram of the index, and where the gram's entries begin and end."""
    keys = gram_keys(points, index.q)
    if not len(keys) or not len(index.keys):
        return (np.empty(0, np.int64),) * 3
    at = np.flatnonzero(index.table[_slot(keys)])
    # A match leaves at least `bound` hits within `span` characters, whatever the unit.
    at = _dense(at, index.bound, index.span)
    low = np.searchsorted(index.keys, keys[at], side="left")
    high = np.searchsorted(index.keys, keys[at], side="right")
    real = high > low
    return at[real], low[real], high[real]


def _entries(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All entries of all hits, one behind the other."""
    return np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


def long_copies(points: np.ndarray, index: Index, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[int, np.ndarray]:
    """By unit, disjoint rows ``(start, end)`` of text that is copied from it without an edit.

    Only for units that repeat themselves and meet a text that does, where each
    place of the text meets many of the unit. Some copies, not all: what lies
    deep inside them needs no search, and all else is searched.
    """
    first, key, times = np.unique(low, return_inverse=True, return_counts=True)
    ends = np.zeros(len(first), np.int64)
    ends[key] = high
    count = ends - first
    entry, own_key = _entries(first, count), np.repeat(np.arange(len(first)), count)
    unit = index.unit[entry]
    pairs = np.bincount(unit, weights=times[own_key], minlength=len(index.units))
    found = {}
    for number in np.flatnonzero(pairs > REPEATING * len(at)).tolist():
        mine = np.flatnonzero(unit == number)[::-1]
        lowest = np.full(len(first), -1, np.int64)
        # Entries of a key stand by place, so the last one written is the first place.
        lowest[own_key[mine]] = index.place[entry[mine]]
        held = lowest[key] >= 0
        spans = _copies(points, index.units[number], at[held], lowest[key[held]])
        if spans:
            found[number] = np.array(spans)
    return found


def _copies(points: np.ndarray, unit: Unit, spots: np.ndarray, places: np.ndarray) -> list[list[int]]:
    spans: list[list[int]] = []
    k = 0
    while k < len(spots):
        spot, place = int(spots[k]), int(places[k])
        size = min(len(points) - spot, len(unit.points) - place, max(COPY_CHARS, unit.size))
        unequal = np.flatnonzero(points[spot : spot + size] != unit.points[place : place + size])
        length = int(unequal[0]) if len(unequal) else size
        if length < unit.size:
            k += 1
            continue
        if spans and spot <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], spot + length)
        else:
            spans.append([spot, spot + length])
        # The next copy begins where it reaches further than this one.
        k = int(np.searchsorted(spots, spot + length - unit.size + 1))
    return spans


def segments(at: np.ndarray, count: np.ndarray, overlap: int) -> Iterator[slice]:
    """Runs of hits with about ``PAIRS`` entries, each with the hits of the next ``overlap`` characters."""
    total = np.cumsum(count)
    first = 0
    while first < len(at):
        base = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
        yield slice(first, int(np.searchsorted(at, at[last - 1] + overlap, side="right")))
        first = last


def find_regions(
    size: int, index: Index, at: np.ndarray, low: np.ndarray, high: np.ndarray, copies: dict[int, np.ndarray]
) -> np.ndarray:
    """Rows ``(unit, start in it, first diagonal of a band)`` whose stretch meets the lemma's bound.

    Hits are counted in bands of diagonals that overlap by half, so that any
    match lies whole in one of them, and in a band for every start in the item.
    Hits and regions that only lie inside ``copies`` are left out.
    """
    count = high - low
    spot, entry = np.repeat(at, count), _entries(low, count)
    unit, place = index.unit[entry], index.place[entry]
    if copies:
        reach = 2 * index.span
        far = ~_inside(copies, unit, spot - reach, spot + index.q + reach, size)
        spot, unit, place = spot[far], unit[far], place[far]
    if not len(spot):
        return np.empty((0, 3), np.int64)
    diagonal = spot - place
    edits = np.array([u.edits for u in index.units])[unit]
    width = edits + 1
    # Bands [k * width, (k + 2) * width): a match drifts over at most `edits` diagonals.
    band = diagonal // width
    bands = np.concatenate([np.stack([unit, band], 1), np.stack([unit, band - 1], 1)])
    places = np.concatenate([place, place])
    order = np.lexsort((places, bands[:, 1], bands[:, 0]))
    bands, places = bands[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], (bands[1:] != bands[:-1]).any(axis=1)]))
    last = np.append(first[1:], len(bands))
    need = np.array([lemma_bound(u.size, u.edits, index.q) for u in index.units])
    out = [np.empty((0, 3), np.int64)]
    for a, b in zip(*(x[last - first >= need[bands[first, 0]]] for x in (first, last))):
        at, unit = int(bands[a, 0]), index.units[bands[a, 0]]
        own, grams = places[a:b], unit.size + 1 - index.q
        starts = np.arange(max(0, own[0] - grams + 1), min(len(unit.points) - unit.size, own[-1]) + 1)
        starts = starts[np.searchsorted(own, starts + grams) - np.searchsorted(own, starts) >= need[at]]
        diagonal = bands[a, 1] * (unit.edits + 1)
        out.append(np.stack([np.full(len(starts), at), starts, np.full(len(starts), diagonal)], 1))
    regions = np.concatenate(out)
    if copies:
        shapes = np.array([(u.size, u.edits) for u in index.units])[regions[:, 0]]
        left = regions[:, 1] + regions[:, 2] - shapes[:, 1]
        regions = regions[~_inside(copies, regions[:, 0], left, left + shapes[:, 0] + 4 * shapes[:, 1] + 3, size)]
    return regions


def _inside(copies: dict[int, np.ndarray], unit: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Which stretches of a text of ``size`` characters lie whole in a copy of their unit."""
    inside = np.zeros(len(unit), bool)
    for number, spans in copies.items():
        mine = np.flatnonzero(unit == number)
        span = np.searchsorted(spans[:, 0], np.maximum(left[mine], 0), side="right") - 1
        inside[mine] = (span >= 0) & (np.minimum(right[mine], size) <= spans[span, 1])
    return inside


def _dense(at: np.ndarray, bound: int, span: int) -> np.ndarray:
    """Places with at least ``bound`` places in some stretch of ``span`` around them."""
    if len(at) < bound:
        return at[:0]
    tight = at[bound - 1 :] - at[: len(at) - bound + 1] <= span
    depth = np.zeros(len(at) + 1, np.int64)
    starts = np.flatnonzero(tight)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + bound, -1)
    return at[np.cumsum(depth)[:-1] > 0]


def banded_matches(patterns: np.ndarray, texts: np.ndarray, sizes: np.ndarray, edits: int) -> tuple[np.ndarray, ...]:
    """Best place of each pattern in its text: ``(start, end, edits)``, edits too large if there is none.

    Patterns are rows of one length, and a text has ``sizes`` characters and
    padding. Column d of a step stands for the text place that many characters
    on from the pattern's own, so the columns are the diagonals of the band; a
    match may start and end on any of them.
    """
    count, m = patterns.shape
    width = texts.shape[1] - m
    columns = np.arange(width)
    cost = np.zeros((count, width + 1), np.int32)
    cost[:, width] = m + width + 1
    start = np.broadcast_to(np.arange(width + 1), cost.shape).copy()
    for i in range(m):
        step = cost[:, :width] + (texts[:, i : i + width] != patterns[:, i : i + 1])
        down = cost[:, 1:] + 1
        best = np.minimum(step, down)
        begin = np.where(step <= down, start[:, :width], start[:, 1:])
        # Insertions run along the row: a prefix minimum of cost - column.
        slope = best - columns
        run = np.minimum.accumulate(slope, axis=1)
        source = np.maximum.accumulate(np.where(slope == run, columns, 0), axis=1)
        cost[:, :width] = run + columns
        start[:, :width] = np.take_along_axis(begin, source, axis=1)
    ends = columns + m
    total = np.where(ends <= sizes[:, None], cost[:, :width], m + width + 1)
    d = total.argmin(axis=1)
    rows = np.arange(count)
    return start[rows, d], ends[d], total[rows, d]


def row_matches(points: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """``(item, start, end, edits)`` of the verified units of one text, in its own characters."""
    squeezed, origin = squeeze(points)
    at, low, high = gram_hits(squeezed, index)
    copies = long_copies(squeezed, index, at, low, high) if (high - low).sum() > REPEATING * len(at) else {}
    found = [
        (index.units[number].item, int(origin[start]), int(origin[end - 1]) + 1, 0)
        for number, spans in copies.items() for start, end in spans.tolist()
    ]
    for part in segments(at, high - low, 2 * index.span):
        regions = find_regions(len(squeezed), index, at[part], low[part], high[part], copies)
        shapes: dict[tuple[int, int], list[tuple[Unit, int, int]]] = {}
        for unit_at, start, diagonal in regions.tolist():
            unit = index.units[unit_at]
            shapes.setdefault((unit.size, unit.edits), []).append((unit, start, start + diagonal - unit.edits))
        for (m, edits), group in shapes.items():
            for k in range(0, len(group), VERIFY_ROWS):
                found.extend(_verify(squeezed, origin, group[k : k + VERIFY_ROWS], m, edits))
        found = merged(found)
    return found


def _verify(squeezed: np.ndarray, origin: np.ndarray, group: list[tuple[Unit, int, int]], m: int, edits: int) -> Iterator[tuple]:
    """Matches of units of one shape from the given first characters on, which may lie before the text."""
    # The band's own diagonals and `edits` more on either side.
    reach = m + 4 * edits + 3
    texts = np.full((len(group), reach), 0xFFFFFFFF, np.uint32)
    for k, (_, _, first) in enumerate(group):
        part = squeezed[max(0, first) : max(0, first + reach)]
        texts[k, max(0, -first) : max(0, -first) + len(part)] = part
    sizes = np.minimum(len(squeezed) - np.array([first for _, _, first in group]), reach)
    patterns = np.stack([unit.points[at : at + m] for unit, at, _ in group])
    for (unit, _, first), start, end, cost in zip(group, *banded_matches(patterns, texts, sizes, edits)):
        start, end = max(0, first + int(start)), first + int(end)
        if cost <= edits and end > start and not (unit.whole_words and _inside_word(squeezed, start, end)):
            yield unit.item, int(origin[start]), int(origin[end - 1]) + 1, int(cost)


def _inside_word(points: np.ndarray, start: int, end: int) -> bool:
    """Whether a stretch begins or ends between two letters or digits."""
    joints = [p for p in (start, end) if 0 < p < len(points)]
    return any(chr(points[p - 1]).isalnum() and chr(points[p]).isalnum() for p in joints)


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping spans of an item as one, with the fewest edits of any of its units."""
    out: list[list[int]] = []
    for item, start, end, edits in sorted(spans):
        if out and out[-1][0] == item and start <= out[-1][2]:
            out[-1][2], out[-1][3] = max(out[-1][2], end), min(out[-1][3], edits)
        else:
            out.append([item, start, end, edits])
    return [tuple(x) for x in out]


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("edits", T.IntegerType()),
        ]
    )
)


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about ``limit`` characters, one list in memory at a time."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.orderBy("i", "t").toLocalIterator():
        if block and size + len(row["t"]) > limit:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    yield block


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    unit: int = UNIT,
    edits: int = EDITS,
    q: int = Q,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """All columns of ``docs`` and ``passages``: ``array<struct<item_id, start, end, edits>>``.

    A passage is any stretch of ``unit`` characters of a benchmark item (a whole
    item if it is shorter) that the text holds with at most ``edits`` edits, case
    and the width of white space apart. ``start`` and ``end`` are code points of
    the text; overlapping passages of an item are one.

    Texts are scanned in place without a shuffle; a task holds the index of one
    block of the benchmark, and a larger benchmark is searched block by block.
    Items shorter than ``LEAST_CHARS`` are found without an edit, between
    characters that are not both letters or digits. Null and empty texts have no
    passages, nor have items that are null or shorter than ``q``. Rows keep their order and number, repeated ones included;
    a column ``passages`` of ``docs`` is replaced.
    """
    docs = docs.drop("passages")
    found = docs.withColumn("passages", F.array().cast(SPANS))
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_chars):
        found = _search_block(found, Index.of(block, unit, edits, q), text_col)
    return found


def _search_block(docs: DataFrame, index: Index, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    text_at, names, schema = docs.columns.index(text_col), docs.columns, docs.schema
    spans_at = names.index("passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(text_at), SCREEN_BYTES):
                part = batch.slice(texts.first, len(texts))
                hits = piece_matches(texts, shared.value)
                if hits:
                    lists = part.column(spans_at).to_pylist()
                    for row, spans in hits.items():
                        lists[row] = [
                            *lists[row], *({"item_id": i, "start": s, "end": e, "edits": k} for i, s, e, k in merged(spans))
                        ]
                    columns = list(part.columns)
                    columns[spans_at] = pa.array(lists, part.schema.field(spans_at).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(run, schema)


def piece_matches(texts: Texts, index: Index) -> dict[int, list[tuple[int, int, int, int]]]:
    """Matches by row. All rows of a piece are screened together, and only rows with dense hits are searched."""
    if not len(index.keys) or not len(texts.data):
        return {}
    points = code_points(texts.data.tobytes())
    starts = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])[texts.bounds]
    squeezed, origin = squeeze(points)
    at = np.flatnonzero(index.table[_slot(gram_keys(squeezed, index.q))])
    at = _dense(at, index.bound, index.span)
    rows = np.unique(np.searchsorted(starts, origin[at], side="right") - 1)
    # A dense stretch over the end of a row may belong to the row before or after it.
    rows = np.unique(np.concatenate([rows, rows + 1]))
    found = {}
    for row in rows[rows < len(texts)]:
        spans = row_matches(points[starts[row] : starts[row + 1]], index)
        if spans:
            found[int(row)] = spans
    return found
