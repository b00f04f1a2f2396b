"""Variable-capacity best-fit packing of documents into training sequences.

Best-fit decreasing treats pieces of equal length alike, so it is planned on the
histogram of lengths, which has at most as many entries as the largest capacity
whatever the corpus. Bins are planned as ranges of equal bins. Spark then gives
each piece its place among all pieces by length, and a join with the plan turns
places into bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.indexing import global_index
from corpusloom.session import materialize

# Permitted sequence lengths in words.
CAPACITIES = (512, 1024, 2048)


def training_cost(capacity: int) -> float:
    """What a sequence costs: a fixed part, its length, and attention over its square."""
    return 8 + capacity + capacity * capacity / 16384


@dataclass(frozen=True)
class Placement:
    """Pieces ``first .. first + count - 1`` of one length go to bins from ``bin`` on, ``per_bin`` each."""

    tokens: int
    first: int
    count: int
    bin: int
    per_bin: int
    offset: int


class _OpenBins:
    """Ranges of equal open bins by free space: (first bin, bins, capacity)."""

    def __init__(self):
        self.free: list[int] = []
        self.ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)

    def add(self, free: int, first: int, bins: int, capacity: int) -> None:
        if bins and free:
            if not self.ranges[free]:
                insort(self.free, free)
            self.ranges[free].append((first, bins, capacity))

    def take(self, tokens: int) -> tuple[int, tuple[int, int, int]] | None:
        """A range of the fullest bins that still hold ``tokens``."""
        at = bisect_left(self.free, tokens)
        if at == len(self.free):
            return None
        free = self.free[at]
        taken = self.ranges[free].pop()
        if not self.ranges[free]:
            self.free.pop(at)
        return free, taken


def least_cost(
    tokens: int, left: dict[int, int], lengths: list[int], capacities: Sequence[int], cost: Callable[[int], float]
) -> int:
    """The capacity whose bin costs least per packed token.

    A trial fill takes as many pieces of ``tokens`` as there are and fit, then
    the longest remaining pieces. Equal costs go to the larger capacity.
    """
    best = None
    for capacity in sorted(capacities, reverse=True):
        if capacity < tokens:
            continue
        filled = tokens * min(left[tokens], capacity // tokens)
        at = bisect_left(lengths, tokens) - 1
        while at >= 0 and filled < capacity:
            length = lengths[at]
            if length > capacity - filled:
                at = bisect_left(lengths, capacity - filled + 1, 0, at) - 1
                continue
            filled += length * min(left[length], (capacity - filled) // length)
            at -= 1
        rate = cost(capacity) / filled
        if best is None or rate < best[0]:
            best = (rate, capacity)
    return best[1]


def plan(histogram: dict[int, int], capacities: Sequence[int], cost: Callable[[int], float]) -> list[Placement]:
    """Best-fit decreasing over ``length -> pieces``, pieces numbered by rising length.

    Each length in falling order fills the fullest bins it fits; where none is
    left, bins of the least-cost capacity are opened.
    """
    lengths = sorted(length for length, n in histogram.items() if n and length)
    left = {length: histogram[length] for length in lengths}
    first, total = {}, 0
    for length in lengths:
        first[length], total = total, total + left[length]
    open_bins, bins, out = _OpenBins(), 0, []
    for tokens in reversed(lengths):
        at, n = first[tokens], left[tokens]
        capacity = 0
        while n:
            taken = open_bins.take(tokens)
            if taken is None:
                capacity = capacity or least_cost(tokens, left, lengths, capacities, cost)
                fresh = -(-n // (capacity // tokens))
                taken, bins = (capacity, (bins, fresh, capacity)), bins + fresh
            free, (start, count, size) = taken
            per_bin = free // tokens
            full = min(count, n // per_bin)
            if full:
                out.append(Placement(tokens, at, full * per_bin, start, per_bin, size - free))
                open_bins.add(free - per_bin * tokens, start, full, size)
                at, n = at + full * per_bin, n - full * per_bin
            if full < count and n:
                # Fewer pieces are left than one bin takes.
                out.append(Placement(tokens, at, n, start + full, n, size - free))
                open_bins.add(free - n * tokens, start + full, 1, size)
                at, n, full = at + n, 0, full + 1
            open_bins.add(free, start + full, count - full, size)
            left[tokens] = n
    return out


def word_count(text: Column) -> Column:
    """Words between white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = training_cost,
) -> DataFrame:
    """``(<id_col>, piece, start, n_tokens, bin_id, bin_offset, bin_fill, bin_capacity)``.

    A document is cut into pieces of the largest capacity and a rest, and every
    piece lies whole in one bin, from ``bin_offset`` on. A bin ends with the
    smallest permitted capacity that holds its contents. ``tokens`` is the
    length of a row, words of ``text_col`` by default.

    Texts that are null or without a token keep one row of 0 tokens with a null
    bin. Repeated rows are packed as often as they come; null ids are packed
    like any other; other columns are not read; an empty table gives an empty
    result.
    """
    largest = max(capacities)
    length = word_count(F.col(text_col)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    # Written, so that the texts are read once. The row number tells repeated rows apart.
    rows = docs.select(F.col(id_col).alias("id"), length.alias("length"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lengths")
    last = F.greatest(F.ceil(F.col("length") / F.lit(largest)) - 1, F.lit(0)).cast("int")
    pieces = rows.select("id", "row", "length", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "id", "row", "piece", F.least(F.col("length") - F.col("piece") * F.lit(largest), F.lit(largest)).alias("n_tokens")
    )
    counted = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["n_tokens"]: r["n"] for r in counted.collect()}  # at most the largest capacity + 1 rows
    placements = plan(histogram, capacities, cost)
    packed = _assign(pieces.where("n_tokens > 0"), placements, docs.sparkSession)
    fill = F.sum("n_tokens").over(Window.partitionBy("bin_id"))
    sizes = F.array(*[F.lit(c) for c in sorted(capacities)])
    fitted = packed.withColumn("bin_fill", fill).withColumn(
        "bin_capacity", F.get(F.filter(sizes, lambda c: c >= F.col("bin_fill")), F.lit(0)).cast("long")
    )
    empty = pieces.where("n_tokens = 0").select(
        "id", "piece", "n_tokens", *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "bin_fill", "bin_capacity")]
    )
    columns = ["id", "piece", "n_tokens", "bin_id", "bin_offset", "bin_fill", "bin_capacity"]
    every = fitted.select(columns).unionByName(empty.select(columns))
    return every.select(
        F.col("id").alias(id_col), "piece", (F.col("piece") * F.lit(largest)).cast("long").alias("start"),
        "n_tokens", "bin_id", "bin_offset", "bin_fill", "bin_capacity",
    )


def _assign(pieces: DataFrame, placements: list[Placement], spark) -> DataFrame:
    """Add ``bin_id, bin_offset``: pieces in order of length meet the plan by their position."""
    ordered = global_index(pieces, ["n_tokens", "row", "piece"], "place")
    table = spark.createDataFrame(
        [(p.tokens, p.first, p.count, p.bin, p.per_bin, p.offset) for p in placements],
        "n_tokens long, first long, count long, bin long, per_bin long, offset long",
    )
    at = F.col("place") - 1 - F.col("first")
    # A few rows per length, and lengths end at the largest capacity.
    return (
        ordered.join(F.broadcast(table), "n_tokens")
        .where((at >= 0) & (at < F.col("count")))
        .select(
            "id", "piece", "n_tokens",
            (F.col("bin") + F.floor(at / F.col("per_bin"))).cast("long").alias("bin_id"),
            (F.col("offset") + F.pmod(at, F.col("per_bin")) * F.col("n_tokens")).cast("long").alias("bin_offset"),
        )
    )
