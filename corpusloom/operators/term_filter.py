"""A Bloom filter of terms: bitmaps in a small table, probed by a broadcast join.

A term's hash names one block of the filter and two bits in it, so that a row
meets one block. Built and probed with built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits and bytes of Spark's bitmaps, which are one block each, and the 64-bit words of one.
BLOCK_BITS = 32_768
BLOCK_BYTES = 4_096
BLOCK_WORDS = 512

# Two of sixteen bits a term let about one of seventy unknown terms pass; below two bits a term nearly all would.
BITS_PER_TERM = 16
LEAST_BITS_PER_TERM = 2


def block_count(terms: int, max_bytes: int) -> int:
    """Blocks for so many terms within ``max_bytes``; 0 where that is too little to tell terms apart."""
    blocks = min(max(1, -(-terms * BITS_PER_TERM // BLOCK_BITS)), max_bytes // BLOCK_BYTES)
    return blocks if blocks * BLOCK_BITS >= terms * LEAST_BITS_PER_TERM else 0


def _block(term: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(blocks))


def _bits(term: Column) -> list[Column]:
    """Two positions in the block, from bits that hardly decide the block."""
    return [F.shiftrightunsigned(F.xxhash64(term), by).bitwiseAND(F.lit(BLOCK_BITS - 1)) for by in (32, 47)]


def build_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """``(_block, _words)``: the set bits of a block as 64-bit words, the first byte of a word highest.

    One row per block that has a term; as arrays, because a bitmap would be copied for every row that probes it.
    """
    term = F.col("term")
    placed = entries.where(term.isNotNull()).select(_block(term, blocks).alias("_block"), F.explode(F.array(*_bits(term))).alias("_bit"))
    maps = placed.groupBy("_block").agg(F.expr("bitmap_construct_agg(_bit)").alias("bitmap"))
    word = "cast(conv(hex(substring(bitmap, i * 8 + 1, 8)), 16, -10) as bigint)"
    return maps.select("_block", F.expr(f"transform(sequence(0, {BLOCK_WORDS - 1}), i -> {word})").alias("_words"))


def maybe_among(rows: DataFrame, found: DataFrame, blocks: int, keep: Column) -> DataFrame:
    """The rows whose term may be in the filter, and those that ``keep`` names; nothing is shuffled.

    No row whose term is in the filter is lost.
    """
    words, term = F.col("_words"), F.col("term")

    def is_set(bit: Column) -> Column:
        inside = bit.bitwiseAND(F.lit(63))
        # Bytes of a word are read highest first, bits of a byte lowest first.
        place = F.lit(56) - F.lit(8) * F.shiftright(inside, 3) + inside.bitwiseAND(F.lit(7))
        return F.getbit(F.get(words, F.shiftright(bit, 6).cast("int")), place.cast("int")) == 1

    one, other = _bits(term)
    probed = rows.withColumn("_block", _block(term, blocks)).join(F.broadcast(found), "_block", "left")
    hit = F.coalesce(is_set(one) & is_set(other), F.lit(False)) & term.isNotNull()
    return probed.where(hit | keep).select(*rows.columns)
