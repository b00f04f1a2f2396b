"""Words of UTF-8 texts and 64-bit hashes of words and word windows, all rows of a piece at once.

A word is a run of bytes outside space and tab..carriage return, which is
``[^\\x20\\x09-\\x0D]+`` on the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

from corpusloom.llm.arrow import Texts

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Odd multipliers and the mixing constants of the splitmix64 generator.
WINDOW_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1
# Bytes that one step of a word hash takes, and the masks of a step's last bytes.
LANE = 8
LANE_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(LANE + 1)], np.uint64)
# Longer words are hashed one by one.
LONG_WORD = 512


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values without linear structure."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """Start and end byte of every word, and the bounds of each row among the words."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def find_words(texts: Texts, breaks: np.ndarray = SPACE) -> Words:
    """Words of all rows; ``breaks`` tells for each byte whether it stands between words."""
    data = texts.data
    if not len(data):
        empty = np.empty(0, np.int64)
        return Words(empty, empty, np.zeros(len(texts) + 1, np.int64))
    space = breaks[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    inner = texts.bounds[(texts.bounds > 0) & (texts.bounds < len(data))]
    before[inner] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[inner - 1] = True
    starts = np.flatnonzero(before & ~space)
    return Words(starts, np.flatnonzero(after & ~space) + 1, np.searchsorted(starts, texts.bounds))


def word_hashes(texts: Texts, words: Words, seed: int = 0) -> np.ndarray:
    """One 64-bit value for each word, equal for equal bytes wherever they stand.

    Eight bytes at a time go through a bijection that is not linear, so words of
    one length up to eight bytes never share a value, and longer ones do so by
    chance only. Values of different seeds are independent.
    """
    lengths = words.ends - words.starts
    data = np.concatenate([texts.data, np.zeros(LANE, np.uint8)])
    lanes = np.ndarray(len(texts.data) + 1, "<u8", data, 0, (1,))
    out = mix(lengths.astype(np.uint64) * np.uint64(WINDOW_BASES[0]) + np.uint64(seed * MIX_2 & MASK))
    long = lengths > LONG_WORD
    # All words have a first step, so it needs no choice of rows.
    out = mix(out ^ (lanes[words.starts] & LANE_MASKS[np.minimum(lengths, LANE)]))
    rest = np.flatnonzero((lengths > LANE) & ~long)
    at = LANE
    while len(rest):
        part = lanes[words.starts[rest] + at] & LANE_MASKS[np.minimum(lengths[rest] - at, LANE)]
        out[rest] = mix(out[rest] ^ part)
        at += LANE
        rest = rest[lengths[rest] > at]
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh64_intdigest(texts.data[words.starts[i] : words.ends[i]].tobytes(), seed)
    return out


def window_hashes(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial of every run of ``size`` consecutive word hashes."""
    count = max(0, len(hashes) - size + 1)
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out = out * np.uint64(base) + hashes[i : i + count]
    return mix(out)


def whole_windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that lie inside one row: their first word among all words, and inside the row."""
    counts = np.maximum(words.counts - size + 1, 0)
    row_start = np.repeat(words.bounds[:-1], counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return row_start + inside, inside


def window_rows(words: Words, size: int) -> np.ndarray:
    """The row of each window of :func:`whole_windows`."""
    counts = np.maximum(words.counts - size + 1, 0)
    return np.repeat(np.arange(len(counts)), counts)
