"""Licence scans: Dice coefficient over word bigrams against licence templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.arrow import Texts, pieces
from corpusloom.llm.license_texts import NOTICE_WORDS, TELLING, TELLING_FAMILIES, TEMPLATES, full_texts
from corpusloom.llm.words import WINDOW_BASES, Words, find_words, window_hashes, word_hashes

THRESHOLD = 0.8
# Of neighbouring starts one in so many is tried first; the others only where they can be better than the best so far.
STRIDE = 64
# Normalised words are runs of ASCII letters and digits and of all bytes beyond ASCII.
BREAKS = np.array([not (chr(b).isalnum() or b >= 0x80) if b < 0x80 else False for b in range(256)])


@dataclass(frozen=True)
class Bigrams:
    """A template's bigrams, sorted with repeats."""

    license_id: str
    values: np.ndarray
    telling: frozenset[str] | None = None


@lru_cache(maxsize=8)
def _templates(texts: tuple[tuple[str, str], ...]) -> tuple[tuple[Bigrams, ...], np.ndarray, np.ndarray]:
    """Templates by size, all their bigrams sorted, and how often each template has each of them."""
    out = []
    for name, text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        values = np.sort(_Normal(Texts(data, np.array([0, len(data)]), 0)).bigrams())
        notice = name.startswith(TELLING_FAMILIES) and len(values) < NOTICE_WORDS
        out.append(Bigrams(name, values, telling_words(text) if notice else None))
    out.sort(key=lambda t: (len(t.values), t.license_id))
    every = np.unique(np.concatenate([t.values for t in out])) if out else np.empty(0, np.uint64)
    counts = np.zeros((len(out), len(every)), np.int32)
    for row, template in zip(counts, out):
        np.add.at(row, np.searchsorted(every, template.values), 1)
    return tuple(out), every, counts


class _Normal:
    """Words of texts in normal form: lower-case ASCII, split at all other ASCII."""

    def __init__(self, texts: Texts):
        data = texts.data
        small = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.texts = Texts(small, texts.bounds, texts.first)
        self.words: Words = find_words(self.texts, BREAKS)
        self.hashes = word_hashes(self.texts, self.words)

    def bigrams(self) -> np.ndarray:
        return window_hashes(self.hashes, 2, WINDOW_BASES[0])


def telling_words(text: str) -> frozenset[str]:
    """The words of a text that tell a licence from its relatives; "library" only as a part of a name."""
    words = re.findall("[a-z0-9]+", text.lower())
    named = {"library"} if ("library", "general") in zip(words, words[1:]) else set()
    return (frozenset(words) & TELLING) | named


def dice(a: np.ndarray, b: np.ndarray) -> float:
    """2 |a and b| / (|a| + |b|) of two sorted arrays with repeats."""
    values, counts = np.unique(a, return_counts=True)
    other = np.searchsorted(b, values, side="right") - np.searchsorted(b, values, side="left")
    return 2.0 * float(np.minimum(counts, other).sum()) / (len(a) + len(b)) if len(a) + len(b) else 0.0


def size_range(size: int, threshold: float) -> tuple[float, float]:
    """Template sizes that can reach the threshold: 2 min(a, b) / (a + b) bounds the coefficient."""
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def best_windows(
    at: np.ndarray, codes: np.ndarray, counts: np.ndarray, threshold: float, every: bool = True
) -> Iterator[tuple[int, int, float]]:
    """``(first, last, dice)``: for every start the best window of bigrams from ``threshold`` up, the longest of equal ones.

    ``at`` and ``codes`` are places and kinds of the template's bigrams in a
    text, ``counts`` how often the template has each kind. A best window begins
    and ends in such bigrams, and ``size_range`` bounds it and their number.

    Without ``every`` starts are taken by stretches shorter than any window, so
    that all windows of a stretch overlap, and only its best window is given. A
    start ``d`` bigrams later has at most the value times n / (n - d), where n is
    the sum of the template's size and the least size of a window (and of the
    threshold, as longer windows stay below it); starts that this bound keeps
    below the best of their stretch are not tried.
    """
    size = int(counts.sum())
    low, high = size_range(size, threshold)
    least = max(1, int(np.ceil(low - 1e-9)))
    if len(at) < least:
        return
    near = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] + 1 <= high + 1e-9)
    ends = np.searchsorted(at, at + high + 1e-9 - 1, side="right")
    # The number of each bigram among its kind, from the first of the text on.
    order = np.argsort(codes, kind="stable")
    kinds = codes[order]
    number = np.empty(len(codes), np.int64)
    number[order] = np.arange(len(codes)) - np.searchsorted(kinds, kinds, side="left")
    allowed = counts[codes]

    def best(i: int) -> tuple[int, int, float]:
        own = slice(i, int(ends[i]))
        part = codes[own]
        gone = before(i)
        value = 2.0 * np.cumsum(number[own] - gone[part] < allowed[own]) / (at[own] - at[i] + 1 + size)
        j = len(value) - 1 - int(value[::-1].argmax())
        return int(at[i]), int(at[i + j]), float(value[j])

    done, gone = 0, np.zeros(len(counts), np.int64)

    def before(i: int) -> np.ndarray:
        """How often each kind stands before ``i``; places may be asked for in any order."""
        nonlocal done
        if i > done:
            np.add.at(gone, codes[done:i], 1)
        elif i < done:
            np.subtract.at(gone, codes[i:done], 1)
        done = i
        return gone

    if every:
        for i in near.tolist():
            found = best(i)
            if found[2] >= threshold:
                yield found
        return
    bounded = size + low
    while len(near):
        stretch = near[at[near] - at[near[0]] < low]
        near = near[len(stretch) :]
        leaders = [(best(int(i)), k) for k, i in zip(range(0, len(stretch), STRIDE), stretch[::STRIDE])]
        top = max((found for found, _ in leaders), key=lambda f: (f[2], f[1] - f[0]))
        for found, k in sorted(leaders, key=lambda x: -x[0][2]):
            block = stretch[k + 1 : k + STRIDE]
            limit = max(top[2], threshold)
            rest = [int(i) for i in block if max(found[2], threshold) * bounded / (bounded - (at[i] - at[stretch[k]])) >= limit - 1e-9]
            for i in rest:
                top = max(top, best(i), key=lambda f: (f[2], f[1] - f[0]))
        if top[2] >= threshold:
            yield top


def scan_row(normal: _Normal, row: int, templates, counts: np.ndarray, kinds: np.ndarray, known: np.ndarray, threshold: float):
    words = normal.words
    a, b = int(words.bounds[row]), int(words.bounds[row + 1])
    if b - a < 2:
        return []
    at = np.flatnonzero(known[a : b - 1])
    held = counts[:, kinds[a + at]] > 0
    least = [size_range(len(t.values), threshold)[0] - 1e-9 for t in templates]
    windows = []
    for t in np.flatnonzero((held.sum(axis=1) >= least) & held.any(axis=1)):
        spots = at[held[t]]
        for s, e, value in best_windows(spots, kinds[a + spots], counts[t], threshold, len(templates[t].values) < NOTICE_WORDS):
            stretch = slice(int(words.starts[a + s]), int(words.ends[min(a + e + 1, b - 1)]))
            telling = templates[t].telling
            if telling is None or telling == telling_words(normal.texts.data[stretch].tobytes().decode("utf-8", "replace")):
                windows.append((templates[t].license_id, value, s, e + 1))
    found, data, offset = [], normal.texts.data, int(normal.texts.bounds[row])
    for name, value, s, e in _best_of_overlaps(windows):
        # The bigram before ``e`` ends with the word ``e``.
        start, end = int(words.starts[a + s]), int(words.ends[a + e])
        before = int(((data[offset:start] & 0xC0) != 0x80).sum())
        found.append((name, value, before, before + int(((data[start:end] & 0xC0) != 0x80).sum())))
    return found


def _best_of_overlaps(found: list[tuple]) -> list[tuple]:
    """Of overlapping windows the one with the larger coefficient, then the longer one."""
    starts: list[int] = []
    kept: list[tuple] = []
    for hit in sorted(found, key=lambda h: (-h[1], h[2] - h[3], h[2])):
        i = bisect_left(starts, hit[2])
        if (i == 0 or kept[i - 1][3] <= hit[2]) and (i == len(kept) or kept[i][2] >= hit[3]):
            starts.insert(i, hit[2])
            kept.insert(i, hit)
    return kept


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    templates: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """``(<id_col>, license_id, dice, start, end)``, one row per licence text found.

    Templates are the notices of ``TEMPLATES`` and the whole texts of
    ``full_texts()``, or those given.

    Texts are read as normal words (ASCII lower case, split at everything but
    letters and digits). For each template all windows whose size allows
    ``threshold`` are compared with it as multisets of bigrams, wherever they
    begin and whatever stands around them; of overlapping finds the best stays, then
    the longest, and of several licences with equal windows any one. ``start``
    and ``end`` are code points of the text.

    Texts are scanned in place, without a shuffle. Null and empty texts and
    those of one word have no finds, a repeated row gives repeated finds, a null
    id stays null, and other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    pairs = tuple((name, text) for name, text in (TEMPLATES + full_texts() if templates is None else templates))
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("license_id", T.StringType()),
            T.StructField("dice", T.DoubleType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, every, counts = _templates(pairs)
        for batch in batches:
            for texts in pieces(batch.column("text")):
                normal = _Normal(texts)
                bigrams = normal.bigrams()
                at = np.minimum(np.searchsorted(every, bigrams), max(0, len(every) - 1))
                known = every[at] == bigrams if len(every) else np.zeros(len(bigrams), bool)
                # Rows with a known bigram; the others cannot reach any template.
                touched = np.unique(np.searchsorted(normal.words.bounds, np.flatnonzero(known), side="right") - 1)
                found = [(int(row), *hit) for row in touched for hit in scan_row(normal, row, own, counts, at, known, threshold)]
                ids = batch.column("id").slice(texts.first, len(texts))
                columns = list(zip(*found)) or [(), (), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()),
                        pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32()),
                    ],
                    names=["id", "license_id", "dice", "start", "end"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
