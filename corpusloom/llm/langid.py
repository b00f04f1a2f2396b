"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrow import Texts, pieces

PROFILE = 400
UNDETERMINED = "und"
# A profile holds PROFILE grams, so this bounds what is broadcast.
MAX_LANGUAGES = 1000
CODE_BITS = 21


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point to its lower-case letter, 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint64)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            lower = char.lower()
            table[point] = ord(lower[0]) if lower else point
    return table


def row_letters(texts: Texts) -> Iterator[np.ndarray]:
    """For each row its letters, with one 0 around and between runs of letters."""
    points = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    # Code points before each byte bound: all bytes but continuation bytes start one.
    starts = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])[texts.bounds]
    values = letters()[points]
    for a, b in zip(starts[:-1], starts[1:]):
        row = np.zeros(b - a + 2, np.uint64)
        row[1:-1] = values[a:b]
        # Drop a 0 that follows a 0.
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != 0) | (row[:-1] != 0)
        row = row[keep]
        if len(row) and row[-1]:
            row = np.append(row, np.uint64(0))
        yield row


def grams(row: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams with a letter; 1 stands for a word boundary.

    It is no letter's code point, and grams of different lengths differ as none begins with 0.
    """
    shift = np.uint64(CODE_BITS)
    row = np.maximum(row, np.uint64(1))
    one = row[row != 1]
    two = (row[:-1] << shift) | row[1:]
    middle = row[1:-1] != 1
    three = ((two[:-1] << shift) | row[2:])[middle]
    return np.concatenate([one, two, three])


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, best first; equal counts by code."""
    values, counts = counted(codes)
    if len(values) > size:
        cut = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= cut
        values, counts = values[keep], counts[keep]
    return values[np.argsort(-counts, kind="stable")][:size]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and how often each occurs."""
    codes = np.sort(codes)
    if not len(codes):
        return codes, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


@dataclass(frozen=True)
class Profiles:
    """Rank of each gram in every language, ``size`` where it has none."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list, size: int) -> "Profiles":
        languages = tuple(sorted({r["lang"] for r in rows}))
        at = {lang: i for i, lang in enumerate(languages)}
        codes = np.array(sorted({r["gram"] for r in rows}), np.uint64)
        ranks = np.full((len(codes), len(languages)), size, np.int64)
        for r in rows:
            ranks[np.searchsorted(codes, np.uint64(r["gram"])), at[r["lang"]]] = r["rank"] - 1
        return cls(languages, codes, ranks, size)

    def predict(self, own: np.ndarray) -> tuple[str, float]:
        """Language of the smallest out-of-place distance, and 1 - distance / largest distance.

        ``own`` lists a document's grams best first. A gram that a profile lacks
        costs the profile's size; equal distances go to the first language by name.
        """
        if not len(own) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), max(0, len(self.codes) - 1))
        known = self.codes[at] == own
        place = np.abs(self.ranks[at] - np.arange(len(own))[:, None])
        missing = ~known[:, None] | (self.ranks[at] == self.size)
        distance = np.where(missing, self.size, place).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(1.0 - distance[best] / (self.size * len(own)))


def _codes_by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in pieces(batch.column("text")):
            labels = batch.column("label").slice(texts.first, len(texts)).to_pylist()
            by_label: dict[str, list[np.ndarray]] = {}
            for label, row in zip(labels, row_letters(texts)):
                by_label.setdefault(label, []).append(grams(row))
            for label, codes in by_label.items():
                values, counts = counted(np.concatenate(codes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )


def learn_profiles(docs: DataFrame, text_col: str, lang_col: str, size: int = PROFILE) -> Profiles:
    """Profiles of all languages over all given rows; null texts and languages are left out.

    Counts are summed per piece in the task and then on the map side, so a
    frequent language moves no more rows than its different n-grams. What comes
    to the driver is ``size`` grams for each of at most ``MAX_LANGUAGES`` languages.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    rows = rows.where("label IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_codes_by_label, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    best = top.select("lang", "gram", "rank").limit(MAX_LANGUAGES * size + 1).collect()
    if len({r["lang"] for r in best}) > MAX_LANGUAGES or len(best) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles.of(best, size)


def predict_languages(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred, score``; only the text is read for them.

    A text that is null or without a letter gets ``und`` and 0, as does every
    text if no language was learned. Score is from 0 to 1. Whole texts count.
    Columns of ``docs`` named ``lang_pred`` or ``score`` are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    model: Broadcast = docs.sparkSession.sparkContext.broadcast(profiles)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(text_at)):
                own = [model.value.predict(ranked(grams(row), profiles_size)) for row in row_letters(texts)]
                part = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([lang for lang, _ in own], pa.string()),
                        pa.array([score for _, score in own], pa.float64()),
                    ],
                    names=[*names, "lang_pred", "score"],
                )

    profiles_size = profiles.size
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids whose crc32 as text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
