"""Term scoring, feature ids, selection and order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scoring import chi_squares, gain_and_dispersion
from corpusloom.operators.counts import CorpusTotals
from corpusloom.operators.indexing import global_index

# Fixed value: terms x categories that a task scores at once, one term at least: arrays within a core's cache.
CELLS = 1 << 14


def feature_ids(terms: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Add ``id`` = 1.. in term order, before any pruning, so ids keep gaps later.

    ``finish`` may add scores while the numbered terms are written.
    """
    return global_index(terms, ["term"], "id", finish)


def score_terms(profiles: DataFrame, totals: CorpusTotals) -> DataFrame:
    """Add ``ig``, ``chi`` and ``score`` = ig * chi to one row per term.

    Counting documents per term and class once replaces a pass over the corpus
    for every term: all scores are a projection over those counts, which is
    taken for many terms at once, a cell of a double per term and category.
    """
    labels = list(dict.fromkeys(totals.labels))
    place = np.array([labels.index(label) for label in totals.labels], np.int64)
    n_docs = np.array(totals.n_docs, np.float64)
    n, entropy = totals.n, totals.entropy

    @F.arrow_udf("struct<ig double, chi double>")
    def both(df: pa.Array, by_label: pa.Array) -> pa.Array:
        df, ends = df.to_numpy(zero_copy_only=False).astype(np.float64), by_label.offsets.to_numpy()
        held = slice(ends[0], ends[-1])
        code = pc.fill_null(pc.index_in(by_label.keys, value_set=pa.array(labels, pa.string())), -1).to_numpy(zero_copy_only=False)[held]
        a = by_label.items.field("a").to_numpy(zero_copy_only=False)[held]
        ig, chi = np.empty(len(df)), np.empty(len(df))
        at_once = max(1, CELLS // max(1, len(place)))
        for start in range(0, len(df), at_once):
            stop = min(start + at_once, len(df))
            here = slice(ends[start] - ends[0], ends[stop] - ends[0])
            row = np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1]))
            named = code[here] >= 0
            cells = np.zeros((stop - start, len(labels)))
            cells[row[named], code[here][named]] = a[here][named]
            ig[start:stop], chi[start:stop] = gain_and_dispersion(cells[:, place], df[start:stop], n_docs, n, entropy)
        return pa.StructArray.from_arrays([pa.array(ig), pa.array(chi)], names=["ig", "chi"])

    scored = profiles.withColumn("_both", both("df", "by_label"))
    return scored.select(
        *profiles.columns,
        F.col("_both.ig").alias("ig"),
        F.col("_both.chi").alias("chi"),
        (F.col("_both.ig") * F.col("_both.chi")).alias("score"),
    )


def class_arrays(scored: DataFrame, totals: CorpusTotals) -> DataFrame:
    """``class_tf`` and ``class_chi`` in code order instead of ``by_label``."""
    cells = totals.cells(F.col("by_label"))
    return scored.select(
        *[c for c in scored.columns if c != "by_label"],
        totals.class_tf(F.col("by_label")).alias("class_tf"),
        chi_squares(cells, F.col("df").cast("double"), totals.n).alias("class_chi"),
    )


def select_terms(scored: DataFrame, threshold: float) -> DataFrame:
    """Drop terms scored below the threshold; equality and NaN stay."""
    return scored.where(~(F.col("score") < F.lit(float(threshold))))


def order_terms(dictionary: DataFrame, k: int | None = None) -> DataFrame:
    """By falling score, equal scores by id; the best ``k`` if asked for."""
    ordered = dictionary.orderBy(F.desc("score"), "id")
    return ordered if k is None else ordered.limit(k)
