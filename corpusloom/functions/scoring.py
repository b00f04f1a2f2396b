"""Scoring formulas over counts.

n = documents, n_c = documents of a class, df = documents with the term,
a = documents of the class with the term.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let


def plogp(count: Column, n: Column) -> Column:
    """p * log2(p) of p = count / n, 0 at p = 0."""
    p = count / n
    return F.when(count == 0, F.lit(0.0)).otherwise(p * F.log2(p))


def xlogx(x: np.ndarray) -> np.ndarray:
    """x * log2(x) of counts, 0 at 0."""
    return x * (np.log(np.maximum(x, 1.0)) / math.log(2.0))


def _total(values: np.ndarray) -> np.ndarray:
    """Sums of rows, left to right."""
    return np.cumsum(values, axis=1)[:, -1]


def gain_and_dispersion(
    a: np.ndarray, df: np.ndarray, n_docs: np.ndarray, n: int, entropy: float
) -> tuple[np.ndarray, np.ndarray]:
    """Information gain, and how unevenly chi-square tells the classes apart, of terms with ``a`` documents per class.

    The gain weighs, with df / n and (n - df) / n, the sums of p * log2(p) over
    the classes, where p is the joint share a / n or (n_c - a) / n rather than
    the share within df: the definition dictionaries of this kind are built
    with. As the a sum up to df, the shares leave the sums, which run over
    counts. The dispersion is the standard deviation of :func:`chi_squares`.
    """
    pull = np.array([class_pull(c, n) for c in n_docs])
    n, bits = float(n), math.log2(n) if n else 0.0
    df, rest = df[:, None], n - df[:, None]
    parts = np.stack([df * xlogx(a), rest * xlogx(n_docs - a)], axis=2).reshape(len(a), -1)
    gain = (_total(parts) - ((df * df + rest * rest) * bits)[:, 0]) / (n * n) - entropy
    margins = df * rest
    term_pull = np.divide(1.0, margins, out=np.zeros_like(margins), where=margins > 0)
    difference = a * n - df * n_docs
    chis = difference * difference * pull * term_pull
    around = chis - (_total(chis) / chis.shape[1])[:, None]
    return gain, np.sqrt(_total(around * around) / chis.shape[1])


def class_pull(n_c: int, n: int) -> float:
    """The part of chi-square that depends on the class alone: n / (n_c * (n - n_c))."""
    rest = float(n_c) * float(n - n_c)
    return n / rest if rest > 0 else 0.0


def chi_squares(cells: Column, df: Column, n: int) -> Column:
    """One-class-against-the-rest chi-square of a term per cell, in class order.

    The cross difference of the 2x2 table is a * n - df * n_c, and the margins
    split into a class part (``pull``, see :func:`class_pull`) and a term part.
    A value is 0 where a margin is empty. Everything is double: the products
    pass the range of a long on large corpora.
    """
    n = F.lit(float(n))
    margins = df * (n - df)
    term_pull = F.when(margins > 0, 1.0 / margins).otherwise(F.lit(0.0))

    def value(c: Column, of_term: Column) -> Column:
        difference = c["a"] * n - of_term["df"] * c["n_docs"]
        return difference * difference * c["pull"] * of_term["pull"]

    return let(
        F.struct(df.alias("df"), term_pull.alias("pull")),
        lambda of_term: F.transform(cells, lambda c: value(c, of_term)),
    )


def term_weight(tf: Column, score: Column) -> Column:
    """sqrt(tf), held in single precision, times the term's score."""
    return F.sqrt(tf.cast("double")).cast("float").cast("double") * score
