"""Small helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    The optimizer may inline a column alias into a lambda, where it would run
    once per array element; a lambda variable is never inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    """Sum of an array of doubles, left to right."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def variance(values: Column) -> Column:
    """Population variance of an array of doubles; 0 for an empty array."""

    def around_mean(xs: Column) -> Column:
        n = F.size(xs)
        return F.when(n == 0, F.lit(0.0)).otherwise(
            let(
                total(xs) / n,
                lambda m: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / n,
            )
        )

    return let(values, around_mean)


def deviation(values: Column) -> Column:
    """Population standard deviation of an array of doubles."""
    return F.sqrt(variance(values))


def run_counts(ordered: Column) -> Column:
    """``array<struct<term,tf>>`` of an already sorted array of strings."""
    starts = F.filter(
        F.transform(
            ordered,
            lambda term, i: F.when(term.eqNullSafe(F.get(ordered, i - 1)), F.lit(-1)).otherwise(i),
        ),
        lambda i: i >= 0,
    )
    return let(
        starts,
        lambda at: F.transform(
            at,
            lambda i, k: F.struct(
                F.get(ordered, i).alias("term"),
                (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("long").alias("tf"),
            ),
        ),
    )
