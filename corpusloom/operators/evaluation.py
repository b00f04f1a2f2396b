"""Evaluation of predictions and the text reports made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import pad_right, short_decimal
from corpusloom.settings import Settings

# Report rules and column widths.
RULE = "=" * 79
TOTALS_RULE = "-" * 45
CLASS_WIDTHS = (30, 20, 20, 20, 20)
ONE_CLASS_WIDTHS = (30, 15, 15)


def confusion(predictions: DataFrame, categories: DataFrame) -> DataFrame:
    """``(code, label, a, b, c)`` per category.

    a = right, b = of the class but predicted elsewhere, c = predicted here but
    of another class. The predictions are read once and shrink to one row per
    (label, prediction) on the map side.
    """
    pairs = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    right = F.col("label") == F.col("prediction")
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("label").alias("label"),
            F.when(right, F.col("n")).otherwise(none).alias("a"),
            F.when(right, none).otherwise(F.col("n")).alias("b"),
            none.alias("c"),
        ),
        F.struct(
            F.col("prediction").alias("label"),
            none.alias("a"),
            none.alias("b"),
            F.when(right, none).otherwise(F.col("n")).alias("c"),
        ),
    )
    sums = pairs.select(F.inline(sides)).groupBy("label").agg(*[F.sum(x).alias(x) for x in ("a", "b", "c")])
    return categories.join(sums, "label", "left").select(
        "code", "label", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("a", "b", "c")]
    )


def recall(a: Column, b: Column) -> Column:
    """a / (a + b), 0 where nothing is right."""
    return F.when(a == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), a + b))


def precision(a: Column, c: Column) -> Column:
    """a / (a + c), 0 where nothing is predicted."""
    return F.coalesce(F.try_divide(a.cast("double"), a + c), F.lit(0.0))


def f_score(r: Column, p: Column) -> Column:
    """Harmonic mean, 0 if either side is 0."""
    return F.when((r == 0) | (p == 0), F.lit(0.0)).otherwise(F.try_divide(2 * p * r, r + p))


def class_metrics(counts: DataFrame) -> DataFrame:
    """Recall and precision in percent, F in 0..1, per category, best F first."""
    r, p = recall(F.col("a"), F.col("b")), precision(F.col("a"), F.col("c"))
    return counts.select(
        "code", "label", (r * 100).alias("recall"), (p * 100).alias("precision"), f_score(r, p).alias("fscore"),
        "a", "b", "c",
    ).orderBy(F.desc("fscore"), "code")


def overall_metrics(metrics: DataFrame) -> DataFrame:
    """One row: totals, accuracy, and means over all categories, absent ones as 0."""
    return metrics.agg(
        F.sum(F.col("a") + F.col("b")).alias("total"),
        F.sum("a").alias("correct"),
        F.avg("recall").alias("mean_recall"),
        F.avg("precision").alias("mean_precision"),
        F.avg("fscore").alias("mean_fscore"),
    ).select(
        "total",
        "correct",
        F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total")), F.lit(0.0)).alias("accuracy"),
        "mean_recall",
        "mean_precision",
        "mean_fscore",
    )


def one_class_metrics(own: DataFrame, categories: DataFrame) -> DataFrame:
    """``(code, label, accuracy, a, b)``: share of a category its own model accepts."""
    sums = own.groupBy("label").agg(
        F.sum(F.col("accepted").cast("long")).alias("a"), F.count(F.lit(1)).alias("b")
    )
    joined = categories.join(sums, "label", "left").select(
        "code", "label", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")
    )
    accuracy = F.coalesce(F.try_divide(F.col("a").cast("double"), F.col("b")), F.lit(0.0))
    return joined.select("code", "label", accuracy.alias("accuracy"), "a", "b").orderBy(F.desc("accuracy"), "code")


def _row(widths: tuple[int, ...], *cells: Column | str) -> Column:
    texts = [F.lit(c) if isinstance(c, str) else c for c in cells]
    return F.concat(*[pad_right(text, width) for text, width in zip(texts, widths)])


def _lines(*parts: Column) -> Column:
    return F.posexplode(F.concat(*parts)).alias("ord", "line")


def report_lines(metrics: DataFrame, settings: Settings) -> DataFrame:
    """``(ord, line)`` of the classification report.

    Its input has one row per category, so the whole report is one row of lines.
    """
    w = CLASS_WIDTHS
    line = _row(
        w,
        F.concat(F.lit("["), F.lower("label"), F.lit("]")),
        short_decimal(F.col("recall")),
        short_decimal(F.col("precision")),
        short_decimal(F.col("fscore")),
        F.concat_ws(" ", "a", "b", "c"),
    )
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("fscore")).alias("rank"), "code", line.alias("line"))))
    rows = metrics.agg(
        ranked.alias("rows"),
        F.sum(F.col("a") + F.col("b")).cast("double").alias("total"),
        F.sum("a").cast("double").alias("right"),
        *[F.avg(x).alias(x) for x in ("recall", "precision", "fscore")],
    )
    accuracy = F.coalesce(F.try_divide("right", "total"), F.lit(0.0))
    top = F.array(
        F.lit(RULE),
        F.lit("CORPUS:" + settings.corpus_name.upper()),
        F.lit(RULE),
        _row(w, "CATEGORY", "RECALL", "PRECISION", "FSCORE", "ABC"),
    )
    bottom = F.array(
        F.lit(TOTALS_RULE),
        _row(
            w,
            "ACCURACY:",
            accuracy.cast("string"),
            F.concat(F.lit("total:"), F.col("total").cast("string")),
            F.concat(F.lit("true:"), F.col("right").cast("string")),
            F.concat(F.lit("false:"), (F.col("total") - F.col("right")).cast("string")),
        ),
        _row(w, "MEAN-RECALL:", short_decimal(F.col("recall"))),
        _row(w, "MEAN-PRECISION:", short_decimal(F.col("precision"))),
        _row(w, "MEAN-FSCORE:", short_decimal(F.col("fscore"))),
        _row(w, "COST:", F.lit(float(settings.cost)).cast("string")),
        _row(w, "GAMMA:", F.lit(float(settings.gamma)).cast("string")),
    )
    return rows.select(_lines(top, F.transform("rows", lambda x: x["line"]), bottom))


def one_class_report_lines(metrics: DataFrame, settings: Settings) -> DataFrame:
    """``(ord, line)`` of the one-class report."""
    w = ONE_CLASS_WIDTHS
    line = _row(
        w,
        F.concat(F.lit("["), F.upper("label"), F.lit("]")),
        short_decimal(F.col("accuracy")),
        F.concat_ws(" ", "a", "b"),
    )
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("accuracy")).alias("rank"), "code", line.alias("line"))))
    rows = metrics.agg(ranked.alias("rows"), F.avg("accuracy").alias("accuracy"))
    top = F.array(
        F.lit(RULE),
        F.lit("CORPUS:" + settings.corpus_name.upper()),
        F.lit(RULE),
        _row(w, "CATEGORY", "ACCURACY", "AB"),
    )
    bottom = F.array(F.lit(" "), _row(w, "ACCURACY:", short_decimal(F.col("accuracy"))))
    return rows.select(_lines(top, F.transform("rows", lambda x: x["line"]), bottom))
