"""The category dimension ``(code, label)``: codes count from 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORY_SCHEMA = "code int, label string"

# What is done per category is kept in arrays of one number each; a column of more values is no category.
MAX_CATEGORIES = 100_000


def bounded_rows(groups: DataFrame, value: Column) -> DataFrame:
    """One row whose ``rows`` are the sorted values of a table of one row per category.

    A corpus of more than ``MAX_CATEGORIES`` labels fails with a message; no task takes in more rows than that.
    """
    taken = groups.limit(MAX_CATEGORIES + 1).agg(F.sort_array(F.collect_list(value)).alias("rows"))
    too_many = F.raise_error(F.lit(f"the corpus has more than {MAX_CATEGORIES} labels; is the label column right?"))
    return taken.select(F.when(F.size("rows") > MAX_CATEGORIES, too_many).otherwise(F.col("rows")).alias("rows"))


def categories_from_names(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Configured categories in their given order."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], CATEGORY_SCHEMA)


def categories_from_labels(docs: DataFrame) -> DataFrame:
    """Distinct labels of a corpus in name order (one row per category)."""
    labels = bounded_rows(docs.select("label").distinct(), F.col("label"))
    return labels.select(F.posexplode("rows").alias("pos", "label")).select((F.col("pos") + 1).alias("code"), "label")


def write_label_index(categories: DataFrame, path: str) -> None:
    """``name code`` lines."""
    categories.orderBy("code").select(F.concat_ws(" ", "label", "code").alias("value")).write.text(path)


def read_label_index(spark: SparkSession, path: str) -> DataFrame:
    """Back from ``name code`` lines; the code is after the last blank."""
    line = F.col("value")
    return spark.read.text(path).select(
        F.regexp_extract(line, r"^(.*) (\d+)$", 2).cast("int").alias("code"),
        F.regexp_extract(line, r"^(.*) (\d+)$", 1).alias("label"),
    )
