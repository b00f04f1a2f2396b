"""Dictionary storage: parquet for our own use, text for exchange.

A dictionary is ``(id, term, df, ig, chi, score, class_tf, class_chi)``; its
meta row is ``(n, max_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dictionary(dictionary: DataFrame, meta: DataFrame, path: str) -> None:
    dictionary.write.mode("overwrite").parquet(f"{path}/terms")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/meta")


def dictionary_lines(dictionary: DataFrame, meta: DataFrame) -> DataFrame:
    """``N,maxId`` and then ``id term df ig chi score`` by falling score."""
    header = meta.select(F.concat_ws(",", "n", "max_id").alias("value"))
    body = dictionary.orderBy(F.desc("score"), "id").select(
        F.concat_ws(" ", "id", "term", "df", "ig", "chi", "score").alias("value")
    )
    return header.unionAll(body)


def class_tf_lines(dictionary: DataFrame) -> DataFrame:
    """``id tf1 .. tfK`` by falling score."""
    return _array_lines(dictionary, "class_tf")


def class_chi_lines(dictionary: DataFrame) -> DataFrame:
    """``id x1 .. xK`` by falling score."""
    return _array_lines(dictionary, "class_chi")


def _array_lines(dictionary: DataFrame, column: str) -> DataFrame:
    values = F.array_join(F.col(column).cast("array<string>"), " ")
    return dictionary.orderBy(F.desc("score"), "id").select(
        F.concat_ws(" ", "id", values).alias("value")
    )


def write_dictionary_text(dictionary: DataFrame, meta: DataFrame, path: str) -> None:
    """The three text files of a dictionary run, each a folder of ordered parts."""
    dictionary_lines(dictionary, meta).write.mode("overwrite").text(f"{path}/dict")
    class_tf_lines(dictionary).write.mode("overwrite").text(f"{path}/tf")
    class_chi_lines(dictionary).write.mode("overwrite").text(f"{path}/chi")


def read_dictionary_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms and meta from a ``dict`` file or folder."""
    lines = spark.read.text(path)
    is_header = F.col("value").rlike(r"^\d+,\d+$")
    parts = F.split("value", " +")
    terms = lines.where(~is_header).select(
        F.get(parts, F.lit(0)).cast("long").alias("id"),
        F.get(parts, F.lit(1)).alias("term"),
        F.get(parts, F.lit(2)).cast("long").alias("df"),
        F.get(parts, F.lit(3)).cast("double").alias("ig"),
        F.get(parts, F.lit(4)).cast("double").alias("chi"),
        F.get(parts, F.lit(5)).cast("double").alias("score"),
    )
    head = F.split("value", ",")
    meta = lines.where(is_header).select(
        F.get(head, F.lit(0)).cast("long").alias("n"), F.get(head, F.lit(1)).cast("long").alias("max_id")
    )
    return terms, meta


def read_class_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(id, code, value)`` from a ``tf`` or ``chi`` file or folder, the value as text."""
    parts = F.split("value", " +")
    lines = spark.read.text(path).select(F.get(parts, F.lit(0)).cast("long").alias("id"), parts.alias("parts"))
    return lines.select("id", F.posexplode("parts").alias("code", "value")).where("code > 0")
