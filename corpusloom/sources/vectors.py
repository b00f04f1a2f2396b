"""Sparse document vectors in LIBSVM files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sparse_lines(vectors: DataFrame, *keys: str) -> DataFrame:
    """``code id:weight id:weight ..`` lines from ``code`` and ``features``, next to ``keys``."""
    pairs = F.transform("features", lambda f: F.concat_ws(":", f["id"], f["w"]))
    return vectors.select(*keys, F.concat_ws(" ", "code", F.array_join(pairs, " ")).alias("value"))


def write_sparse(vectors: DataFrame, path: str, *keys: str) -> None:
    """Write the lines, one folder per value of ``keys``; any LIBSVM reader takes them.

    Zero weights are written too, as they are part of a training vector. The
    lines of a folder are brought together and cut where they exceed
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, so the number of files
    follows the size of a folder and not the number of tasks that made its lines.
    """
    lines = sparse_lines(vectors, *keys)
    if keys:
        lines = lines.hint("rebalance", *(F.col(key) for key in keys))
    lines.write.mode("overwrite").partitionBy(*keys).text(path)


def read_sparse(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Back to ``(<keys>, code, features)``, zero weights kept, ids as written."""
    parts = F.filter(F.split("value", r"\s+"), lambda p: p != "")
    pair = lambda p: F.split(p, ":")
    # Named, a key stays text: the name of a category may look like a number.
    schema = ", ".join(f"`{name}` string" for name in ("value", *keys))
    return spark.read.schema(schema).text(path).select(
        *keys,
        F.get(parts, F.lit(0)).cast("double").cast("int").alias("code"),
        F.transform(
            F.slice(parts, F.lit(2), F.size(parts)),
            lambda p: F.struct(
                F.get(pair(p), F.lit(0)).cast("long").alias("id"),
                F.get(pair(p), F.lit(1)).cast("double").alias("w"),
            ),
        ).alias("features"),
    )


def read_libsvm(spark: SparkSession, path: str, max_id: int | None = None) -> DataFrame:
    """The same files through Spark's reader: ``(label, features)`` VectorUDT."""
    reader = spark.read.format("libsvm")
    if max_id is not None:
        reader = reader.option("numFeatures", str(max_id))
    return reader.load(path)

