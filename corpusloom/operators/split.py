"""Head/tail split inside every class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.indexing import value_at_rank


def split_points(docs: DataFrame, fraction: float = 0.6) -> DataFrame:
    """``(label, n, last_train)``: the id that ends the head of each class.

    ``last_train`` is null where the head is empty.
    """
    head = F.floor(F.col("n") * F.lit(float(fraction)))
    keys = docs.select("label", "doc_id")
    return value_at_rank(keys, "label", ["doc_id"], head, value="last_train")


def assign_split(docs: DataFrame, points: DataFrame) -> DataFrame:
    """Add ``split``. One point per class is broadcast; documents do not move."""
    is_train = F.coalesce(F.col("doc_id") <= F.col("last_train"), F.lit(False))
    return (
        docs.join(F.broadcast(points.select("label", "last_train")), "label", "left")
        .withColumn("split", F.when(is_train, F.lit("train")).otherwise(F.lit("test")))
        .select(*docs.columns, "split")
    )


def train_test_split(docs: DataFrame, fraction: float = 0.6) -> DataFrame:
    """The first ``int(n * fraction)`` documents of each class by id are for training."""
    return assign_split(docs, split_points(docs, fraction))


def hash_split(docs: DataFrame, fraction: float = 0.6) -> DataFrame:
    """Add ``split``: a document is for training if the hash of its label and id is below ``fraction``.

    The documented variant of the exact cut. Nothing is counted, sorted or
    shuffled, and a document keeps its side when others come or go; the head of
    a class has about, not exactly, that share of it.
    """
    digits = F.substring(F.md5(F.concat_ws(":", "label", "doc_id")), 1, 8)
    share = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 32))
    return docs.withColumn("split", F.when(share < fraction, F.lit("train")).otherwise(F.lit("test")))


def one_class_rows(vectors: DataFrame) -> DataFrame:
    """Rows as the one-class model of their own label takes them: all coded 1."""
    return vectors.withColumn("code", F.lit(1))
