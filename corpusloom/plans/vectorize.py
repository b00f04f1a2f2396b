"""Run 2: corpus and dictionary -> sparse vectors with a train/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusloom.operators import counts, split, weights
from corpusloom.operators.classifier import label_code
from corpusloom.settings import Settings
from corpusloom.sources.vectors import write_sparse


def vectorize_corpus(
    docs: DataFrame, dictionary: DataFrame, settings: Settings, scale: str = "minmax"
) -> DataFrame:
    """``(doc_id, label, split, features)``.

    The split counts all documents; those without a known term leave after it.
    """
    docs = counts.members(docs, settings.category_names)
    vectors = weights.document_vectors(
        counts.term_bags(docs), dictionary, scale, max_broadcast_bytes=settings.max_broadcast_bytes
    )
    if settings.split_by_hash:
        placed = split.hash_split(vectors, settings.train_fraction)
    else:
        placed = split.assign_split(vectors, split.split_points(docs, settings.train_fraction))
    return placed.select("doc_id", "label", "split", "features")


def save_vectors(vectors: DataFrame, labels: list[str], path: str) -> None:
    """``<path>/split=train`` and ``<path>/split=test`` in sparse text form, in one job."""
    write_sparse(vectors.withColumn("code", label_code(labels)), path, "split")


def save_one_class_vectors(vectors: DataFrame, path: str) -> None:
    """``<path>/label=<name>/split=<part>``, every row coded 1, in one job."""
    write_sparse(split.one_class_rows(vectors), path, "label", "split")
