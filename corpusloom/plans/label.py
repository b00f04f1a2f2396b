"""Run 4: pages -> category names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import html_to_text, term_bag, url_with_scheme
from corpusloom.operators import classifier, one_class, weights
from corpusloom.plans.train import TextClassifier
from corpusloom.settings import MAX_BROADCAST_BYTES


# Fixed value: what is said of a page that was not fetched.
NO_PAGE = "no html"


def page_bags(pages: DataFrame) -> DataFrame:
    """``(row, doc_id, url, error, bag)`` of a batch of pages; ``row`` tells repeated page rows apart."""
    return pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").alias("doc_id"),
        url_with_scheme(F.col("url")).alias("url"),
        F.when(F.col("html").isNull(), F.lit(NO_PAGE)).alias("error"),
        term_bag(html_to_text(F.col("html"))).alias("bag"),
    )


def page_rows(pages: DataFrame, dictionary: DataFrame, scale: str, max_broadcast_bytes: int) -> DataFrame:
    """``(doc_id, url, error, features)``, one row for every page row."""
    return weights.document_vectors(
        page_bags(pages),
        dictionary,
        scale,
        keep_empty=True,
        max_broadcast_bytes=max_broadcast_bytes,
        row_key="row",
    ).drop("row")


def page_vectors(pages: DataFrame, dictionary: DataFrame, scale: str, max_broadcast_bytes: int) -> DataFrame:
    """``(doc_id, url, features)``; a page without known terms keeps an empty vector."""
    return page_rows(pages, dictionary, scale, max_broadcast_bytes).drop("error")


def label_pages(pages: DataFrame, text_classifier: TextClassifier) -> DataFrame:
    """``(page_id, url, prediction, error)``, one row for every page row.

    A page without html has no prediction but an error.
    """
    vectors = page_rows(pages, text_classifier.dictionary, text_classifier.scale, text_classifier.max_broadcast_bytes)
    predicted = classifier.predict_labels(vectors, text_classifier.model, text_classifier.labels)
    return predicted.select(
        F.col("doc_id").alias("page_id"), "url", F.when(F.col("error").isNull(), F.col("prediction")).alias("prediction"), "error"
    )


def multi_label_pages(
    pages: DataFrame,
    dictionary: DataFrame,
    models: one_class.OneClassModels,
    scale: str = "minmax",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``(page_id, url, labels, error)``: every category that accepts the page, or ``unknown``.

    A page without html has no labels but an error.
    """
    accepted = one_class.accepted_labels(page_rows(pages, dictionary, scale, max_broadcast_bytes), models)
    return one_class.multi_labels(accepted).select(
        F.col("doc_id").alias("page_id"), "url", F.when(F.col("error").isNull(), F.col("labels")).alias("labels"), "error"
    )
