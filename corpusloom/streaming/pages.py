"""Continuous page labelling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.weights import Lookup
from corpusloom.plans.label import label_pages
from corpusloom.plans.train import TextClassifier
from corpusloom.session import run_tables


def label_page_stream(
    pages: DataFrame, text_classifier: TextClassifier, out: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Label every micro-batch of ``pages`` with the batch plan into parquet under ``out``.

    A batch writes its own ``batch=<n>`` folder and overwrites it when replayed,
    so a restart after a lost driver or executor leaves no page twice. The
    dictionary is measured once, when the stream starts, and tables that a batch
    writes for itself are removed with it. ``once`` drains what is there and stops.
    """
    measured = replace(text_classifier, dictionary=Lookup.of(text_classifier.dictionary))

    def write(batch: DataFrame, number: int) -> None:
        with run_tables(batch.sparkSession, "page-batch"):
            label_pages(batch, measured).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
