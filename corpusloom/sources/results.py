"""Sinks for reports and labelled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import pad_right

# Column widths of a labelled-page line.
URL_WIDTH = 50
LABEL_WIDTH = 30


def append_report(lines: DataFrame, path: str) -> None:
    """Add a report after those already in ``path``."""
    lines.orderBy("ord").select(F.col("line").alias("value")).coalesce(1).write.mode("append").text(path)


def label_lines(labelled: DataFrame) -> DataFrame:
    """One padded ``url label`` line per page; a failed page has its error after the label's place."""
    url, label = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "prediction"))
    error = F.col("error") if "error" in labelled.columns else F.lit(None).cast("string")
    line = F.concat(pad_right(url, URL_WIDTH), pad_right(label, LABEL_WIDTH), F.coalesce(error, F.lit("")))
    return labelled.select(line.alias("value"))


def write_label_lines(labelled: DataFrame, path: str) -> None:
    label_lines(labelled).write.mode("overwrite").text(path)
