"""Labelled corpora as ``(doc_id, label, text)``. ``doc_id`` must be unique."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize


def corpus_from_table(
    table: DataFrame,
    doc_id: str | Column,
    label: str | Column,
    text: str | Column,
    categories: Sequence[str] | None = None,
    read_partitions: int | None = None,
) -> DataFrame:
    """Shape any table into a corpus; only the three columns reach the scan.

    With ``categories`` only their documents belong to the corpus, and the test
    is a literal list that is pushed into the scan. ``read_partitions`` is
    :attr:`Settings.read_partitions`.
    """

    def column(c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c

    label = column(label)
    member = label.isin(list(categories)) if categories else label.isNotNull()
    rows = table.where(member).select(
        column(doc_id).alias("doc_id"), label.alias("label"), column(text).alias("text")
    )
    return deal_rows(rows, "doc_id", read_partitions)


def deal_rows(rows: DataFrame, key: str, partitions: int | None) -> DataFrame:
    """Rows in ``partitions`` tasks by a unique ``key``, where the scan has fewer; more are left as they are."""
    if partitions is None or rows.rdd.getNumPartitions() >= partitions:
        return rows
    return rows.repartition(partitions, key)


# Files that Spark's readers leave out, read by one task.
FILES_A_TASK = 64
LISTED = "label string, path string, bytes long, hidden boolean"


def _place(spark: SparkSession, root: str) -> tuple[str, str]:
    """Scheme with host, and the path of ``root`` in it, as the session resolves it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}", uri.getPath().rstrip("/")


def list_files(spark: SparkSession, root: str, categories: Sequence[str] | None = None) -> DataFrame:
    """``(label, path, bytes, hidden)`` of every file of the category folders, one task per folder.

    ``hidden`` names begin with a dot or an underscore; Spark's readers leave
    them out, and files without a byte as well.
    """
    base, top = _place(spark, root)
    system, _ = fs.FileSystem.from_uri(f"{base}{top}")
    found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
    folders = [f.base_name for f in found if f.type == fs.FileType.Directory]
    labels = [(c,) for c in folders if categories is None or c in set(categories)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = fs.FileSystem.from_uri(f"{base}{top}")
        for batch in batches:
            for label in batch["label"]:
                files = [f for f in own.get_file_info(fs.FileSelector(f"{top}/{label}")) if f.type == fs.FileType.File]
                yield pd.DataFrame(
                    [(label, f"{base}{f.path}", f.size, f.base_name[0] in "._") for f in files],
                    columns=["label", "path", "bytes", "hidden"],
                )

    names = spark.createDataFrame(labels, "label string").repartition(max(1, len(labels)))
    return names.mapInPandas(run, LISTED)


def _read_skipped(files: DataFrame, base: str, top: str) -> DataFrame:
    """Texts of listed files that Spark's readers leave out, file by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = fs.FileSystem.from_uri(f"{base}{top}")
        for batch in batches:
            for label, path in zip(batch["label"], batch["path"]):
                with system.open_input_file(path.removeprefix(base)) as source:
                    text = source.read().decode("utf-8", "replace")
                yield pd.DataFrame({"doc_id": [path], "label": [label], "text": [text]})

    # A number of tasks by name: by bytes, a listing would be one task.
    tasks = max(1, -(-files.count() // FILES_A_TASK))
    return files.repartition(tasks, "path").mapInPandas(run, "doc_id string, label string, text string")


def read_corpus_directory(
    spark: SparkSession, root: str, categories: Sequence[str] | None = None
) -> DataFrame:
    """``<root>/<category>/<file>``, one document per file; the path is its id.

    Every file counts, empty ones and those whose name begins with a dot or an
    underscore included. With ``categories`` only their folders are read;
    missing and empty folders are legal, and any character may be in a name.
    """
    base, top = _place(spark, root)
    files = materialize(list_files(spark, root, categories), "listing")
    ordinary = (F.col("bytes") > 0) & ~F.col("hidden")
    labels = [r["label"] for r in files.where(ordinary).select("label").distinct().collect()]  # one row per category
    skipped = _read_skipped(files.where(~ordinary), base, top)
    if not labels:
        return skipped
    folders = [f"{base}{_no_glob(top)}/{_no_glob(label)}/*" for label in labels]
    # _metadata paths are url-encoded; a plus sign there is a plus sign.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    texts = spark.read.text(folders, wholetext=True).select(
        path.alias("doc_id"), F.element_at(F.split(path, "/"), -2).alias("label"), F.col("value").alias("text")
    )
    return texts.unionByName(skipped)


def _no_glob(name: str) -> str:
    return re.sub(r"([\\{}\[\]*?^,])", r"\\\1", name)
