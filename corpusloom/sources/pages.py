"""Pages to be labelled, as ``(page_id, url, html)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import is_folder

PAGE_SCHEMA = "page_id long, url string, html string"


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One url or host per line."""
    return spark.read.text(path).select(F.col("value").alias("url"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def stream_pages(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """New page files of a folder, as a stream."""
    return spark.readStream.schema(PAGE_SCHEMA).option("pathGlobFilter", glob).parquet(folder)


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """The files of a page table as a stream; a table is a folder of files or one file, in any store that Spark reads."""
    if is_folder(spark, path):
        return stream_pages(spark, path, "*")
    folder, _, name = path.rstrip("/").rpartition("/")
    return stream_pages(spark, folder, name)
