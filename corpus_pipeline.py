"""From raw documents to packed training sequences, stage by stage.

Every stage reads the documents its predecessor kept. All but the last return
the columns of ``documents``; rows whose text changes get a new ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, langid, packing, simhash, substring
from corpusloom.session import remove_path, run_tables, shared_path
from corpusloom.settings import MAX_BROADCAST_BYTES

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Texts further from every profile than any known language is from another are in none of them.
LEAST_SCORE = 0.25
# What a row to drop takes in a broadcast table, and more.
KEY_BYTES = 64


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts of no known language: null, without a letter, or unlike every profile.

    Profiles are learned from the labelled documents that are not held out.
    """
    docs = docs.select(*COLUMNS)
    profiles = langid.learn_profiles(docs.where(~langid.held_out()), "text", "lang")
    found = langid.predict_languages(docs, profiles)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group: its smallest id, and of rows with that id the one with the smallest text hash.

    Rows without an id come after all others, so one of them stays only where
    no row of its group has an id. Rows that share an id but not their group are
    different documents; a row that is there twice stays once. Only the rows to
    drop are written down; texts are joined with them once, and move only if
    there are too many to broadcast.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))
    keyed = docs.select(*COLUMNS, key.alias("key"))
    path = shared_path(spark, "decided")
    with run_tables(spark, "simhash"):
        groups = simhash.near_duplicates(keyed, id_col="key")
        counted = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("component_id").alias("least"))
        counted.select("key", (F.col("key") == F.col("least")).alias("stays"), "n").where("n > 1 OR NOT stays").write.parquet(path)
    decided = spark.read.schema(f"key {keyed.schema['key'].dataType.simpleString()}, stays boolean, n long").parquet(path)
    if decided.count() * KEY_BYTES <= MAX_BROADCAST_BYTES:
        decided = F.broadcast(decided)
    alone = keyed.join(decided, "key", "left_anti")
    # Rows that are there several times and whose first one stays.
    again = keyed.join(decided.where("stays"), "key", "left_semi").dropDuplicates(["key"])
    return alone.unionByName(again).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut windows of 20 words that an earlier document or place holds; texts left empty go.

    A text without a repeat stays as it is. All columns go through the operator
    with their row, so rows without an id, or with an id in common, keep their own text.
    """
    cut = substring.remove_repeats(docs, carry=("lang", "source", "n_chars"), as_written=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.where("kept <> ''").select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_passages(docs.select(*COLUMNS), benchmark)
    return found.where(F.size("passages") == 0).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in training sequences.

    Pieces of equal length are placed in the order of their documents' ids;
    null ids come first, and rows that share an id are pieced row by row.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminate_documents),
    ("packing", pack_sequences),
]

# Profiles, SimHash components and alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next.

    What a stage wrote for itself is removed when its result is written, and its
    input when the next stage has no more use for it.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with run_tables(spark, name):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            remove_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
