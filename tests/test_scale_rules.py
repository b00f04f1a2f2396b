"""Filtered lookups, bounded files, the bound on categories, and the split by hash."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import counts, split, term_filter, weights
from corpusloom.plans.dictionary import score_corpus
from corpusloom.plans.vectorize import vectorize_corpus
from corpusloom.settings import Settings
from corpusloom.sources import categories
from corpusloom.sources.vectors import read_sparse, write_sparse


def test_filter_loses_no_term_and_drops_most_others(spark):
    known = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("term"))
    rows = known.unionAll(spark.range(20_000).select(F.concat(F.lit("u"), "id"))).withColumn("n", F.length("term"))
    blocks = term_filter.block_count(20_000, 1 << 20)
    assert blocks == 10
    found = term_filter.build_filter(known, blocks)
    passed = term_filter.maybe_among(rows, found, blocks, F.lit(False))
    got = [r.term for r in passed.collect()]
    assert passed.columns == ["term", "n"]
    assert sum(t.startswith("k") for t in got) == 20_000
    assert 0 < sum(t.startswith("u") for t in got) < 600
    # Only the filter's own bits are shuffled.
    assert "ENSURE_REQUIREMENTS" not in rows._jdf.queryExecution().toString()


def test_filter_size(spark):
    assert term_filter.block_count(0, 1 << 20) == 1
    assert term_filter.block_count(1000, 4095) == 0
    assert term_filter.block_count(1 << 20, 1 << 20) == 256
    assert term_filter.block_count(1 << 24, 1 << 20) == 0


def test_filter_of_nulls_and_of_nothing(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("", 3)], "term string, n int")
    nothing = term_filter.build_filter(rows.where("false"), 1)
    assert term_filter.maybe_among(rows, nothing, 1, F.lit(False)).count() == 0
    assert [r.n for r in term_filter.maybe_among(rows, nothing, 1, F.col("n") == 1).collect()] == [1]
    all_of_them = term_filter.build_filter(rows, 1)
    assert sorted(r.n for r in term_filter.maybe_among(rows, all_of_them, 1, F.lit(False)).collect()) == [2, 3]


@pytest.mark.parametrize("keep_empty", [False, True])
def test_only_rows_that_may_be_known_reach_the_shuffled_lookup(spark, make_docs, monkeypatch, keep_empty):
    """Dictionary of 3000 terms, documents mostly of others; the written rows are what is shuffled."""
    entries = spark.range(1, 3001).select(F.concat(F.lit("k"), "id").alias("term"), "id", F.lit(1.5).alias("score"))
    dice = random.Random(5)
    docs = make_docs([("a", " ".join([f"u{dice.randrange(10**6)}" for _ in range(40)] + [f"k{i}"] * (i % 2))) for i in range(1, 200)])
    bags = counts.term_bags(docs)
    written, original = {}, weights.materialize
    monkeypatch.setattr(weights, "materialize", lambda df, name: written.setdefault(name, original(df, name)))
    result = weights.document_vectors(bags, entries, keep_empty=keep_empty, max_broadcast_bytes=20_000)
    wide = weights.document_vectors(bags, entries, keep_empty=keep_empty)
    assert sorted(map(str, result.collect())) == sorted(map(str, wide.collect()))
    moved = written["looked-up"].count()
    assert 100 <= moved < 100 + 199 * 40 * 0.05 + (199 if keep_empty else 0)


def test_files_follow_size_and_not_tasks(spark, tmp_path):
    vectors = spark.range(4000, numPartitions=40).select(
        F.concat(F.lit("c"), F.col("id") % 6).alias("label"),
        F.when(F.col("id") % 3 == 0, "train").otherwise("test").alias("split"),
        F.lit(1).alias("code"),
        F.array(F.struct((F.col("id") + 1).alias("id"), F.lit(0.5).alias("w"))).alias("features"),
    )
    write_sparse(vectors, str(tmp_path / "v"), "label", "split")
    folders = list((tmp_path / "v").glob("label=*/split=*"))
    assert len(folders) == 8 or len(folders) == 6
    assert len(list((tmp_path / "v").glob("*/*/*.txt"))) == len(folders)
    assert read_sparse(spark, str(tmp_path / "v"), "label", "split").count() == 4000


def test_a_hot_folder_is_many_files(spark, tmp_path):
    vectors = spark.range(60_000, numPartitions=20).select(
        F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("label"), F.lit(1).alias("code"),
        F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.struct(i.alias("id"), (F.rand(3) + i).alias("w"))).alias("features"),
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "2m")
    try:
        write_sparse(vectors, str(tmp_path / "h"), "label")
    finally:
        spark.conf.unset(size)
    assert 2 <= len(list((tmp_path / "h/label=hot").glob("*.txt"))) <= 20
    assert len(list((tmp_path / "h/label=rare").glob("*.txt"))) <= 2
    assert read_sparse(spark, str(tmp_path / "h"), "label").count() == 60_000


def test_ten_thousand_categories_score(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.format_string("c%05d \"'\\", F.col("id") % 10_000).alias("label"),
        F.when(F.col("id") % 10_000 < 3, F.lit("odd both")).otherwise(F.lit("both")).alias("text"),
    )
    scored, totals = score_corpus(docs, Settings())
    assert len(totals.labels) == 10_000 and set(totals.n_docs) == {2}
    rows = {r.term: r for r in scored.collect()}
    assert rows["odd"].df == 6 and rows["both"].df == 20_000
    # Three classes of two documents hold "odd", each with the same chi-square: N (ad - bc)^2 / ...
    n, a, b, c, d = 20_000, 2, 4, 0, 19_994
    x = n * (a * d - b * c) ** 2 / ((a + b) * (a + c) * (b + d) * (c + d))
    a, b, c, d = 0, 6, 2, 19_992
    y = n * (a * d - b * c) ** 2 / ((a + b) * (a + c) * (b + d) * (c + d))
    mean = (3 * x + 9_997 * y) / 10_000
    spread = ((3 * (x - mean) ** 2 + 9_997 * (y - mean) ** 2) / 10_000) ** 0.5
    assert rows["odd"].chi == pytest.approx(spread, rel=1e-9)


def test_too_many_labels_fail_with_a_message(spark, monkeypatch):
    monkeypatch.setattr(categories, "MAX_CATEGORIES", 50)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("label"), F.lit("x").alias("text"))
    with pytest.raises(Exception, match="more than 50 labels"):
        counts.CorpusTotals.of(counts.class_counts(docs))
    with pytest.raises(Exception, match="more than 50 labels"):
        categories.categories_from_labels(docs).collect()
    assert categories.categories_from_labels(docs.limit(50)).count() == 50


def test_split_by_hash_is_stable_and_about_the_share(spark, make_docs):
    docs = make_docs([("a", "x")] * 1500 + [("b", "y")] * 500)
    whole = {r.doc_id: r.split for r in split.hash_split(docs, 0.6).collect()}
    part = {r.doc_id: r.split for r in split.hash_split(docs.where("doc_id % 3 = 0"), 0.6).collect()}
    assert all(whole[d] == s for d, s in part.items())
    assert 0.56 < sum(s == "train" for s in whole.values()) / 2000 < 0.64
    assert {r.split for r in split.hash_split(docs, 0.0).collect()} == {"test"}
    assert {r.split for r in split.hash_split(docs, 1.0).collect()} == {"train"}


def test_vectors_take_the_split_by_hash(spark, make_docs):
    docs = make_docs([("a", "ant bee")] * 30 + [("b", "bee")] * 30)
    dictionary = spark.createDataFrame([(1, "ant", 1.0), (2, "bee", 1.0)], "id long, term string, score double")
    made = vectorize_corpus(docs, dictionary, Settings(split_by_hash=True))
    expected = {r.doc_id: r.split for r in split.hash_split(docs).collect()}
    assert {r.doc_id: r.split for r in made.collect()} == expected
