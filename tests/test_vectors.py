import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import Settings
from corpusloom.operators import counts, indexing, split, weights
from corpusloom.plans.vectorize import save_one_class_vectors, save_vectors, vectorize_corpus
from corpusloom.sources.vectors import read_libsvm, read_sparse

DICTIONARY = [(1, "ant", 9, 2.0), (4, "bee", 2, 1.0), (7, "cat", 50, 0.5)]
PAIRS = [("a", "bee ant ant cat zzz"), ("a", "!!!"), ("b", "zzz"), ("b", "cat cat"), ("b", "bee cat cat cat cat")]
ROOT2 = float(np.float32(math.sqrt(2.0)))


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "id long, term string, df long, score double")


def vectors(make_docs, dictionary, **options):
    rows = weights.document_vectors(counts.term_bags(make_docs(PAIRS)), dictionary, **options).collect()
    return {r["doc_id"]: [(f["id"], f["w"]) for f in r["features"]] for r in rows}


def test_training_scale(make_docs, dictionary):
    got = vectors(make_docs, dictionary)
    high, low = ROOT2 * 2.0, 0.5
    assert got[0] == [(1, 1.0), (4, pytest.approx((1.0 - low) / (high - low))), (7, 0.0)]
    assert got[3] == [(7, pytest.approx(ROOT2 * 0.5))]  # one known term stays raw
    assert got[4] == [(4, 1.0), (7, 1.0)]  # equal weights stay raw
    assert set(got) == {0, 3, 4}


def test_serving_scale_keeps_empty_documents(make_docs, dictionary):
    got = vectors(make_docs, dictionary, scale="max", keep_empty=True)
    high = ROOT2 * 2.0
    assert got[0] == [(1, 1.0), (4, pytest.approx(1.0 / high)), (7, pytest.approx(0.5 / high))]
    assert got[3] == [(7, 1.0)]
    assert got[1] == [] and got[2] == []


@pytest.mark.parametrize("limit", [0, 60, 100])
@pytest.mark.parametrize("keep_empty", [False, True])
def test_shuffled_lookup_equals_broadcast(make_docs, dictionary, limit, keep_empty):
    wide = vectors(make_docs, dictionary, keep_empty=keep_empty)
    assert vectors(make_docs, dictionary, keep_empty=keep_empty, max_broadcast_bytes=limit) == wide


@pytest.mark.parametrize("keep_empty", [False, True])
def test_broadcast_vectors_are_packed_without_a_shuffle(spark, make_docs, keep_empty):
    """Documents longer than a batch, without a known term, and with a null or empty text."""
    words = [f"w{i:03}" for i in range(300)]
    entries = spark.createDataFrame([(i + 1, w, 2, 1.0 + i) for i, w in enumerate(words)], "id long, term string, df long, score double")
    texts = [" ".join(words[i : i + n]) for i, n in ((0, 300), (5, 1), (0, 0), (7, 40), (3, 290))] + [None, "zzz aaa", words[0] + " zzz"]
    docs = make_docs([("a", t) for t in texts * 3]).repartition(2, "doc_id")
    bags = counts.term_bags(docs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        vectors = weights.document_vectors(bags, entries, "none", keep_empty)
        assert "HashAggregate" not in vectors._jdf.queryExecution().executedPlan().toString()
        got = {r.doc_id: [f.id for f in r.features] for r in vectors.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    known = {i: [int(w[1:]) + 1 for w in (t or "").split() if w in words] for i, t in enumerate(texts * 3)}
    assert got == {i: ids for i, ids in known.items() if ids or keep_empty}


def test_repeated_documents_share_a_vector(make_docs, dictionary):
    """As ever: rows of one id and label are one document."""
    bags = counts.term_bags(make_docs(PAIRS))
    once = weights.document_vectors(bags, dictionary, "none").collect()
    twice = weights.document_vectors(bags.unionAll(bags), dictionary, "none").collect()
    assert {r.doc_id: [f for f in r.features for _ in range(2)] for r in once} == {r.doc_id: r.features for r in twice}
    assert len(twice) == len(once)


def test_shuffled_lookup_spreads_hot_terms(spark, make_docs, dictionary):
    """A third of the documents hold one word the dictionary lacks, another third one it has."""
    docs = make_docs([("a", "zzz")] * 200 + [("a", "cat")] * 200 + [("b", f"bee ant u{i}") for i in range(200)])
    terms = counts.term_freq(counts.term_bags(docs))
    entries = dictionary.select("term", "id", "score")
    # AQE would join these few rows in one task.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        looked_up = weights._salted_lookup(terms, entries, 1000).withColumn("p", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(looked_up) == 1000
    assert (looked_up.term == "zzz").sum() == 200
    assert looked_up.id.notna().sum() == 600
    tasks = looked_up.groupby("term").p.nunique()
    assert tasks["zzz"] > 1 and tasks["cat"] > 1 and tasks["u1"] == 1


@pytest.mark.parametrize("fraction", [0.6, 0.0, 1.0, 0.34])
def test_split_equals_sorted_prefix(make_docs, fraction):
    pairs = [("big", "x")] * 70 + [("one", "y")] + [("mid", "z")] * 13
    got = split.train_test_split(make_docs(pairs), fraction).collect()
    assert len(got) == len(pairs)
    for label in ("big", "one", "mid"):
        rows = sorted((r["doc_id"], r["split"]) for r in got if r["label"] == label)
        head = int(len(rows) * fraction)
        assert [s for _, s in rows] == ["train"] * head + ["test"] * (len(rows) - head)


def test_rank_over_ties_and_many_partitions(spark):
    rows = [("a", float(i % 3), i) for i in range(500)] + [("b", 1.0, 1000)]
    frame = spark.createDataFrame(rows, "label string, score double, doc_id long").repartition(7)
    ranked = indexing.group_rank(frame, "label", ["score", "doc_id"], "r").collect()
    expected = {d: i for i, (_, d) in enumerate(sorted((s, d) for label, s, d in rows if label == "a"), 1)}
    assert {r["doc_id"]: r["r"] for r in ranked if r["label"] == "a"} == expected
    assert [r["r"] for r in ranked if r["label"] == "b"] == [1]


def test_sparse_files(spark, make_docs, dictionary, tmp_path):
    docs = make_docs(PAIRS)
    made = vectorize_corpus(docs, dictionary, Settings(train_fraction=0.5))
    save_vectors(made, ["a", "b"], str(tmp_path / "v"))
    train = read_sparse(spark, str(tmp_path / "v/split=train")).collect()
    test = read_sparse(spark, str(tmp_path / "v/split=test")).collect()
    # Class a: documents 0 | 1 (empty, left out); class b: 2 (unknown terms, left out) | 3, 4.
    assert [r["code"] for r in train] == [1] and sorted(r["code"] for r in test) == [2, 2]
    assert [(f["id"], round(f["w"], 6)) for f in train[0]["features"]][0] == (1, 1.0)
    assert len(train[0]["features"]) == 3
    loaded = read_libsvm(spark, str(tmp_path / "v/split=train"), 7).first()
    assert loaded["label"] == 1.0 and loaded["features"].size == 7
    save_one_class_vectors(made, str(tmp_path / "one"))
    assert spark.read.text(str(tmp_path / "one/label=b/split=test")).where(F.col("value").startswith("1 ")).count() == 2


@pytest.mark.parametrize("scale", ["minmax", "max", "none"])
@pytest.mark.parametrize("keep_empty", [False, True])
def test_a_document_is_looked_up_as_one_row(spark, make_docs, scale, keep_empty):
    """No row for each of its terms; the same vectors as by the shuffled lookup, also of a term that the dictionary has twice."""
    entries = spark.createDataFrame(
        [(1, "ant", 2.0), (4, "bee", 1.0), (9, "bee", 3.0), (7, "cat", -0.5), (8, None, 1.0), (None, "dog", 1.0), (10, "elk", None)],
        "id long, term string, score double",
    )
    bags = counts.term_bags(make_docs([*PAIRS, ("b", None), ("c", "dog elk bee"), ("c", "elk"), ("c", "cat")]))
    made = weights.document_vectors(bags, entries, scale, keep_empty)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    shuffled = weights.document_vectors(bags, entries, scale, keep_empty, max_broadcast_bytes=0)
    assert sorted(map(str, made.collect())) == sorted(map(str, shuffled.collect()))
    nothing = weights.document_vectors(bags, entries.where("false"), scale, keep_empty).collect()
    assert len(nothing) == (bags.count() if keep_empty else 0)


@pytest.mark.parametrize("keep_empty", [False, True])
def test_a_bundle_of_documents_asks_once_for_a_term(spark, make_docs, monkeypatch, keep_empty):
    """Shuffled lookup: a word of every document is asked for by each bundle and not by each document."""
    written, original = {}, weights.materialize
    monkeypatch.setattr(weights, "materialize", lambda df, name: written.setdefault(name, original(df, name)))
    monkeypatch.setattr(weights, "BUNDLED_ENTRIES", 100)
    words = [f"w{i:02}" for i in range(40)]
    entries = spark.createDataFrame([(i + 1, w, 1.0 + i) for i, w in enumerate(words)], "id long, term string, score double")
    texts = [f"w00 {words[i % 40]} w00 {words[i % 7]} u{i}" for i in range(400)] + [" ".join(words * 3), None, "", "zzz"]
    bags = counts.term_bags(make_docs([("a", t) for t in texts]).repartition(3, "doc_id"))
    shuffled = weights.document_vectors(bags, entries, "max", keep_empty, max_broadcast_bytes=0)
    wide = weights.document_vectors(bags, entries, "max", keep_empty)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, wide.collect()))
    bundles = written["bundles"].groupBy("_bundle").agg(F.count("*").alias("n"), F.sum(F.size("_codes")).alias("entries")).collect()
    assert 400 / 25 / 2 < len(bundles) < 400 / 15
    # A bound of entries and documents, or one document more.
    assert all(b.n + b.entries < 100 + 41 for b in bundles)
    # One bundle has the last texts only.
    assert written["looked-up"].where("term = 'w00'").count() == sum(b.entries > 1 for b in bundles)
    assert written["looked-up"].count() == written["looked-up"].select("_bundle", "term").distinct().count()


def test_bundles_of_repeated_rows_and_no_known_term(spark, make_docs, dictionary):
    bags = counts.term_bags(make_docs(PAIRS))
    twice = [weights.document_vectors(bags.unionAll(bags), dictionary, max_broadcast_bytes=b) for b in (0, 1 << 20)]
    assert len({str(sorted(map(str, v.collect()))) for v in twice}) == 1
    assert weights.document_vectors(bags.where("false"), dictionary, max_broadcast_bytes=0).count() == 0
    other = dictionary.select("id", F.concat(F.lit("no"), "term").alias("term"), "score")
    assert weights.document_vectors(bags, other, max_broadcast_bytes=0).count() == 0
    assert weights.document_vectors(bags, other, keep_empty=True, max_broadcast_bytes=0).count() == len(PAIRS)
