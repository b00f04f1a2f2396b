"""Scores against a brute-force pass over the documents for every term."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from corpusloom import Settings
from corpusloom.operators import counts, selection
from corpusloom.plans.dictionary import build_dictionary, score_corpus

KEEP_ALL = Settings(score_threshold=-1e9)


def brute_force(pairs, labels):
    """{term: (df, ig, [chi per class], chi dispersion)} by counting documents."""
    docs = [(label, set(re.findall(r"[^\W_]+", text.lower()))) for label, text in pairs]
    n = len(docs)
    log = lambda x: x * math.log2(x) if x else 0.0
    per_class = {c: sum(label == c for label, _ in docs) for c in labels}
    entropy = sum(log(per_class[c] / n) for c in labels)
    out = {}
    for term in {t for _, terms in docs for t in terms}:
        df = sum(term in terms for _, terms in docs)
        if df < 2 or len(term) < 2:
            continue
        held = {c: sum(term in terms for label, terms in docs if label == c) for c in labels}
        ig = -entropy
        ig += df / n * sum(log(held[c] / n) for c in labels)
        ig += (n - df) / n * sum(log((per_class[c] - held[c]) / n) for c in labels)
        chis = []
        for c in labels:
            a, b = held[c], df - held[c]
            cc, d = per_class[c] - a, n - per_class[c] - b
            top, bottom = n * (a * d - cc * b) ** 2, (a + b) * (a + cc) * (b + d) * (cc + d)
            chis.append(top / bottom if top > 0 and bottom > 0 else 0.0)
        out[term] = (df, ig, chis, statistics.pstdev(chis))
    return out


def random_corpus(seed, labels, size):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(30)] + ["x", "é"]
    pairs = [(rng.choice(labels), " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for _ in range(size)]
    # One label holds a third of the rows with one and the same text.
    return pairs + [(labels[0], "w1 w2 w2 copy")] * (size // 2)


@pytest.mark.parametrize("labels", [["a", "b", "c"], ["a", "b"], ["a"], [f"k{i:02d}" for i in range(33)]])
def test_scores_equal_brute_force(make_docs, labels):
    pairs = random_corpus(len(labels), labels, 120)
    settings = Settings(categories=tuple((c, 1.0) for c in labels))
    scored, totals = score_corpus(make_docs(pairs), settings)
    rows = {r["term"]: r for r in selection.class_arrays(scored, totals).collect()}
    expected = brute_force(pairs, labels)
    assert set(rows) == set(expected)
    for term, (df, ig, chis, chi) in expected.items():
        row = rows[term]
        assert row["df"] == df
        assert row["ig"] == pytest.approx(ig, abs=1e-12)
        assert row["class_chi"] == pytest.approx(chis, abs=1e-9)
        assert row["chi"] == pytest.approx(chi, abs=1e-9)
        assert row["score"] == pytest.approx(ig * chi, abs=1e-9)
    if len(labels) <= 2:
        assert all(r["chi"] == 0.0 for r in rows.values())


def test_two_by_two_table(make_docs):
    docs = make_docs([("a", "mark one"), ("a", "mark two"), ("b", "one"), ("b", "two")])
    scored, totals = score_corpus(docs, Settings())
    row = selection.class_arrays(scored, totals).where("term = 'mark'").first()
    assert row["class_chi"] == [4.0, 4.0]
    assert row["chi"] == 0.0


def test_counts_add_up(make_docs):
    pairs = random_corpus(5, ["a", "b", "c"], 60)
    docs = make_docs(pairs)
    bags = counts.term_bags(docs)
    cells = {r["term"]: r["a"] for r in counts.label_term_counts(bags).groupBy("term").agg(F.sum("a").alias("a")).collect()}
    assert cells == {r["term"]: r["df"] for r in counts.doc_freq(bags).collect()}
    assert counts.CorpusTotals.of(counts.class_counts(docs)).n == len(pairs)


def test_empty_category_and_foreign_label(make_docs):
    named = [("a", "red red"), ("a", "red"), ("b", "blue"), ("b", "blue red")]
    docs = make_docs(named + [("foreign", "red blue"), (None, "red")])
    classes = counts.class_counts(docs, ["b", "none", "a"]).orderBy("code").collect()
    assert [(r["code"], r["label"], r["n_docs"]) for r in classes] == [(1, "b", 2), (2, "none", 0), (3, "a", 2)]
    run = build_dictionary(docs, Settings(categories=(("b", 1.0), ("none", 1.0), ("a", 1.0)), score_threshold=0.0))
    rows = {r["term"]: r for r in run.with_class_arrays().collect()}
    assert rows["red"]["class_tf"] == [1, 0, 3]
    assert rows["red"]["class_chi"][1] == 0.0
    assert (rows["red"]["df"], run.meta.first()["n"]) == (3, 4)


@pytest.mark.parametrize("categories", [(), (("a", 1.0), ("b", 1.0))])
def test_empty_corpus(spark, categories):
    docs = spark.createDataFrame([], "doc_id long, label string, text string")
    run = build_dictionary(docs, Settings(categories=categories))
    assert run.with_class_arrays().count() == 0
    assert tuple(run.meta.first()) == (0, 0)


def test_ids_are_dense_in_term_order_before_pruning(make_docs):
    run = build_dictionary(make_docs(random_corpus(9, ["a", "b", "c"], 80)), KEEP_ALL)
    rows = run.dictionary.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["term"] for r in rows] == sorted(r["term"] for r in rows)
    assert run.meta.first()["max_id"] == len(rows)


def test_threshold_keeps_equal_and_nan(spark):
    scores = spark.createDataFrame([(1, 0.01), (2, 0.00999), (3, float("nan"))], "id int, score double")
    assert [r["id"] for r in selection.select_terms(scores, 0.01).orderBy("id").collect()] == [1, 3]


def test_order_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0)], "id int, score double")
    assert [r["id"] for r in selection.order_terms(rows).collect()] == [2, 1, 3]
    assert [r["id"] for r in selection.order_terms(rows, 2).collect()] == [2, 1]


def test_no_cross_product_and_no_python_in_the_plans(make_docs):
    run = build_dictionary(make_docs(random_corpus(1, ["a", "b", "c"], 40)), Settings())
    for frame in (run.scored, run.with_class_arrays()):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        for word in ("Cartesian", "NestedLoop", "Python", "ArrowEval"):
            assert word not in plan
