import pytest

from corpusloom import Settings
from corpusloom.operators import evaluation
from corpusloom.sources.categories import categories_from_names

PAIRS = [("a", "a"), ("a", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")]


@pytest.fixture(scope="module")
def metrics(spark):
    predictions = spark.createDataFrame(PAIRS, "label string, prediction string")
    names = categories_from_names(spark, ["a", "b", "c", "never"])
    return evaluation.class_metrics(evaluation.confusion(predictions, names))


def test_class_metrics(metrics):
    rows = {r["label"]: r for r in metrics.collect()}
    assert [rows["a"][x] for x in "abc"] == [2, 1, 1]
    assert [rows["b"][x] for x in "abc"] == [0, 2, 1]
    assert [rows["c"][x] for x in "abc"] == [1, 0, 1]
    assert rows["a"]["recall"] == pytest.approx(200 / 3) and rows["a"]["fscore"] == pytest.approx(2 / 3)
    assert (rows["b"]["recall"], rows["b"]["precision"], rows["b"]["fscore"]) == (0.0, 0.0, 0.0)
    assert (rows["never"]["recall"], rows["never"]["precision"], rows["never"]["fscore"]) == (0.0, 0.0, 0.0)
    assert [r["label"] for r in metrics.collect()] == ["a", "c", "b", "never"]


def test_overall_metrics(metrics):
    row = evaluation.overall_metrics(metrics).first()
    assert (row["total"], row["correct"], row["accuracy"]) == (6, 3, 0.5)
    assert row["mean_recall"] == pytest.approx((200 / 3 + 100) / 4)


def test_report(metrics):
    lines = [r["line"] for r in evaluation.report_lines(metrics, Settings(corpus_name="demo")).orderBy("ord").collect()]
    assert lines[1] == "CORPUS:DEMO"
    assert lines[4].split() == ["[a]", "66.666667", "66.666667", "0.666667", "2", "1", "1"]
    assert len(lines[4]) == 110
    assert lines[9].split() == ["ACCURACY:", "0.5", "total:6.0", "true:3.0", "false:3.0"]
    assert lines[-2].split() == ["COST:", "32.0"] and lines[-1].split() == ["GAMMA:", "0.125"]


def test_no_predictions(spark):
    none = spark.createDataFrame([], "label string, prediction string")
    metrics = evaluation.class_metrics(evaluation.confusion(none, categories_from_names(spark, ["a"])))
    assert evaluation.overall_metrics(metrics).first()["accuracy"] == 0.0
