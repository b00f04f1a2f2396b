"""Cases in which input was once lost or training stopped."""

import pytest
from pyspark.sql import functions as F

from corpusloom import Settings
from corpusloom.plans import train
from corpusloom.plans.label import label_pages, multi_label_pages
from corpusloom.settings import SHIPPED_CATEGORIES
from corpusloom.sources.corpus import read_corpus_directory
from corpusloom.sources.results import label_lines

WORDS = {c: [f"{c}{i}" for i in range(10)] for c in ("ant", "bee", "cat")}


def corpus(make_docs, classes):
    pairs = [(c, " ".join(WORDS[c][i % 5 : i % 5 + 5])) for i in range(20) for c in classes]
    return make_docs(pairs)


@pytest.mark.parametrize("names", [("none", "ant", "bee"), ("ant", "none", "bee"), ("ant", "bee", "none")])
def test_training_with_an_empty_category(make_docs, names):
    settings = Settings(categories=tuple((n, 0.1) for n in names), fourier_dims=32, max_iterations=10)
    run = train.train_classifier(train.prepare(corpus(make_docs, ("ant", "bee")), settings), settings)
    predicted = train.held_out_predictions(run)
    assert predicted.where("label = prediction").count() == predicted.count() == 16
    assert {r["label"] for r in train.evaluate(run).collect()} == set(names)


def test_training_on_shipped_categories_with_rows_in_one(make_docs, tmp_path):
    first = SHIPPED_CATEGORIES[0]
    name = first if isinstance(first, str) else first[0]
    names = [c if isinstance(c, str) else c[0] for c in SHIPPED_CATEGORIES]
    docs = corpus(make_docs, ("ant", "bee")).withColumn("label", F.when(F.col("label") == "ant", F.lit(name)))
    settings = Settings(categories=tuple((n, 0.1) for n in names), score_threshold=-1.0, fourier_dims=32, max_iterations=5)
    run = train.train_classifier(train.prepare(docs, settings), settings)
    assert {r["prediction"] for r in train.held_out_predictions(run).collect()} == {name}


def test_every_page_row_is_labelled_and_failures_are_named(spark, make_docs):
    settings = Settings(fourier_dims=32, max_iterations=10)
    prepared = train.prepare(corpus(make_docs, ("ant", "bee", "cat")), settings)
    run = train.train_classifier(prepared, settings)
    page = (1, "a.example", "<p>" + " ".join(WORDS["ant"][:5]) + "</p>")
    pages = spark.createDataFrame([page, page, (2, "b.example", None), (3, None, "")], "page_id long, url string, html string")
    rows = label_pages(pages, run.classifier).collect()
    assert sorted((r.page_id, r.prediction, r.error) for r in rows if r.page_id < 3) == [(1, "ant", None)] * 2 + [(2, None, "no html")]
    assert len(rows) == 4
    lines = [r.value for r in label_lines(label_pages(pages, run.classifier)).collect()]
    assert len(lines) == 4 and all(lines) and sum(line.endswith("no html") for line in lines) == 1
    models = train.train_one_class(prepared, settings)
    multi = multi_label_pages(pages, prepared.dictionary, models).collect()
    assert len(multi) == 4 and [r.labels for r in multi if r.error] == [None]


def test_empty_and_oddly_named_files_are_documents(spark, tmp_path):
    for name, text in {"a/x.txt": "one", "a/empty.txt": "", "a/_under": "two", "a/.dot": "three", "b{1,2}/y +%41.txt": "four", "b{1,2}/z": ""}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    found = read_corpus_directory(spark, str(tmp_path)).collect()
    assert sorted((r.label, r.text) for r in found) == [("a", ""), ("a", "one"), ("a", "three"), ("a", "two"), ("b{1,2}", ""), ("b{1,2}", "four")]
    assert len({r.doc_id for r in found}) == 6
    assert read_corpus_directory(spark, str(tmp_path), ["b{1,2}", "missing"]).count() == 2


def test_bags_are_made_without_a_shuffle(spark, sf_dir):
    from corpusloom.catalog import bags

    plan = bags(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
