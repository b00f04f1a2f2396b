import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom import Settings
from corpusloom.operators import kernel, one_class
from corpusloom.plans import train
from corpusloom.plans.label import label_pages, multi_label_pages
from corpusloom.sources.pages import stream_pages
from corpusloom.streaming.pages import label_page_stream

WORDS = {c: [f"{c}{i}" for i in range(12)] for c in ("ant", "bee", "cat")}
SETTINGS = Settings(fourier_dims=128, max_iterations=30)


def sparse(rng, top):
    ids = np.sort(rng.choice(np.arange(1, top), size=rng.integers(0, 40), replace=False))
    return ids, rng.random(len(ids))


def test_kernel_features_approach_the_rbf_kernel():
    rng = np.random.default_rng(0)
    rows = [sparse(rng, 100) for _ in range(30)] + [(np.array([], dtype=int), np.array([]))]
    dense = np.zeros((len(rows), 100))
    for i, (ids, w) in enumerate(rows):
        dense[i, ids] = w
    z = kernel.fourier_rows(pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows]), 8192, 0.125, 42)
    exact = np.exp(-0.125 * ((dense[:, None] - dense[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.06
    assert np.allclose(np.diag(z @ z.T), 1.0)


def test_kernel_features_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [sparse(rng, 1000) for _ in range(50)]
    ids, w = pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows])
    whole = kernel.fourier_rows(ids, w, 64, 0.125, 7)
    monkeypatch.setattr(kernel, "BLOCK_FEATURES", 5)
    assert np.allclose(kernel.fourier_rows(ids, w, 64, 0.125, 7), whole)


def test_sums_do_not_depend_on_pieces_or_on_kept_ids(monkeypatch):
    """Sums are taken in small pieces; ids beyond the kept ones go to the rest of the table, also of a document longer than a block."""
    rng = np.random.default_rng(3)
    rows = [sparse(rng, 300) for _ in range(40)] + [(np.arange(1, 300), rng.random(299)), (np.array([], dtype=int), np.array([]))]
    ids, w = pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows])
    exact = np.stack([kernel.frequencies(i, 8, 0.5, 7).T @ x for i, x in rows])
    assert np.allclose(kernel.projections(ids, w, 8, 7), exact, rtol=0, atol=1e-12)
    for block, summed, kept, at_once in ((64, 7, 16, 5), (1000, 1, 0, 256), (5, 64, 300, 1)):
        for name, value in (("BLOCK_FEATURES", block), ("SUMMED_FEATURES", summed), ("KEPT_IDS", kept), ("DRAWN_IDS", at_once)):
            monkeypatch.setattr(kernel, name, value)
        assert np.allclose(kernel.projections(ids, w, 8, 7, kernel.Drawn(8, 7)), exact, rtol=0, atol=1e-12)


def test_frequencies_are_drawn_once_for_a_task(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [sparse(rng, 200) for _ in range(60)]
    ids, w = pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows])
    whole = kernel.projections(ids, w, 8, 7)
    asked, draw = [], kernel.frequencies
    monkeypatch.setattr(kernel, "frequencies", lambda ids, *more: (asked.extend(ids.tolist()), draw(ids, *more))[1])
    monkeypatch.setattr(kernel, "BLOCK_FEATURES", 50)
    for kept in (200, 20):
        monkeypatch.setattr(kernel, "KEPT_IDS", kept)
        asked.clear()
        drawn = kernel.Drawn(8, 7)
        parts = [kernel.projections(ids.iloc[i : i + 20], w.iloc[i : i + 20], 8, 7, drawn) for i in (0, 20, 40)]
        assert np.allclose(np.concatenate(parts), whole, rtol=0, atol=1e-12)
        assert (len(asked) == len(set(asked))) == (kept == 200) and len(drawn.ids) <= kept


def test_frequencies_are_normal():
    draws = kernel.frequencies(np.arange(1, 2001), 64, 0.5, 3)
    assert abs(draws.mean()) < 0.02 and abs(draws.std() - 1.0) < 0.02
    assert len(np.unique(draws)) > 0.999 * draws.size


@pytest.fixture(scope="module")
def docs(make_docs):
    rng = random.Random(3)
    pairs = []
    for _ in range(60):
        for c, words in WORDS.items():
            pairs.append((c, " ".join(rng.choices(words, k=8) + rng.choices(["the", "and", "of"], k=4))))
    return make_docs(pairs)


@pytest.fixture(scope="module")
def run(docs):
    return train.train_classifier(train.prepare(docs, SETTINGS), SETTINGS)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"{c}.example/{i}", f"<p>{' '.join(WORDS[c][:6])}</p>") for i, c in enumerate(("ant", "bee", "cat"))]
    return spark.createDataFrame(rows + [(3, "https://x", "<p>nothing known</p>")], "page_id long, url string, html string")


def test_classifier_learns(run):
    predictions = train.held_out_predictions(run)
    assert predictions.count() == 72
    assert predictions.where("label = prediction").count() >= 70


def test_saved_classifier_predicts_the_same(spark, run, pages, tmp_path):
    run.classifier.save(str(tmp_path / "c"))
    again = train.TextClassifier.load(spark, str(tmp_path / "c"))
    assert sorted(label_pages(pages, again).collect()) == sorted(label_pages(pages, run.classifier).collect())


def test_every_page_is_labelled(run, pages):
    for classifier in (run.classifier, train.with_serving_scale(run.classifier)):
        got = {r["page_id"]: r for r in label_pages(pages, classifier).collect()}
        assert [got[i]["prediction"] for i in range(3)] == ["ant", "bee", "cat"]
        assert got[0]["url"] == "http://ant.example/0" and got[3]["url"] == "https://x"
        assert got[3]["prediction"] in WORDS


def test_stream_equals_batch(spark, run, pages, tmp_path):
    pages.where("page_id < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    where = [str(tmp_path / x) for x in ("in", "out", "ck")]

    def drain():
        label_page_stream(stream_pages(spark, where[0]), run.classifier, where[1], where[2], once=True).awaitTermination()
        rows = spark.read.parquet(where[1]).select("page_id", "url", "prediction", "error").collect()
        return sorted(rows)

    batch = sorted(label_pages(pages, run.classifier).collect())
    assert drain() == batch[:2]
    pages.where("page_id >= 2").coalesce(1).write.mode("append").parquet(where[0])
    assert drain() == batch
    assert drain() == batch


def test_report_run(spark, docs, tmp_path):
    train.train_and_report(docs, SETTINGS, str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert len(lines) == 4 + 3 + 7


def test_one_class(spark, docs, pages, tmp_path):
    nus = (("ant", 0.1), ("bee", 1.0), ("cat", 0.3))
    settings = Settings(fourier_dims=128, categories=nus)
    made = train.prepare(docs, settings)
    vectors, labels = made.vectors, list(made.labels)
    # The default width 1 / max id makes all kernel values of this small corpus alike.
    models = one_class.fit_one_class(vectors.where("split = 'train'"), labels, settings, gamma=0.125)
    accepted = one_class.accepted_labels(vectors, models)
    own = one_class.own_class_accepted(accepted.where("split = 'train'"))
    refused = {r["label"]: r["n"] for r in own.where("NOT accepted").groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert refused["ant"] == int(0.1 * n["ant"]) and refused["bee"] == n["bee"] and refused["cat"] == int(0.3 * n["cat"])
    got = {r["page_id"]: r["labels"] for r in multi_label_pages(pages, made.dictionary, models).collect()}
    assert got[0] == ["ant"] and got[1] == ["unknown"]
    # The page without known words is the zero vector: cos 0 = 1 and sin 0 = 0 in every dimension.
    zero = np.concatenate([np.ones(64), np.zeros(64)]) / 8.0
    expected = [c for c, score, cut in zip(labels, models.means @ zero, models.cuts) if score >= cut]
    assert got[3] == (expected or ["unknown"])
    models.save(spark, str(tmp_path / "m"))
    again = one_class.OneClassModels.load(spark, str(tmp_path / "m"))
    assert sorted(one_class.accepted_labels(vectors, again).collect()) == sorted(accepted.collect())
    metrics = train.one_class_report(models, made, settings, str(tmp_path / "r"))
    assert {r["label"]: r["b"] for r in metrics.collect()} == {"ant": 24, "bee": 24, "cat": 24}


def test_one_class_scores_are_mean_kernel_values(docs):
    settings = Settings(fourier_dims=64)
    made = train.prepare(docs, settings)
    vectors, labels = made.vectors, list(made.labels)
    models = one_class.fit_one_class(vectors, labels, settings)
    own_top = vectors.select("label", F.explode("features").alias("f")).groupBy("label").agg(F.max("f.id").alias("top"))
    tops = {r["label"]: r["top"] for r in own_top.collect()}
    assert models.gammas == pytest.approx([1 / tops[label] for label in labels])
    at = labels.index("bee")
    rows = vectors.select("label", "features", models.scores(F.col("features")).alias("s")).toPandas()
    z = kernel.fourier_rows(
        rows["features"].map(lambda f: [x["id"] for x in f]), rows["features"].map(lambda f: [x["w"] for x in f]),
        64, models.gammas[at], settings.seed,
    )
    own = z[(rows["label"] == "bee").to_numpy()]
    assert np.allclose(np.vstack(rows["s"])[:, at], (z @ own.T).mean(axis=1))
