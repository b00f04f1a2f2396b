"""The pipeline's stages one by one, and the registered queries."""

import random

import corpus_pipeline as pipeline
import pytest

from __spark_entry__ import queries
from corpusloom.llm import simhash
from corpusloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    """The small documents with an emptied text, a text without letters and two exact copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*pipeline.COLUMNS)
    rows = [(-1, None, None, None, None), (-2, "12 34", "en", "s", 5), (-3, "", "en", None, 0)]
    copies = docs.orderBy("doc_id").limit(2).selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    return docs.unionByName(spark.createDataFrame(rows, SCHEMA)).unionByName(copies).cache()


def test_language_stage_rejects_only_texts_without_language(spark, documents, sf_dir):
    kept = pipeline.identify_language(spark, documents, sf_dir)
    assert kept.columns == list(pipeline.COLUMNS)
    assert {r.doc_id for r in documents.select("doc_id").subtract(kept.select("doc_id")).collect()} == {-1, -2, -3}


def test_simhash_stage_keeps_the_smallest_of_each_group(spark, documents, sf_dir):
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, documents, sf_dir).collect()}
    groups = {}
    for r in simhash.near_duplicates(documents).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    assert kept == {min(g) for g in groups.values()}
    assert not kept & {100001, 100002} and kept & {1, 2}


def test_simhash_stage_with_null_and_repeated_ids(spark, sf_dir, prose):
    a, b, c, d = (prose(i, 80) for i in range(4))
    rows = [(7, a), (7, b), (7, b), (9, a), (None, a), (None, c), (None, c), (None, d), (3, d), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], SCHEMA)
    kept = sorted((r.doc_id or 0, r.text or "") for r in pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    # One of each group: both texts of 7, the row without an id that has a text of its own, the smaller id of the others.
    assert kept == sorted([(7, a), (7, b), (0, c), (3, d), (4, "")])


def test_cutting_keeps_every_rows_own_text(spark, sf_dir, prose):
    long = prose(5, 30)
    rows = [(None, "B  B"), (None, "C"), (7, "one\ttwo"), (7, "three"), (8, long), (9, f"{long} end"), (None, f"start {long}")]
    docs = spark.createDataFrame([(i, t, "en", str(n), n) for n, (i, t) in enumerate(rows)], SCHEMA)
    kept = {r.source: (r.doc_id, r.text, r.n_chars) for r in pipeline.cut_repeats(spark, docs, sf_dir).collect()}
    assert {k: v[:2] for k, v in kept.items()} == {
        "0": (None, "B  B"), "1": (None, "C"), "2": (7, "one\ttwo"), "3": (7, "three"), "5": (9, "end"), "6": (None, f"start {long}")
    }
    assert kept["5"][2] == 3 and kept["6"][2] == 6


def test_stages_against_brute_force(spark, sf_dir, prose):
    """Stages 2 to 4 over texts that share lines, held against plain loops."""
    rng, lines = random.Random(8), [prose(100 + i, 25) for i in range(12)]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    texts = ["\n".join(rng.sample(lines, rng.randint(1, 3)) + [prose(900 + i, 40)]) for i in range(30)]
    texts += [texts[3], texts[3], f"{prose(77, 9)} {item}", prose(5, 6)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    prints = [simhash.simhash(t.encode(), 4, 42) for t in texts]
    groups = list(range(len(texts)))
    for _ in groups:
        for i in groups:
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    groups[i] = groups[j] = min(groups[i], groups[j])
    left = [i for i in range(len(texts)) if groups[i] == i]
    seen, cut = set(), {}
    for i in left:
        words = texts[i].split()
        gone = set()
        for at in range(len(words) - 19):
            window = tuple(words[at : at + 20])
            if window in seen:
                gone.update(range(at, at + 20))
            seen.add(window)
        cut[i] = " ".join(w for k, w in enumerate(words) if k not in gone) if gone else texts[i]
    expected = {i: t for i, t in cut.items() if t}
    for name, stage in pipeline.STAGES[1:3]:
        docs = stage(spark, docs, sf_dir)
    assert {r.doc_id: r.text for r in docs.collect()} == expected
    clean = dict(pipeline.STAGES)["decontamination"](spark, docs, sf_dir)
    assert {r.doc_id for r in clean.collect()} == {i for i, t in expected.items() if item not in t}


def test_repeat_and_benchmark_stages(spark, sf_dir, prose):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a, "en", "s", len(a)), (2, f"{b}\n{a}", "en", "s", 0), (3, a, "en", "s", 0), (4, f"{prose(3, 9)} {item}", None, None, None), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    cut = {r.doc_id: r for r in pipeline.cut_repeats(spark, docs, sf_dir).collect()}
    assert set(cut) == {1, 2, 4} and cut[1].text == a and cut[2].text == b and cut[2].n_chars == len(b)
    clean = pipeline.decontaminate_documents(spark, docs, sf_dir)
    assert {r.doc_id for r in clean.collect()} == {1, 2, 3, 5} and clean.columns == list(pipeline.COLUMNS)


def test_stages_take_empty_tables(spark, sf_dir):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run_packs_every_word_once(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).toPandas()
    assert len(rows) > 100 and rows.bin_id.notna().all()
    assert not rows.duplicated(["doc_id", "piece"]).any()


def test_queries_are_registered():
    assert len(QUERIES) == 13 and {*QUERIES, "pipeline"} <= set(queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
