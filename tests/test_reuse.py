"""Texts are cut into tokens once per run, and read in as many tasks as asked for."""

import pytest

from corpusloom.functions import text
from corpusloom.operators import counts
from corpusloom.plans import train
from corpusloom.plans.dictionary import build_dictionary
from corpusloom.plans.vectorize import vectorize_corpus
from corpusloom.session import run_tables
from corpusloom.settings import Settings
from corpusloom.sources.corpus import corpus_from_table, deal_rows


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_a_table_of_one_row_group_is_read_in_the_tasks_asked_for(documents):
    docs = corpus_from_table(documents, "doc_id", "lang", "text", read_partitions=6)
    assert docs.rdd.getNumPartitions() == 6
    assert sorted(docs.collect()) == sorted(corpus_from_table(documents, "doc_id", "lang", "text").collect())
    counted = counts.label_term_counts(counts.term_bags(docs))
    assert "RoundRobin" not in counted._jdf.queryExecution().toString()


def test_a_scan_of_more_tasks_is_left_alone(spark):
    rows = spark.range(100, numPartitions=5)
    assert deal_rows(rows, "id", 5) is rows and deal_rows(rows, "id", None) is rows


def test_dictionary_and_vectors_are_the_same_from_bags(documents):
    docs, settings = corpus_from_table(documents, "doc_id", "lang", "text"), Settings(score_threshold=0.0)
    bags = counts.bag_table(docs)
    one, other = build_dictionary(docs, settings), build_dictionary(bags, settings)
    assert one.totals == other.totals
    assert sorted(one.dictionary.select("id", "term", "df", "score").collect()) == sorted(other.dictionary.select("id", "term", "df", "score").collect())
    vectors = (vectorize_corpus(d, one.dictionary, settings) for d in (docs, bags))
    assert len({tuple(sorted((r.doc_id, r.label, r.split, str(r.features)) for r in v.collect())) for v in vectors}) == 1


def test_prepare_cuts_each_text_into_tokens_once(documents, monkeypatch):
    """Only the plan that writes the bags holds the tokenizer, and the bags are gone afterwards."""
    made = []
    original = text.tokens
    monkeypatch.setattr(text, "tokens", lambda column: made.append(column) or original(column))
    docs = corpus_from_table(documents, "doc_id", "lang", "text")
    with run_tables(docs.sparkSession) as folder:
        prepared = train.prepare(docs, Settings(score_threshold=0.0))
        assert len(made) == 1 and prepared.vectors.count() > 0
        names = docs.sparkSession._jvm.java.io.File(folder).list()
        assert not [n for n in names if n.startswith("bags")]


def test_dealt_bags_have_one_exchange_and_equal_the_others(spark, sf_dir):
    from corpusloom.catalog import bags, dealt_bags

    dealt = dealt_bags(spark, sf_dir)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(str, dealt.collect())) == sorted(map(str, bags(spark, sf_dir).collect()))
