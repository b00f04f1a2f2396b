"""Counts by term and category in one shuffle, scores of many terms at once, and draws that a worker keeps."""

import random
from collections import Counter

import pytest

from corpusloom import Settings
from corpusloom.operators import counts, kernel
from corpusloom.plans.dictionary import candidate_profiles


def corpus(labels, size=90):
    dice = random.Random(len(labels))
    pairs = [(dice.choice(labels), " ".join(dice.choices([f"w{i}" for i in range(40)] + ["É", "é"], k=dice.randrange(0, 15)))) for _ in range(size)]
    return [*pairs, (labels[0], None), (labels[-1], ""), (labels[0], "!!!"), *[(labels[0], "w1 w1 copy")] * 20]


def rows_of(profiles):
    return {r.term: (r.df, {k: (v.a, v.tf) for k, v in r.by_label.items()}) for r in profiles.collect()}


@pytest.mark.parametrize("many", [1, 4, 8, 9, 21])
@pytest.mark.parametrize("as_bags", [False, True])
def test_profiles_equal_counts_by_hand(make_docs, monkeypatch, many, as_bags):
    """Null and empty texts, repeated documents, and documents beyond what is counted at once."""
    monkeypatch.setattr(counts, "COUNTED_TOKENS", 7)
    labels = [f"c{i} 'x" for i in range(many)]
    pairs = corpus(labels)
    docs = make_docs(pairs).repartition(3, "doc_id")
    expected = {}
    for label, text in pairs:
        for term, tf in Counter((text or "").replace("!", " ").lower().split()).items():
            df, by_label = expected.get(term, (0, {}))
            a, sums = by_label.get(label, (0, 0))
            expected[term] = (df + 1, {**by_label, label: (a + 1, sums + tf)})
    assert rows_of(counts.profiles(counts.term_bags(docs) if as_bags else docs, [*labels, "none"][: max(many, 1)])) == expected


@pytest.mark.parametrize("many", [3, 21])
def test_counts_by_term_and_category_meet_in_one_shuffle(make_docs, many):
    docs = make_docs(corpus([f"c{i:02}" for i in range(many)]))
    profiles, _ = candidate_profiles(docs, Settings())
    plan = profiles._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_worker_draws_frequencies_once_for_all_tasks():
    assert kernel.kept_draws(8, 7) is kernel.kept_draws(8, 7)
    assert kernel.kept_draws(8, 7) is not kernel.kept_draws(8, 9)
