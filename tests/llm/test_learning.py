"""Whitening, hard negatives and language-model scores against brute force, and their odd cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import negatives, pitman_yor, restaurants, whitening
from corpusloom.llm.arrow import Texts
from corpusloom.llm.eigen import leading_pairs
from corpusloom.llm.words import find_words, word_hashes

VECTORS = "vec_id long, embedding array<double>, label int, n long"


# --- word values -----------------------------------------------------------


def thue_morse(bits, a, b):
    word = [a]
    for _ in range(bits):
        word += [b if x == a else a for x in word]
    return "".join(word)


def test_words_that_a_polynomial_confuses_have_values_of_their_own():
    words = [thue_morse(11, "a", "b"), thue_morse(11, "b", "a"), "a" * 8, "a" * 9, "a", "b" * 700, "b" * 701]
    data = " ".join(words + words).encode()
    texts = Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0)
    values = word_hashes(texts, find_words(texts))
    assert len(set(values.tolist())) == len(words) and (values[: len(words)] == values[len(words) :]).all()
    assert not set(values.tolist()) & set(word_hashes(texts, find_words(texts), seed=1).tolist())


# --- eigenpairs and whitening ----------------------------------------------


@pytest.mark.parametrize("spectrum", [[5.0, 3.0, 1.0, 0.5], [2.0, 2.0, 2.0, 1.0], [4.0, 4.0 - 1e-10, 1.0, 0.0], [1.0] * 4, [0.0] * 4])
def test_leading_pairs_of_known_spectra(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((12, 12)))
    full = np.sort(np.r_[spectrum, np.zeros(8)])[::-1]
    matrix = (q * full) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = leading_pairs(matrix, 5)
    assert np.abs(values - full[:5]).max() < 1e-13 and np.abs(vectors @ vectors.T - np.eye(5)).max() < 1e-12
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-13


def test_whitening_against_numpy(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = whitening.whiten(given).toPandas()
    table = given.toPandas()
    x = np.floor(1024 * np.stack(table.embedding).astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov((x - s / n).T, bias=True))
    expected = (x - s / n) @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    found = rows.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    sign = np.sign((found * expected).sum(axis=0))
    assert np.abs(found * sign - expected).max() < 1e-9
    first = rows[rows.component == 1].set_index("vec_id").loc[table.vec_id]
    assert (first.deviation.to_numpy() == ((n * x - s) ** 2).sum(axis=1)).all() and (rows.n == n).all()
    assert rows.identity_error.max() < 1e-9
    assert np.abs(rows[rows.vec_id == rows.vec_id.min()].sort_values("component").explained - values[::-1][:8] / values.sum()).max() < 1e-12


def test_whitening_leaves_out_what_cannot_be_fitted(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.0, 5.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1e30, 1.0]), (9, [7.0])]
    given = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], VECTORS)
    found = whitening.whiten(given).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in found) == sorted((i, c, 4) for i in (0, 1, 1, 2) for c in (1, 2))
    assert max(r.identity_error for r in found) < 1e-9
    assert whitening.whiten(given.limit(0)).count() == 0
    # Equal vectors have no direction.
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0, 0) for i in range(3)], VECTORS)).count() == 0


# --- hard negatives --------------------------------------------------------


def mined(rows, every):
    """Plain loops over all pairs."""
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for i, label, v in whole:
        if i % every:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in whole if j != i]
        ranked = sorted(scores, key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in ranked if s[2] == label][:5]:
            fit = [s for s in ranked if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
            out += [(i, p, rank, n, ps, ns) for rank, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("bundle, chunk", [(2048, 16384), (3, 20)])
def test_negatives_against_all_pairs(spark, bundle, chunk):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4, 6))
    rows = [(i, int(rng.integers(3)), [float(x) for x in centres[i % 4] + 0.3 * rng.standard_normal(6)]) for i in range(160)]
    # A vector that a third of all rows share, a zero vector, and equal scores all over.
    rows += [(200 + i, i % 3, [1.0, 0.0, 0.0, 0.5, 0.0, 0.0]) for i in range(80)] + [(300, 1, [0.0] * 6), (310, 2, [1.0] * 6)]
    given = spark.createDataFrame([(i, v, label, 0) for i, label, v in rows], VECTORS)
    found = negatives.mine(given, every=10, bundle=bundle, chunk=chunk, sample=16)
    assert sorted(tuple(r) for r in found.collect()) == mined(rows, 10)


def test_negatives_of_odd_rows(spark):
    nan = float("nan")
    good = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.9]), (2, 2, [0.7, 0.7]), (3, 2, [0.6, 0.8])]
    odd = [(None, 1, [1.0, 1.0]), (50, None, [1.0, 1.0]), (100, 1, None), (150, 1, [nan, 1.0]), (200, 1, [None, 1.0]), (250, 1, []), (300, 1, [1e30, 1.0]), (350, 1, [1.0])]
    given = spark.createDataFrame([(i, v, label, 0) for i, label, v in good + odd], VECTORS)
    assert sorted(tuple(r) for r in negatives.mine(given).collect()) == mined(good, 50)
    assert negatives.mine(given.limit(0)).count() == 0 and negatives.mine(given.where("vec_id = 1")).count() == 0
    # Repeated rows count as often as they occur.
    twice = negatives.mine(given.where("vec_id < 4").unionAll(given.where("vec_id = 2"))).collect()
    assert [r.negative_id for r in twice if r.positive_id == 1] == [2, 2, 3] or [r.negative_id for r in twice if r.positive_id == 1].count(2) == 2


# --- restaurants and scores ------------------------------------------------


def stirling(c, discount):
    row = {1: 1.0}
    for n in range(1, c):
        row = {t: row.get(t - 1, 0.0) + (n - discount * t) * row.get(t, 0.0) for t in range(1, n + 2)}
    return np.array([row[t] for t in range(1, c + 1)])


@pytest.mark.parametrize("weight", [0.1, 1.0, 6.0])
def test_gibbs_moves_keep_the_distribution_of_tables(weight):
    c, discount, rng = 7, 0.6, np.random.default_rng(5)
    exact = stirling(c, discount) * weight ** np.arange(1, c + 1)
    exact /= exact.sum()
    t = rng.choice(np.arange(1, c + 1), 40000, p=exact)
    moved = restaurants.reseat(np.full(len(t), c), t, np.full(len(t), weight), discount, 5, rng)
    assert np.abs(np.bincount(moved, minlength=c + 1)[1:] / len(t) - exact).max() < 0.012


def test_customers_sit_alone_as_stirling_numbers_say():
    for c, t in ((2, 2), (5, 3), (9, 1)):
        before, after = stirling(c - 1, 0.5), stirling(c, 0.5)
        expected = before[t - 2] / after[t - 1] if t > 1 else 0.0
        assert abs(restaurants.alone(np.array([c]), np.array([t]), 0.5)[0] - expected) < 1e-12
    edge = restaurants.alone(np.array([restaurants.TABULATED, restaurants.TABULATED + 1]), np.array([40, 40]), 0.75)
    assert abs(edge[0] / edge[1] - 1) < 0.02


@pytest.mark.parametrize("discount", [0.5, 0.7, 0.75])
def test_many_customers_sit_alone_as_stirling_numbers_say(discount):
    """Beyond the table, from two tables to one for nearly every customer, against the recurrence in logarithms."""
    c = 1500
    log_s = np.array([-np.inf, 0.0])
    for n in range(2, c + 1):
        t = np.arange(1, n + 1)
        stay = np.log(np.maximum(n - 1 - discount * t, 1e-300)) + np.append(log_s, -np.inf)[1:]
        new = np.logaddexp(log_s, stay)
        expected, log_s = np.exp(log_s - new), np.concatenate([[-np.inf], new])
    expected[0] = 0.0
    found = restaurants.alone(np.full(c, c), np.arange(1, c + 1), discount)
    assert np.abs(found - expected).max() < 1e-8 and found[0] == 0.0 and found[-1] == 1.0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def test_scores_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id: r for r in pitman_yor.score_documents(docs).collect()}
    counts = Counter()
    rows = [(r.doc_id, words_of(r.text)) for r in docs.collect()]
    for i, words in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(words)
    total, types = sum(counts.values()), len(counts)
    held = [0.0, 0.0]
    for i, words in rows:
        r = found[i]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), total)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and abs(r.base_score - base) < 1e-8 * abs(base)
        if r.held_out:
            held = [held[0] + r.base_score, held[1] + r.score]
    assert held[1] > held[0]


def test_probabilities_of_the_next_word_add_up_to_one(spark):
    """One document per possible next word, held against the same context."""
    texts = ["a b a c", "b a a", "c c b a", "a", "b c a b"] * 3
    learned = pitman_yor.learn(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    # After "a" comes a word, the end, or the unknown word: the chance of each is told by differences of scores.
    asked = spark.createDataFrame([(0, "a"), (1, "a a"), (2, "a b"), (3, "a c"), (4, "a zz"), (5, "c"), (6, "b"), (7, "zz"), (8, None), (8, "a"), (None, "b")], "doc_id long, text string")
    rows = pitman_yor.score_texts(asked, learned).collect()
    score = {r.doc_id: r.score for r in rows if r.doc_id != 8}
    assert len(rows) == 11 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    bucket = {r.doc_id: r for r in rows}
    assert bucket[4].n_known == 2 and bucket[4].n_tokens == 3
    model, shared = learned.state.collect(), pitman_yor.Shared(learned)
    total = 0.0
    code = int(learned.vocabulary.contexts(np.array([w for w, c in zip(learned.vocabulary.frequent, learned.vocabulary.codes) if c == 1], np.uint64))[0])
    for r in model:
        arrays = {k: np.frombuffer(r[k], pitman_yor.KINDS[k]) for k in ("words", "ctx", "n", "t_sum", "roots")}
        sizes = np.frombuffer(r["sizes"], "<i4") if r["sizes"] is not None else np.array([len(arrays["ctx"])])
        own = pitman_yor.Bucket(shared, arrays["words"], sizes, arrays["ctx"], arrays["n"], arrays["t_sum"], arrays["roots"])
        found, _ = own.score(arrays["words"], np.ones(len(arrays["words"]), int), np.full(len(arrays["words"]), code, np.uint16))
        total += (10**found).sum()
    unknown, _ = own.score(np.array([1], np.uint64), np.array([1]), np.array([code], np.uint16))
    assert abs(total + 10 ** unknown[0] - 1) < 1e-4
    assert score[4] < score[2]


def test_scores_of_hot_words_empty_tables_and_odd_rows(spark, prose, monkeypatch):
    texts = [(i, f"hot hot {prose(i, 30)} hot") for i in range(40)] + [(90, None), (91, ""), (None, "hot"), (92, "hot " * 4000), (92, "x" * 5000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, bucket string")
    plain = {(r.doc_id, r.n_tokens): r for r in pitman_yor.score_documents(docs).collect()}
    for name, value in (("HOT", 100), ("BUCKET", 64), ("FLUSH", 500), ("HELD", 8)):
        monkeypatch.setattr(pitman_yor, name, value)
    split = {(r.doc_id, r.n_tokens): r for r in pitman_yor.score_documents(docs).collect()}
    assert plain.keys() == split.keys() and len(plain) == len(texts)
    for key, r in plain.items():
        assert r.n_known == split[key].n_known and abs(r.base_score - split[key].base_score) < 1e-9
        assert abs(r.score - split[key].score) < 0.05 * abs(r.score) + 0.5
    assert plain[(90, 1)].n_tokens == 1 and not plain[(None, 2)].held_out
    assert pitman_yor.score_documents(docs.limit(0)).count() == 0
