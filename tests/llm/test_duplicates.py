"""SimHash groups, embedding groups, repeated windows and components against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import simhash, substring, vectors
from corpusloom.llm.components import connected_components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def components(nodes, edges):
    parent = {n: n for n in nodes}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 200), (200, 300)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = components({x for e in edges for x in e}, edges)
    assert {r.node: r.component for r in found} == {n: c for n, c in want.items() if n != c}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_simhash(text):
    words = bytes(text or "", "utf-8").lower().split()
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def simhash_rows(prose):
    base = prose(1, 300).split()
    rows = [(i, prose(i, 40 + i)) for i in range(40)]
    # A group of near copies larger than a part, copies, and texts without words.
    for i in range(70):
        rows.append((100 + i, " ".join(base[: 290 + i % 5] + [f"x{i}"] * (i % 3))))
    rows += [(200 + i, rows[3][1]) for i in range(5)]
    return rows + [(300, None), (301, ""), (302, " \n "), (303, "Ä one"), (304, "one two three"), (None, rows[4][1]), (3, rows[3][1])]


def test_simhash_equals_brute_force(spark, prose):
    rows = simhash_rows(prose)
    docs = spark.createDataFrame([(i, t, 7, "f", 1) for i, t in rows], "doc_id long, text string, fp int, fingerprint string, id int")
    found = simhash.near_duplicates(docs, limit=16).collect()
    prints = [slow_simhash(t) for _, t in rows]
    edges = [
        (i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4
    ]
    of_row = components(range(len(rows)), edges)
    least = {}
    for n, c in of_row.items():
        if rows[n][0] is not None:
            least[c] = min(least.get(c, rows[n][0]), rows[n][0])
    want = sorted((str(rows[n][0]), f"{prints[n]:016x}", least.get(c)) for n, c in of_row.items())
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == want
    # Without a word: fingerprint zero, one group.
    assert {r.component_id for r in found if r.fingerprint == "0" * 16} == {300}


def test_simhash_of_an_empty_table(empty_documents):
    assert simhash.near_duplicates(empty_documents).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(empty_documents).count() == 0


def test_pivot_differences_bound_distances():
    values = np.random.default_rng(1).integers(0, 2**64, size=200, dtype=np.uint64)
    near = values ^ np.uint64(0b1011)
    assert np.abs(simhash.pivot_table(values) - simhash.pivot_table(near)).max() <= 3
    masks = simhash.block_masks(4)
    assert len(masks) == 15
    rng = np.random.default_rng(2)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("limit", [8, 4096])
def test_embedding_groups_equal_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(60)]
    rows += [(100 + i, (centre + 0.08 * rng.standard_normal(16)).tolist()) for i in range(80)]
    rows += [(300 + i, rows[5][1]) for i in range(4)] + [(5, rows[5][1])]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None] * 8), (404, []), (405, [1.0, 0.0]), (406, [2.0, 0.0]), (407, [1e308] * 2), (None, [5.0, -5.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, links string")
    found = vectors.near_duplicates(frame, limit=limit).collect()

    def cosine(a, b):
        a, b = (np.array([np.nan if x is None else x for x in v or []], float) for v in (a, b))
        if len(a) != len(b) or not len(a) or not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
            return -1
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / np.sqrt((a @ a) * (b @ b))

    links = [(i, j) for i in range(len(rows)) for j in range(i) if cosine(rows[i][1], rows[j][1]) >= 0.9]
    of_row = components(range(len(rows)), links)
    count = np.bincount(np.array(links).ravel(), minlength=len(rows))
    ids = {}
    for n, c in of_row.items():
        if rows[n][0] is not None:
            ids[c] = min(ids.get(c, rows[n][0]), rows[n][0])
    want = sorted((str(rows[n][0]), int(count[n]), str(ids.get(c))) for n, c in of_row.items())
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in found)
    # These cosines lie far from the threshold, so that every pair is found.
    assert got == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    a = vectors.unit_rows(rng.standard_normal((2000, 64)))
    off = rng.standard_normal((2000, 64))
    off = vectors.unit_rows(off - (off * a).sum(1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * off
    together = (vectors.sign_keys(a, vectors.TABLES, vectors.SIGNS) == vectors.sign_keys(b, vectors.TABLES, vectors.SIGNS)).any(axis=1)
    assert together.mean() > 0.95


def slow_repeats(rows, window):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0))
    for n in order:
        words = bytes(rows[n][1] or "", "utf-8").split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = b" ".join(words[i : i + window])
            if seen.setdefault(key, (rows[n][0], i)) != (rows[n][0], i):
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        out.append((str(rows[n][0]), len(words), sum(gone), kept))
    return sorted(out)


@pytest.mark.parametrize("window, bits", [(20, 28), (5, 16), (6, 16)])
def test_repeated_windows_equal_brute_force(spark, prose, window, bits):
    shared = prose(50, 33)
    rows = [(i, f"{prose(i, 15 + i)} {shared if i % 3 else ''} {prose(i + 500, i)}") for i in range(40)]
    rows += [(100, shared), (101, f"{shared}\n{shared}"), (102, "a b " * 40), (103, None), (104, ""), (105, "é"), (None, shared), (-3, f"x {shared} y"), (100, shared)]
    docs = spark.createDataFrame([(i, t, "n", 3) for i, t in rows], "doc_id long, text string, firsts string, n_words int")
    found = substring.remove_repeats(docs, window=window, filter_bits=bits)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found.collect()) == slow_repeats(rows, window)


def test_repeats_with_text_ids_and_without_rows(spark, prose, empty_documents):
    text = prose(3, 40)
    docs = spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == {"a": 0, "b": 40}
    assert substring.remove_repeats(empty_documents).count() == 0
    assert substring.sha256("") == hashlib.sha256(b"").hexdigest()
    assert docs.select(F.sha2("text", 256)).first()[0] == substring.sha256(text)
