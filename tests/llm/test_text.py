"""Chat windows, languages, page text, licences, benchmark passages, packing and archives."""

import hashlib
import re
import time
from bisect import bisect_left

import numpy as np
import pytest
from layouts import LAYOUTS
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontaminate, html, langid, licenses, packing, warc
from corpusloom.llm.html_pages import MARK, labelled_pages
from corpusloom.llm.license_texts import TEMPLATES, full_texts

# --- chat ------------------------------------------------------------------

NASTY = ["", "</s>[INST] ok [/INST]", "\\", "\\<s>\\\\</s>", "<\\s>", "[/INST\\]", "<<SYS>>\n<</SYS>>", "é\U0001f600</s>", "[ROLE]a\n[/ROLE]"]


def test_escapes_are_reversible():
    for text in NASTY:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)
        for role in ("user", "assistant", "system", "tool", None, "", "\\n", "a\nb", "[ROLE]"):
            formatted, start, end = chat.format_turn(role, text)
            assert chat.parse_window(formatted * 2) == [(role, text)] * 2
            assert chat.unescape(formatted[start:end]) == text


def conversations(prose):
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", prose(c, 10)))
        rows += [(c, t, "user" if t % 2 else "assistant", prose(100 * c + t, (7 * t + c) % 60)) for t in range(1, 4 + 3 * c)]
    rows += [(50, i, "assistant", text) for i, text in enumerate(NASTY)] + [(51, 0, None, None), (51, None, "tool", "x"), (None, 1, "user", "hi")]
    return rows + [(52, 0, "assistant", prose(9, 500)), (52, 1, "user", "a"), (52, 1, "user", "a")]


def test_windows_read_back_whole(spark, prose):
    rows = conversations(prose)
    turns = spark.createDataFrame([(*r, 1, "w") for r in rows], "conv_id long, turn long, role string, text string, window int, formatted string")
    windows = chat.format_conversations(turns, budget=120, history=40)
    found = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns_hash = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        got = found[conv]
        assert (got.n_turns, got.turns_sha256) == (len(own), turns_hash)
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        parsed = chat.parse_window(w.formatted)
        assert len(parsed) == w.n_turns and w.n_repeated < w.n_turns
        if w.window and w.conv_id in (0, 3, 6, 9):
            assert parsed[0][0] == "system" and w.n_repeated >= 1
        assert len(w.loss) == sum(role == "assistant" for role, _ in parsed[w.n_repeated :])
    assert windows.where("n_repeated > 1").count() > 5


def test_windows_keep_to_the_budget(spark):
    turns = spark.createDataFrame([(1, i, "user", "w") for i in range(30)], "conv_id int, turn int, role string, text string")
    windows = chat.format_conversations(turns, budget=10, history=3, tokens=F.lit(1)).orderBy("window").collect()
    assert [(w.n_turns, w.n_repeated) for w in windows][:3] == [(10, 0), (10, 3), (10, 3)]
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


# --- languages -------------------------------------------------------------


def slow_ranks(text, size):
    padded = "".join(c.lower() if c.isalpha() else "_" for c in text)
    padded = "_" + re.sub("_+", "_", padded.strip("_")) + "_"
    found = {}
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if (gram if n < 3 else gram[1]) != "_" and gram != "__":
                found[gram] = found.get(gram, 0) + 1
    return found


def test_gram_counts_equal_brute_force():
    from corpusloom.llm.arrow import pieces
    import pyarrow as pa

    for text in ("Ab ab, ba!", "ÉÀ—éà x", "a", "Straße 12 x3y"):
        (row,) = langid.row_letters(next(pieces(pa.array([text]))))
        values, counts = langid.counted(langid.grams(row))
        want = slow_ranks(text, 400)
        assert counts.sum() == sum(want.values()) and len(values) == len(want)
        assert sorted(counts) == sorted(want.values())


def test_languages_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = langid.learn_profiles(docs.where(~langid.held_out()), "text", "lang")
    assert profiles.languages == ("de", "en", "es", "fr")
    found = langid.predict_languages(docs.where(langid.held_out()), profiles)
    right = found.where("lang = lang_pred").count()
    assert right >= 0.95 * found.count()
    assert found.where("score < 0 OR score > 1").count() == 0


def test_language_edge_cases(spark, empty_documents):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 !", "en"), (5, "", None), (6, "the dog", None)]
    docs = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, lang string, score double")
    profiles = langid.learn_profiles(docs, "text", "lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_languages(docs, profiles).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert got[3][1] == 0.0
    nothing = langid.learn_profiles(empty_documents, "text", "lang")
    assert langid.predict_languages(docs, nothing).select("lang_pred").distinct().collect() == [("und",)]
    assert langid.predict_languages(empty_documents, profiles).count() == 0


def test_distance_of_equal_and_foreign_profiles():
    rows = [{"lang": x, "gram": g, "rank": r} for x, grams in (("a", (5, 6, 7)), ("b", (7, 8, 9))) for r, g in enumerate(grams, 1)]
    profiles = langid.Profiles.of(rows, 3)
    assert profiles.predict(np.array([5, 6, 7], np.uint64)) == ("a", 1.0)
    assert profiles.predict(np.array([1, 2], np.uint64)) == ("a", 0.0)
    # 7 stands at 2 in a and at 0 in b, 8 is missing in a.
    assert profiles.predict(np.array([7, 8], np.uint64)) == ("b", 1.0)


# --- pages -----------------------------------------------------------------


def test_leaf_blocks():
    page = "a<b>b</b> c<p>x&amp;y &copy;<br>z<p>q<script>if (a<b) '</p>'</script>r<!-- <p> --> s<div>t</p>&nbsp;</div><li>u<li>v<style>p{}</style><a href='>'>w</a>"
    assert [b.text for b in html.leaf_blocks(page)] == ["ab c", "x&y © z", "qr s", "t", "u", "vw"]
    assert html.leaf_blocks("") == [] and html.leaf_blocks("<p><p> <br></p>") == []
    assert [b.text for b in html.leaf_blocks("<p>a<3 &am <b")] in (["a<3 &am <b"], ["a<3 &am"])


@pytest.mark.parametrize("script", ["for(i=0; i<n ;i++){} // don't", "a = '<!-- '", "if (a<b) x = \"<p\"; // \" it's", "/* <b title=' */", "x <![CDATA["])
@pytest.mark.parametrize("tag", ["script", "style", "title"])
def test_markup_after_raw_text_is_read(script, tag):
    page = f"<{tag}>{script}</{tag}><nav>Menu</nav><article><h1>It's here</h1><p>One \"word\" --> more</p></article>"
    blocks = html.leaf_blocks(page)
    assert [b.text for b in blocks] == ["Menu", "It's here", 'One "word" --> more']
    assert [[e.tag for e in b.path] for b in blocks] == [["nav"], ["article", "h1"], ["article", "p"]]


@pytest.mark.parametrize("tag", ["svg", "math", "canvas", "audio", "video", "object", "template"])
def test_text_after_an_unclosed_tag_is_read(tag):
    assert [b.text for b in html.leaf_blocks(f"<p>a<{tag} x='1'></p><article><p>b</p></article>")] == ["a", "b"]
    closed = [b.text for b in html.leaf_blocks(f"<article><p>a <{tag}>c</{tag}> d</p></article>")]
    assert closed == (["a d"] if tag == "template" else ["a c d"])


@pytest.fixture(scope="module")
def field():
    return html.trained_field()


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        score = {f"f{i}": float(rng.normal()) for i in range(6)}
        step = tuple(tuple(map(float, rng.normal(size=2))) for _ in range(2))
        features = [[f"f{i}" for i in rng.choice(6, 2, replace=False)] for _ in range(6)]

        def value(labels):
            gain = sum(sum(score[f] for f in fs) for fs, on in zip(features, labels) if on)
            return gain + sum(step[a][b] for a, b in zip(labels, labels[1:]))

        every = [[bool(n >> i & 1) for i in range(6)] for n in range(64)]
        assert value(html.Field(score, step).labels(features)) == pytest.approx(max(map(value, every)))


def test_field_on_held_out_pages(field):
    pages = html.training_set(labelled_pages(150, seed=99))
    right = total = 0
    for features, labels in pages:
        guess = field.labels(features)
        right, total = right + sum(a == b for a, b in zip(guess, labels)), total + len(labels)
    assert right / total > 0.985


def test_field_on_layouts_that_training_pages_do_not_have(field):
    right = total = 0
    for page in LAYOUTS.values():
        [(features, labels)] = html.training_set([page.replace("[[", MARK)])
        right, total = right + sum(a == b for a, b in zip(field.labels(features), labels)), total + len(labels)
    assert total == 121 and right / total >= 0.98


def test_a_byline_does_not_end_an_article(field):
    page = '<div class="col-md-9"><h1>Night</h1><div class="byline">By Ann Lee</div>' + "<p>The river rose by two metres in the night.</p>" * 5 + "</div>"
    assert html.main_text(page, field).split("\n\n")[:2] == ["Night", "By Ann Lee"]
    assert html.main_text(page, field).count("river") == 5


def test_articles_of_the_given_pages(spark, sf_dir, field):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r for r in html.extract_main_text(pages, model=field).collect()}
    for page in pages.collect():
        article = re.search("<article>(.*)</article>", page.html, re.S)[1]
        parts = re.split("</?(?:h1|p)>", re.sub("</?b>", "", article).replace("<br>", " "))
        blocks = [" ".join(html.entities.unescape(p).split()) for p in parts]
        text = "\n\n".join(b for b in blocks if b)
        assert found[page.page_id].text == text and found[page.page_id].n_chars == len(text)


def test_page_edge_cases(spark, field):
    long = "<article>" + "<p>Some longer words here.</p>" * 3000 + "</article>"
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (3, "v", "<nav><a>x</a></nav>"), (4, "w", long)]
    pages = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    found = html.extract_main_text(pages, model=field).collect()
    assert len(found) == 5 and [r.n_chars for r in found[:4]] == [0, 0, 0, 0]
    assert found[4].text.count("Some") == 3000
    assert html.extract_main_text(pages.limit(0), model=field).count() == 0


# --- licences --------------------------------------------------------------


def test_licences_are_found_in_place(spark, prose):
    mit = TEMPLATES[0][1]
    worn = " ".join(w for i, w in enumerate(mit.split()) if i % 25)
    cases = [
        (prose(1, 50) + "\n" + "Released under the MIT License.\n" + prose(2, 20), {"MIT"}),
        (mit, {"MIT"}), (prose(3, 9) + "\n\n" + worn.lower() + "\n", {"MIT"}),
        ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", {"MIT", "CC-BY-NC-4.0"}),
        (prose(5, 400), set()), ("the license of the software", set()), (None, set()), ("", set()), ("one", set()), (mit[:200], set()),
    ]
    docs = spark.createDataFrame([(i, t, 1.0) for i, (t, _) in enumerate(cases)], "doc_id long, text string, dice double")
    rows = licenses.scan_licenses(docs).collect()
    for i, (text, want) in enumerate(cases):
        assert {r.license_id for r in rows if r.doc_id == i} == want, i
    first = next(r for r in rows if r.doc_id == 0)
    assert cases[0][0][first.start : first.end] == "Released under the MIT License" and first.dice == 1.0
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_licences_are_found_in_a_sentence_and_with_names_filled_in(spark, prose):
    bsd = next(t for name, t in TEMPLATES if name == "BSD-3-Clause")
    cases = [
        (bsd.replace("the copyright holder nor", "the University of California, Berkeley nor"), ["BSD-3-Clause"]),
        (bsd.replace("Neither the name", "In all cases and without any further notice by us neither the name"), ["BSD-3-Clause"]),
        ("This is part of the work. Released under the MIT License.", ["MIT"]),
        (f"{prose(1, 30)} this work, the work. Released under the MIT License. {prose(2, 30)} Released under the MIT License and more", ["MIT", "MIT"]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    rows = licenses.scan_licenses(docs).orderBy("doc_id", "start").collect()
    for i, (text, want) in enumerate(cases):
        assert [r.license_id for r in rows if r.doc_id == i] == want, i
    for r in rows[2:]:
        assert cases[r.doc_id][0][r.start : r.end] == "Released under the MIT License" and r.dice == 1.0


def test_versions_and_kinds_of_licences_are_told_apart(spark):
    docs = spark.createDataFrame([(i, f"Some words. {t} Some more.") for i, (_, t) in enumerate(TEMPLATES)], "doc_id long, text string")
    found = {}
    for r in licenses.scan_licenses(docs).collect():
        found.setdefault(r.doc_id, []).append(r.license_id)
    assert found == {i: [name] for i, (name, _) in enumerate(TEMPLATES)}
    gpl = next(t for name, t in TEMPLATES if name == "GPL-3.0")
    others = [gpl.replace("version 3", "version 9"), gpl.replace("version 3", "version 2"), "Licensed under CC BY 4.0."]
    docs = spark.createDataFrame(list(enumerate(others)), "doc_id long, text string")
    assert sorted((r.doc_id, r.license_id) for r in licenses.scan_licenses(docs).collect()) == [(1, "GPL-2.0"), (2, "CC-BY-4.0")]


def test_best_windows_equal_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(60):
        counts = rng.integers(0, 3, 6)
        counts[0] += 1
        kinds = rng.integers(0, 9, 40)
        at = np.flatnonzero((kinds < 6) & (np.append(counts, [0, 0, 0])[kinds] > 0))
        template = np.repeat(np.arange(6), counts)
        want = max(licenses.dice(np.sort(kinds[s:e]), template) for s in range(40) for e in range(s + 1, 41))
        got = max((v for *_, v in licenses.best_windows(at, kinds[at], counts, 0.8)), default=0)
        assert got == (pytest.approx(want) if want >= 0.8 else 0)


def test_the_best_window_of_a_stretch_is_found_without_trying_every_start():
    rng = np.random.default_rng(5)
    for n in range(12):
        counts = rng.integers(1, 3, 300)
        own = np.repeat(np.arange(300), counts)
        worn = own[rng.random(len(own)) > 0.02 * n]
        text = np.concatenate([np.full(rng.integers(0, 200), 300), worn, np.full(rng.integers(0, 90), 300), rng.integers(0, 300, 60)])
        at = np.flatnonzero(text < 300)
        every = list(licenses.best_windows(at, text[at], counts, 0.8))
        found = list(licenses.best_windows(at, text[at], counts, 0.8, every=False))
        assert set(found) <= set(every)
        assert max((v for *_, v in found), default=0) == max((v for *_, v in every), default=0)


def test_whole_licence_texts_have_their_own_id_and_no_other(spark, prose):
    texts = full_texts()
    assert len(texts) == 13
    worn = [(name, " ".join(w for i, w in enumerate(text.split()) if i % 40)) for name, text in texts]
    cases = [*texts, *worn, *((name, f"{prose(i, 300)}\n{text}\n{prose(i, 200)}") for i, (name, text) in enumerate(texts))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string").repartition(8)
    found = {}
    for r in licenses.scan_licenses(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.license_id)
    assert found == {i: {name} for i, (name, _) in enumerate(cases)}


def test_licence_edge_cases(spark, prose):
    """Repeated rows give repeated finds, null ids stay null, of equal windows the first stays, and long texts are read whole."""
    notice = "Released under the MIT License."
    long = prose(1, 60_000) + f"\n{notice}\n" + prose(2, 60_000) + "\n" + dict(full_texts())["LGPL-2.0"]
    rows = [(None, notice), (7, notice), (7, notice), (8, f"{notice} {notice}"), (9, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.license_id, r.start) for r in licenses.scan_licenses(docs).collect())
    assert found[:5] == [(0, "MIT", 0), (7, "MIT", 0), (7, "MIT", 0), (8, "MIT", 0), (8, "MIT", len(notice) + 1)]
    assert [(d, name) for d, name, _ in found[5:]] == [(9, "LGPL-2.0"), (9, "MIT")]


def test_size_bound_loses_nothing():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = (np.sort(rng.integers(0, 12, rng.integers(1, 14)).astype(np.uint64)) for _ in range(2))
        low, high = licenses.size_range(len(a), 0.8)
        if licenses.dice(a, b) >= 0.8:
            assert low <= len(b) <= high


# --- benchmark -------------------------------------------------------------


def edit(text, places):
    out = list(text)
    for kind, at in places:
        out[at] = {"sub": "#", "del": "", "ins": out[at] + "#"}[kind]
    return "".join(out)


def test_passages_with_edits_are_found(spark, prose):
    item, short = prose(1, 40), prose(2, 10)[:60]
    edited = edit(item[:100], [("sub", 10), ("del", 30), ("ins", 55), ("sub", 77)])
    cases = [
        ("x " * 30 + item + " y", {1}), (prose(9, 300) + "\n" + item.upper().replace(" ", "\n ") + "z", {1}),
        (prose(8, 5) + edited, {1}), (edited, {1}), (item[:70], set()), (item[:40] + prose(7, 20) + item[-40:], set()),
        ("é" * 40 + short + "é", {2}), (prose(4, 500), set()), (None, set()), ("", set()), (item + item, {1}), (item, {1}),
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(cases)], "doc_id long, text string, passages int")
    benchmark = spark.createDataFrame([(1, item), (2, short), (3, None), (None, item), (4, "tiny"), (1, item)], "item_id long, text string")
    for block in (4_000_000, 10):
        found = {r.doc_id: r.passages for r in decontaminate.find_passages(docs, benchmark, block_chars=block).collect()}
        for i, (text, want) in enumerate(cases):
            assert {p.item_id for p in found[i]} == want, (i, block)
    whole = found[0][0]
    assert cases[0][0][whole.start : whole.end] == item and whole.edits == 0
    assert decontaminate.find_passages(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_passages(docs, benchmark.limit(0)).where("size(passages) > 0").count() == 0


def test_partial_copies_are_found_at_every_place(prose):
    item = prose(1, 60)[:300]
    index = decontaminate.Index.of([(7, item)], decontaminate.UNIT, decontaminate.EDITS, decontaminate.Q)
    for at in range(0, 221):
        for text in (item[at : at + 80], edit(item[at : at + 84], [("sub", 20), ("del", 40), ("del", 60), ("sub", 75)])):
            for before in ("", "Zq~ " * 9):
                found = decontaminate.row_matches(decontaminate.code_points((before + text + " ~Zq" * 9).encode()), index)
                if at + 84 <= 300 or len(text) == 80:
                    assert [m[0] for m in decontaminate.merged(found)] == [7], (at, text)
        # Six characters fewer than a passage are more edits than allowed.
        assert not decontaminate.row_matches(decontaminate.code_points(("~" * 30 + item[at : at + 74] + "~" * 30).encode()), index)


def test_white_space_of_any_kind_is_one(prose):
    item = prose(1, 60)[:300]
    index = decontaminate.Index.of([(7, item)], decontaminate.UNIT, decontaminate.EDITS, decontaminate.Q)
    for blank in ("\u00a0", "\u3000", "\u2028", "\u00a0 \u2003"):
        text = "x " + item.replace(" ", blank)
        (found,) = decontaminate.merged(decontaminate.row_matches(decontaminate.code_points(text.encode()), index))
        assert found[1:] == (2, len(text), 0)


def test_copies_and_segments_change_no_result(prose, monkeypatch):
    """Texts over few letters, searched in one piece and in many, with and without the shortcut for long copies."""
    rng = np.random.default_rng(8)

    def text(period, repeats, noise):
        base = np.tile(rng.integers(0, 3, period), repeats)
        hit = rng.random(len(base)) < noise
        base[hit] = rng.integers(0, 4, hit.sum())
        return "".join("ab c"[x] for x in base)

    for case in range(4):
        period = int(rng.integers(1, 9))
        item = text(period, 110 // period, 0.0 if case % 3 else 0.02)
        other = prose(case, 40)
        index = decontaminate.Index.of([(1, item), (2, other), (3, item[:100] + other[:100])], 80, 4, 12)
        body = other[:110] + item[:90] + text(period, 150 // period, 0.01 * (case % 4)) + item * 2 + " " + other[50:150]
        points = decontaminate.code_points(body.encode())
        monkeypatch.setattr(decontaminate, "REPEATING", 1 << 40)
        monkeypatch.setattr(decontaminate, "PAIRS", 1 << 40)
        whole = decontaminate.merged(decontaminate.row_matches(points, index))
        monkeypatch.setattr(decontaminate, "REPEATING", 4)
        for pairs in (20_000, 1 << 40):
            monkeypatch.setattr(decontaminate, "PAIRS", pairs)
            assert decontaminate.merged(decontaminate.row_matches(points, index)) == whole, (case, pairs)
        assert whole


def test_a_long_repetitive_text_is_searched_fast():
    index = decontaminate.Index.of([(1, "0 " * 250)], decontaminate.UNIT, decontaminate.EDITS, decontaminate.Q)
    body = "x" * 50 + "0 " * 20_000 + "y" * 50
    start = time.process_time()
    (found,) = decontaminate.merged(decontaminate.row_matches(decontaminate.code_points(body.encode()), index))
    assert time.process_time() - start < 20
    assert found[0] == 1 and found[1] <= 50 and found[2] >= 40_048 and found[3] == 0


def test_short_items_are_found_as_they_are_between_words():
    index = decontaminate.Index.of([(1, "Name the river."), (2, "a river too"), (3, "the seven seas")], 80, 4, 12)
    for text, want in (("Q: name  THE river.", [1]), ("nick" + "name the river.", []), ("the seven seas", [3]), ("the seven season", []), ("on the seven seas!", [3]), ("name the rover.", []), ("a river too", [])):
        got = decontaminate.merged(decontaminate.row_matches(decontaminate.code_points(text.encode()), index))
        assert [m[0] for m in got] == want, text


def test_banded_alignment_equals_full_alignment():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pattern = rng.integers(0, 3, 12).astype(np.uint32)
        text = rng.integers(0, 3, 12 + 11).astype(np.uint32)
        cost = np.zeros((13, 24), int)
        cost[1:, 0] = np.arange(1, 13)
        for i in range(1, 13):
            for j in range(1, 24):
                cost[i, j] = min(cost[i - 1, j - 1] + (pattern[i - 1] != text[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
        _, _, got = decontaminate.banded_matches(pattern[None], text[None], np.array([23]), 4)
        assert got[0] >= cost[12].min()
        at = int(rng.integers(4, 7))
        text[at : at + 12] = pattern
        start, end, got = decontaminate.banded_matches(pattern[None], text[None], np.array([23]), 4)
        assert got[0] == 0 and end[0] - start[0] == 12


# --- packing ---------------------------------------------------------------


def slow_best_fit(lengths, capacities, cost):
    """One piece at a time, the same choices: content of every bin and its capacity when opened."""
    left = {n: lengths.count(n) for n in set(lengths)}
    distinct, bins, choice = sorted(left), [], {}
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            best = min(fits, key=lambda b: b[0])
        else:
            choice.setdefault(n, packing.least_cost(n, {**left, **{m: 0 for m in left if m > n}}, distinct, capacities, cost))
            best = [choice[n], choice[n]]
            bins.append(best)
        best[0] -= n
    return sorted((b[1] - b[0], b[1]) for b in bins)


def test_plan_equals_best_fit_piece_by_piece():
    rng = np.random.default_rng(8)
    for capacities in ((16, 32, 64), (50,), (8, 64)):
        for _ in range(25):
            lengths = rng.integers(1, capacities[-1] + 1, rng.integers(1, 120)).tolist()
            histogram = {n: lengths.count(n) for n in lengths}
            fill = {}
            for p in packing.plan(histogram, capacities, packing.training_cost):
                for k in range(p.count):
                    b = p.bin + k // p.per_bin
                    assert fill.get(b, 0) == p.offset + (k % p.per_bin) * p.tokens
                    fill[b] = fill.get(b, 0) + p.tokens
            assert sum(fill.values()) == sum(lengths) and max(fill.values()) <= capacities[-1]
            assert sorted(fill.values()) == [a for a, _ in slow_best_fit(lengths, capacities, packing.training_cost)]


def test_pieces_lie_whole_in_bins(spark, prose, empty_documents):
    rows = [(i, prose(i, (37 * i) % 90)) for i in range(120)] + [(1000, prose(1, 1000)), (None, "a b"), (5, prose(5, 12)), (5, prose(5, 12)), (2000, None), (2001, " ")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bin_id int, length int")
    found = packing.pack(docs, capacities=(32, 64, 128)).toPandas()
    assert found.n_tokens.sum() == sum(len((t or "").split()) for _, t in rows)
    assert (found.n_tokens == 0).sum() == sum(not (t or "").split() for _, t in rows)
    packed = found[found.n_tokens > 0].sort_values(["bin_id", "bin_offset"])
    for _, b in packed.groupby("bin_id"):
        assert b.bin_offset.tolist() == [0, *b.n_tokens.cumsum().tolist()[:-1]]
        fill, capacity = b.n_tokens.sum(), b.bin_capacity.iloc[0]
        assert (b.bin_fill == fill).all() and capacity == (32, 64, 128)[bisect_left((32, 64, 128), fill)]
    long = found[found.doc_id == 1000].sort_values("piece")
    assert long.start.tolist() == [128 * i for i in range(8)] and long.n_tokens.sum() == 1000
    assert packing.pack(empty_documents).count() == 0


# --- archives --------------------------------------------------------------


def test_archives_read_back(spark, prose, tmp_path):
    big = prose(1, 400)
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "u\r\nX: %41", "é" * 600), (4, "u", "é" * 600), (5, "u", None), (6, "u", ""), (7, "u", "s"), (8, "u", "s"), (None, "u", big), (9, None, big), (10, "u", "WARC/1.1\r\n\r\n" * 90)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    archive = warc.write_archive(pages, str(tmp_path / "a"), frame_bytes=3000, bundle_bytes=2000)
    back = warc.read_archive(spark, archive).collect()
    assert len(back) == len(rows) == archive.index.count()
    for r in back:
        key = None if r.key == "\\N" else int(r.key)
        url, text = next((u, t or "") for k, u, t in rows if k == key)
        data = text.encode()
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(data), hashlib.sha1(data).hexdigest())
        last = {1: "9", 2: "9", None: "9", 3: "4"}.get(key)
        assert (r.record_type, r.refers_to) == (("response", None) if last is None else ("revisit", last))
        assert r.content == (data if last is None else None)
    headers, body = warc.read_record(archive, 4)
    assert body == ("é" * 600).encode() and headers["WARC-Type"] == "response"
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0), str(tmp_path / "b"))).count() == 0


@pytest.mark.parametrize("limit", [warc.MAX_BROADCAST_BYTES, 0])
def test_one_payload_in_a_third_of_the_rows(spark, prose, tmp_path, monkeypatch, limit):
    """Broadcast or salted, equal payloads get one response, and reading is as many tasks as the bytes ask for."""
    monkeypatch.setattr(warc, "MAX_BROADCAST_BYTES", limit)
    monkeypatch.setattr(warc, "TASK_BYTES", 40_000)
    hot, warm = prose(1, 300), prose(2, 300)
    rows = [(i, "u", hot if i % 3 == 0 else warm if i in (10, 20) else prose(100 + i, 300)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    back = warc.read_archive(spark, warc.write_archive(pages, str(tmp_path / "a"), frame_bytes=8000))
    plain = sum(len(t.encode()) for i, _, t in rows if t not in (hot, warm) or i in (297, 20))
    assert back.rdd.getNumPartitions() >= plain // 40_000
    got = {int(r.key): (r.record_type, r.refers_to) for r in back.collect()}
    assert got == {i: ("revisit", "297" if t == hot else "20") if t in (hot, warm) and i not in (297, 20) else ("response", None) for i, _, t in rows}


def test_bundles_are_plain_zstandard(tmp_path):
    import zstandard
    from pyarrow import fs

    path = str(tmp_path / "x.zst")
    writer = warc.BundleWriter(fs.LocalFileSystem().open_output_stream(path, compression=None), frame_bytes=100)
    places = [writer.add(b"%d" % i * 30) for i in range(20)]
    writer.close()
    with fs.LocalFileSystem().open_input_file(path) as source:
        table = warc.read_seek_table(source)
        frames = [warc.read_frame(source, f) for f in table]
    assert all(frames[f][o : o + 30 * len(str(i))] == b"%d" % i * 30 for i, (f, o) in enumerate(places))
    with open(path, "rb") as file:
        assert zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read() == b"".join(frames)
