from corpusloom import Settings
from corpusloom.plans.dictionary import build_dictionary
from corpusloom.settings import SHIPPED_CATEGORIES
from corpusloom.sources import categories, corpus, dictionary, pages, results


def test_settings_from_properties(tmp_path):
    path = tmp_path / "run.properties"
    path.write_text(
        "corpus.name=web\ncorpus.directory=/data/web\ncorpus.dr.threshold=0.02\ncorpus.cost=16\ncorpus.gamma=0.5\n\n"
        "# nu per category\ncategory.zebra=1.0\ncategory.apple=0.001"
    )
    settings = Settings.from_properties(str(path), seed=1)
    assert settings.category_names == ["zebra", "apple"]
    assert settings.nu_of("apple") == 0.001 and settings.nu_of("other") == settings.default_nu
    assert (settings.corpus_name, settings.score_threshold, settings.cost, settings.gamma) == ("web", 0.02, 16.0, 0.5)
    assert len(SHIPPED_CATEGORIES) == 33 and dict(SHIPPED_CATEGORIES)["complex"] == 0.001


def test_corpus_directory(spark, tmp_path):
    for name, texts in {"red": ["one\ntwo", "three"], "blue +x": ["four"], "skip": ["five"]}.items():
        (tmp_path / name).mkdir()
        for i, content in enumerate(texts):
            (tmp_path / name / f"{i} a+b.txt").write_text(content)
    (tmp_path / "empty").mkdir()
    got = corpus.read_corpus_directory(spark, str(tmp_path), ["red", "blue +x", "empty"]).collect()
    assert sorted((r["label"], r["text"]) for r in got) == [("blue +x", "four"), ("red", "one\ntwo"), ("red", "three")]
    assert len({r["doc_id"] for r in got}) == 3
    assert corpus.read_corpus_directory(spark, str(tmp_path)).count() == 4
    assert corpus.read_corpus_directory(spark, str(tmp_path), ["empty"]).count() == 0


def test_label_index(spark, tmp_path):
    names = ["b", "a two", "c"]
    categories.write_label_index(categories.categories_from_names(spark, names), str(tmp_path / "i"))
    back = categories.read_label_index(spark, str(tmp_path / "i")).orderBy("code").collect()
    assert [r["label"] for r in back] == names


def test_dictionary_text_files(spark, make_docs, tmp_path):
    docs = make_docs([("a", "red red"), ("a", "red"), ("b", "blue"), ("b", "blue"), ("c", "red blue"), ("c", "up")])
    run = build_dictionary(docs, Settings())
    run.save_text(str(tmp_path))
    # Part files in name order, as a concatenation of the folder would read them.
    lines = [x for part in sorted((tmp_path / "dict").glob("part-*")) for x in part.read_text().splitlines()]
    assert lines[0] == "6,2"
    assert all(len(line.split(" ")) == 6 for line in lines[1:])
    scores = [float(line.split(" ")[5]) for line in lines[1:]]
    assert scores == sorted(scores, reverse=True) and scores
    terms, meta = dictionary.read_dictionary_text(spark, str(tmp_path / "dict"))
    kept = ["id", "term", "df", "ig", "chi", "score"]
    assert sorted(terms.collect()) == sorted(run.dictionary.select(*kept).collect())
    assert tuple(meta.first()) == (6, 2)
    tf = [r["value"].split(" ") for r in spark.read.text(str(tmp_path / "tf")).collect()]
    assert all(len(parts) == 4 for parts in tf)
    assert spark.read.text(str(tmp_path / "chi")).count() == len(scores)


def test_url_list_and_label_lines(spark, tmp_path):
    (tmp_path / "urls").write_text("a.example\nhttps://b.example/x\n")
    assert pages.read_url_list(spark, str(tmp_path / "urls")).count() == 2
    labelled = spark.createDataFrame([("http://a", "news")], "url string, prediction string")
    assert results.label_lines(labelled).first()["value"] == "http://a".ljust(50) + "news".ljust(30)
    results.write_label_lines(labelled, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_reports_append(spark, tmp_path):
    lines = spark.createDataFrame([(1, "b"), (0, "a")], "ord int, line string")
    for _ in range(2):
        results.append_report(lines, str(tmp_path / "report"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()) == ["a", "a", "b", "b"]


def test_files_left_out_by_readers_are_read_by_many_tasks(spark, tmp_path):
    from corpusloom.sources.corpus import FILES_A_TASK, read_corpus_directory

    (tmp_path / "a").mkdir()
    for i in range(2 * FILES_A_TASK + 1):
        (tmp_path / "a" / f".hidden{i}").write_text(str(i))
    docs = read_corpus_directory(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() == 3
    assert sorted(int(r.text) for r in docs.collect()) == list(range(2 * FILES_A_TASK + 1))
