"""A stream of pages prepares its model once and can be replayed."""

from pathlib import Path

import pytest

from corpusloom.operators import weights
from corpusloom.plans import train
from corpusloom.plans.label import label_pages
from corpusloom.settings import Settings
from corpusloom.sources.pages import PAGE_SCHEMA, stream_table
from corpusloom.streaming.pages import label_page_stream

TOPICS = ("sun moon star", "bread milk salt")


@pytest.fixture(scope="module")
def text_classifier(make_docs):
    settings = Settings(score_threshold=0.0, fourier_dims=16, max_iterations=5)
    pairs = [("ab"[i % 2], f"{TOPICS[i % 2]} w{i % 4}") for i in range(24)]
    return train.train_classifier(train.prepare(make_docs(pairs), settings), settings).classifier


def test_three_batches_measure_the_dictionary_once(spark, tmp_path, text_classifier, monkeypatch):
    pages = [(i, f"http://p{i}", f"<p>{TOPICS[i % 2]}</p>") for i in range(9)]
    schema = "page_id long, url string, html string"
    for i in range(3):
        spark.createDataFrame(pages[3 * i : 3 * i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    measured, of = [], weights.Lookup.of.__func__

    def counted(cls, dictionary):
        measured.append(not isinstance(dictionary, weights.Lookup))
        return of(cls, dictionary)

    monkeypatch.setattr(weights.Lookup, "of", classmethod(counted))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = label_page_stream(stream, text_classifier, str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    run.awaitTermination()
    assert measured.count(True) == 1 and len(measured) > 3
    assert len(list(Path(tmp_path / "out").glob("batch=*"))) == 3
    streamed = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("page_id", "url", "prediction").collect())
    batch = label_pages(spark.createDataFrame(pages, schema), text_classifier)
    assert streamed == sorted(tuple(r) for r in batch.select("page_id", "url", "prediction").collect())


@pytest.mark.parametrize("files", [0, 1, 3])
def test_a_page_table_streams_whole_as_one_file_and_as_a_folder(spark, tmp_path, files):
    pages = [(i, f"http://p{i}", f"<p>{i}</p>") for i in range(9)]
    frame, path = spark.createDataFrame(pages, PAGE_SCHEMA), tmp_path / "pages.parquet"
    if files:
        frame.repartition(files).write.parquet(str(path))
    else:
        frame.coalesce(1).write.parquet(str(tmp_path / "made"))
        path.write_bytes(next((tmp_path / "made").glob("part-*")).read_bytes())
    # A table beside it is not read.
    frame.write.parquet(str(tmp_path / "pages.parquet.old"))
    stream = stream_table(spark, str(path)).writeStream.trigger(availableNow=True)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream.format("parquet").option("path", out).option("checkpointLocation", state).start().awaitTermination()
    assert sorted(tuple(row) for row in spark.read.parquet(out).collect()) == pages
