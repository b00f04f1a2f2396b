"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``.

Corpus: ``documents`` with ``lang`` as label unless the name says otherwise.
Computed doubles are rounded to six digits, as in the matching SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrays import variance
from corpusloom.functions.text import html_to_text as visible_text
from corpusloom.functions.text import url_with_http, url_with_scheme
from corpusloom.operators import classifier, counts, evaluation, one_class, selection, split, weights
from corpusloom.operators.kernel import fourier_array, projected_array
from corpusloom.plans import train
from corpusloom.plans.dictionary import DictionaryRun, build_dictionary, score_corpus
from corpusloom.plans.label import label_pages, multi_label_pages, page_vectors as vectors_of_pages
from corpusloom.plans.vectorize import save_one_class_vectors, save_vectors, vectorize_corpus
from corpusloom.session import shared_path
from corpusloom.settings import Settings
from corpusloom.sources import categories as category_source
from corpusloom.sources import dictionary as dictionary_source
from corpusloom.sources import pages as page_source
from corpusloom.sources import vectors as vector_source
from corpusloom.sources.corpus import corpus_from_table
from corpusloom.sources.results import append_report, write_label_lines
from corpusloom.streaming.pages import label_page_stream

# The given tables are files of one row group, which Spark reads in one task each.
READ_PARTITIONS = 16
SETTINGS = Settings(corpus_name="documents", read_partitions=READ_PARTITIONS)
QUALITY_SETTINGS = Settings(corpus_name="quality")
# One source is named that holds no document.
SOURCE_SETTINGS = Settings(
    corpus_name="sources", categories=tuple((f"src{i}", 0.1) for i in (*range(20), 99))
)
TOP = 100

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, read_partitions: int | None = SETTINGS.read_partitions) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return corpus_from_table(documents, "doc_id", "lang", "text", read_partitions=read_partitions)


def source_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return corpus_from_table(documents, "doc_id", "source", "text", SOURCE_SETTINGS.category_names, READ_PARTITIONS)


def role_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.concat_ws(":", "conv_id", "turn")
    return corpus_from_table(table(spark, sf_dir, "conversations"), turn, "role", "text")


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of the corpus where its files are read, without an exchange."""
    return counts.term_bags(corpus(spark, sf_dir, None))


def dealt_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of the corpus with its rows dealt over ``READ_PARTITIONS`` tasks: one exchange of rows, before any is cut."""
    return counts.term_bags(corpus(spark, sf_dir))


def bags_and_dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DictionaryRun]:
    """The corpus as a written table of bags, and the dictionary made from it."""
    written = counts.bag_table(corpus(spark, sf_dir))
    return written, build_dictionary(written, SETTINGS)


def dictionary_run(spark: SparkSession, sf_dir: str) -> DictionaryRun:
    return build_dictionary(corpus(spark, sf_dir), SETTINGS)


def six(name: str) -> Column:
    return F.round(name, 6).alias(name)


# --- sources ---------------------------------------------------------------


@query
def corpus_scan(spark, sf_dir):
    return corpus(spark, sf_dir)


@query
def label_index(spark, sf_dir):
    return category_source.categories_from_labels(corpus(spark, sf_dir))


@query
def label_index_roundtrip(spark, sf_dir):
    path = shared_path(spark, "labelindex")
    category_source.write_label_index(category_source.categories_from_labels(corpus(spark, sf_dir)), path)
    return category_source.read_label_index(spark, path)


@query
def page_scan(spark, sf_dir):
    return page_source.read_pages(spark, f"{sf_dir}/pages.parquet")


def _dictionary_rows(terms: DataFrame, meta: DataFrame) -> DataFrame:
    meta = meta.select(F.struct("n", "max_id")).scalar()
    return terms.select(
        "id", "term", "df", six("ig"), six("chi"), six("score"), meta.alias("meta")
    ).select("id", "term", "df", "ig", "chi", "score", "meta.n", "meta.max_id")


@query
def dict_roundtrip(spark, sf_dir):
    path = shared_path(spark, "dictionary")
    dictionary_run(spark, sf_dir).save(path)
    return _dictionary_rows(*dictionary_source.read_dictionary(spark, path))


@query
def dict_text_roundtrip(spark, sf_dir):
    path = shared_path(spark, "dictionary-text")
    dictionary_run(spark, sf_dir).save_text(path)
    return _dictionary_rows(*dictionary_source.read_dictionary_text(spark, f"{path}/dict"))


def _class_file(spark, sf_dir, kind: str, value: Column) -> DataFrame:
    path = shared_path(spark, "dictionary-text")
    dictionary_run(spark, sf_dir).save_text(path)
    return dictionary_source.read_class_lines(spark, f"{path}/{kind}").select("id", "code", value.alias(kind))


@query
def class_tf_file(spark, sf_dir):
    """Term counts per category of the dictionary's terms, read back from their text file."""
    return _class_file(spark, sf_dir, "tf", F.col("value").cast("long"))


@query
def class_chi_file(spark, sf_dir):
    """Chi-square per category of the dictionary's terms, read back from their text file."""
    return _class_file(spark, sf_dir, "chi", F.round(F.col("value").cast("double"), 6))


def _saved_vectors(spark, sf_dir) -> str:
    path = shared_path(spark, "vectors")
    written, run = bags_and_dictionary(spark, sf_dir)
    save_vectors(vectorize_corpus(written, run.dictionary, SETTINGS), list(run.totals.labels), path)
    return path


def _entry_sums(entries: DataFrame) -> DataFrame:
    return entries.groupBy("split", "code", "id").agg(
        F.count(F.lit(1)).alias("docs"), F.round(F.sum("w"), 6).alias("w")
    )


@query
def sparse_roundtrip(spark, sf_dir):
    """Sparse text rows written and read back, zero weights kept."""
    rows = vector_source.read_sparse(spark, _saved_vectors(spark, sf_dir), "split")
    return _entry_sums(weights.vector_entries(rows))


@query
def libsvm_roundtrip(spark, sf_dir):
    """The same files through Spark's LIBSVM reader, which drops zero weights."""
    path = _saved_vectors(spark, sf_dir)
    loaded = None
    for part in ("train", "test"):
        rows = vector_source.read_libsvm(spark, f"{path}/split={part}").select(
            F.lit(part).alias("split"), F.col("label").cast("int").alias("code"),
            F.regexp_extract_all(F.col("features").cast("string"), F.lit(r"\[([^\]]*)\]"), F.lit(1)).alias("v"),
        )
        loaded = rows if loaded is None else loaded.unionAll(rows)
    pairs = F.arrays_zip(
        F.split(F.get("v", F.lit(0)), ",").alias("slot"), F.split(F.get("v", F.lit(1)), ",").alias("w")
    )
    entries = loaded.select("split", "code", F.inline_outer(pairs)).where("slot <> ''")
    return _entry_sums(
        entries.select("split", "code", (F.col("slot").cast("long") + 1).alias("id"), F.col("w").cast("double"))
        .where("w <> 0")
    )


@query
def one_class_roundtrip(spark, sf_dir):
    """One-class files of all categories written and read back."""
    path = shared_path(spark, "one-class")
    written, run = bags_and_dictionary(spark, sf_dir)
    save_one_class_vectors(vectorize_corpus(written, run.dictionary, SETTINGS), path)
    rows = vector_source.read_sparse(spark, path, "label", "split").withColumn("features", F.size("features"))
    return rows.groupBy("label", "split", "code").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("features").alias("features")
    )


# --- text ------------------------------------------------------------------


@query
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url_with_scheme(F.col("url")).alias("url"))


@query
def url_normalize_http_only(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url_with_http(F.col("url")).alias("url"))


@query
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", visible_text(F.col("html")).alias("content"))


@query
def tokenize(spark, sf_dir):
    return counts.token_stream(corpus(spark, sf_dir))


@query
def term_freq(spark, sf_dir):
    return counts.term_freq(dealt_bags(spark, sf_dir))


# --- corpus counts ---------------------------------------------------------


@query
def category_doc_count(spark, sf_dir):
    return counts.class_counts(corpus(spark, sf_dir))


@query
def category_doc_count_configured(spark, sf_dir):
    return counts.class_counts(source_corpus(spark, sf_dir), SOURCE_SETTINGS.category_names)


@query
def doc_freq(spark, sf_dir):
    return counts.doc_freq(dealt_bags(spark, sf_dir))


@query
def category_term_freq(spark, sf_dir):
    return counts.label_term_counts(dealt_bags(spark, sf_dir)).select("label", "term", "tf")


@query
def contingency(spark, sf_dir):
    return counts.label_term_counts(dealt_bags(spark, sf_dir)).select("term", "label", "a")


@query
def candidate_terms(spark, sf_dir):
    return counts.candidates(counts.doc_freq(dealt_bags(spark, sf_dir)))


@query
def feature_ids(spark, sf_dir):
    return selection.feature_ids(counts.candidates(counts.doc_freq(dealt_bags(spark, sf_dir)))).select("id", "term", "df")


@query
def category_tf_matrix(spark, sf_dir):
    run = dictionary_run(spark, sf_dir)
    arrays = selection.class_arrays(run.scored, run.totals)
    return arrays.select("id", "term", F.posexplode_outer("class_tf").alias("pos", "tf")).select(
        "id", "term", (F.col("pos") + 1).alias("code"), "tf"
    )


# --- scores and selection --------------------------------------------------


def scored_terms(spark, sf_dir) -> DataFrame:
    return score_corpus(corpus(spark, sf_dir), SETTINGS)[0]


@query
def class_entropy(spark, sf_dir):
    return counts.class_entropy(counts.class_counts(corpus(spark, sf_dir))).select("n", six("entropy"))


@query
def info_gain(spark, sf_dir):
    return scored_terms(spark, sf_dir).select("term", six("ig"))


@query
def chi_square(spark, sf_dir):
    arrays = selection.class_arrays(*score_corpus(corpus(spark, sf_dir), SETTINGS))
    return arrays.select("term", F.posexplode_outer("class_chi").alias("pos", "chi")).select(
        "term", (F.col("pos") + 1).alias("code"), six("chi")
    )


@query
def chi_dispersion(spark, sf_dir):
    arrays = selection.class_arrays(*score_corpus(corpus(spark, sf_dir), SETTINGS))
    return arrays.select("term", six("chi"), F.round(variance(F.col("class_chi")), 4).alias("chi_variance"))


@query
def term_score(spark, sf_dir):
    return scored_terms(spark, sf_dir).select("term", "df", six("ig"), six("chi"), six("score"))


@query
def selected_terms(spark, sf_dir):
    return dictionary_run(spark, sf_dir).dictionary.select("id", "term", "df", six("score"))


@query
def selected_terms_by_source(spark, sf_dir):
    """Twenty configured sources and one without documents."""
    run = build_dictionary(source_corpus(spark, sf_dir), SOURCE_SETTINGS)
    return run.dictionary.select("id", "term", "df", six("score"))


@query
def selected_terms_by_role(spark, sf_dir):
    """Conversation turns by role."""
    run = build_dictionary(role_corpus(spark, sf_dir), SETTINGS)
    return run.dictionary.select("id", "term", "df", six("score"))


@query
def dictionary_order(spark, sf_dir):
    """The whole dictionary by falling score."""
    return selection.order_terms(dictionary_run(spark, sf_dir).dictionary).select("id", "term", six("score"))


@query
def top_terms(spark, sf_dir):
    """The hundred best terms."""
    return selection.order_terms(dictionary_run(spark, sf_dir).dictionary, TOP).select(
        "id", "term", "df", six("ig"), six("chi"), six("score")
    )


# --- vectors and split -----------------------------------------------------


def _packed(vectors: DataFrame, *keys: str) -> DataFrame:
    """``id:millionths`` text of a vector, so that values compare exactly."""
    pairs = F.transform("features", lambda f: F.concat_ws(":", f["id"], F.round(f["w"] * 1e6).cast("long")))
    return vectors.select(*keys, F.array_join(pairs, " ").alias("vector"))


@query
def doc_term_weight(spark, sf_dir):
    written, run = bags_and_dictionary(spark, sf_dir)
    return weights.weigh_terms(counts.term_freq(written), run.dictionary, SETTINGS.max_broadcast_bytes).select(
        "doc_id", "term", "id", "tf", six("w")
    )


def _entries(spark, sf_dir, scale: str, max_broadcast_bytes: int) -> DataFrame:
    written, run = bags_and_dictionary(spark, sf_dir)
    vectors = weights.document_vectors(written, run.dictionary, scale, max_broadcast_bytes=max_broadcast_bytes)
    return weights.vector_entries(vectors).select("doc_id", "id", six("w"))


@query
def weights_minmax(spark, sf_dir):
    return _entries(spark, sf_dir, "minmax", SETTINGS.max_broadcast_bytes)


@query
def weights_max(spark, sf_dir):
    return _entries(spark, sf_dir, "max", SETTINGS.max_broadcast_bytes)


@query
def weights_minmax_shuffled(spark, sf_dir):
    """The lookup for a dictionary too large to broadcast, hot terms salted."""
    return _entries(spark, sf_dir, "minmax", 20_000)


@query
def doc_vectors(spark, sf_dir):
    written, run = bags_and_dictionary(spark, sf_dir)
    return _packed(weights.document_vectors(written, run.dictionary), "doc_id", "label")


@query
def split_vectors(spark, sf_dir):
    written, run = bags_and_dictionary(spark, sf_dir)
    return _packed(vectorize_corpus(written, run.dictionary, SETTINGS), "doc_id", "label", "split")


@query
def page_vectors(spark, sf_dir):
    """Serving vectors of all pages, empty ones included."""
    dictionary = dictionary_run(spark, sf_dir).dictionary
    pages = page_scan(spark, sf_dir)
    vectors = vectors_of_pages(pages, dictionary, "max", SETTINGS.max_broadcast_bytes)
    return _packed(vectors.withColumnRenamed("doc_id", "page_id"), "page_id", "url")


@query
def train_test_split(spark, sf_dir):
    return split.train_test_split(corpus(spark, sf_dir)).select("doc_id", "label", "split")


@query
def train_test_split_hashed(spark, sf_dir):
    return split.hash_split(corpus(spark, sf_dir)).select("doc_id", "label", "split")


@query
def split_vectors_hashed(spark, sf_dir):
    written, run = bags_and_dictionary(spark, sf_dir)
    return _packed(vectorize_corpus(written, run.dictionary, replace(SETTINGS, split_by_hash=True)), "doc_id", "label", "split")


@query
def kernel_projections(spark, sf_dir):
    """Sums of a document's weights times its features' frequencies, before the kernel's width."""
    written, run = bags_and_dictionary(spark, sf_dir)
    sums = projected_array(F.col("features"), SETTINGS.fourier_dims // 2, SETTINGS.seed)
    rows = weights.document_vectors(written, run.dictionary).select("doc_id", F.posexplode(sums).alias("dim", "value"))
    return rows.select("doc_id", "dim", F.round(F.col("value"), 4).alias("value"))


@query
def kernel_features(spark, sf_dir):
    """Fourier features of the training kernel: two waves for each projection."""
    written, run = bags_and_dictionary(spark, sf_dir)
    waves = fourier_array(F.col("features"), SETTINGS.fourier_dims, SETTINGS.gamma, SETTINGS.seed)
    rows = weights.document_vectors(written, run.dictionary).select("doc_id", F.posexplode(waves).alias("dim", "value"))
    return rows.select("doc_id", "dim", F.round(F.col("value"), 4).alias("value"))


# --- evaluation ------------------------------------------------------------


def quality_confusion(spark, sf_dir) -> DataFrame:
    """``labels.quality`` as truth against ``labels.toxic`` as the prediction."""
    pairs = table(spark, sf_dir, "labels").select(
        F.col("quality").cast("string").alias("label"), F.col("toxic").cast("string").alias("prediction")
    )
    # Class 2 never occurs and still counts in the means.
    return evaluation.confusion(pairs, category_source.categories_from_names(spark, ["0", "1", "2"]))


@query
def confusion(spark, sf_dir):
    return quality_confusion(spark, sf_dir)


@query
def class_metrics(spark, sf_dir):
    return evaluation.class_metrics(quality_confusion(spark, sf_dir)).select(
        "code", "label", six("recall"), six("precision"), six("fscore"), "a", "b", "c"
    )


@query
def overall_metrics(spark, sf_dir):
    metrics = evaluation.overall_metrics(evaluation.class_metrics(quality_confusion(spark, sf_dir)))
    return metrics.select(
        "total", "correct", six("accuracy"), six("mean_recall"), six("mean_precision"), six("mean_fscore")
    )


@query
def report_lines(spark, sf_dir):
    return evaluation.report_lines(evaluation.class_metrics(quality_confusion(spark, sf_dir)), QUALITY_SETTINGS)


def _quality_accepted(spark, sf_dir) -> DataFrame:
    """``labels.quality`` as category, accepted unless ``toxic``."""
    own = table(spark, sf_dir, "labels").select(
        F.col("quality").cast("string").alias("label"), (F.col("toxic") == 0).alias("accepted")
    )
    return evaluation.one_class_metrics(own, category_source.categories_from_names(spark, ["0", "1", "2"]))


@query
def one_class_metrics(spark, sf_dir):
    return _quality_accepted(spark, sf_dir).select("code", "label", six("accuracy"), "a", "b")


@query
def one_class_report_lines(spark, sf_dir):
    return evaluation.one_class_report_lines(_quality_accepted(spark, sf_dir), QUALITY_SETTINGS)


@query
def report_file(spark, sf_dir):
    """Two reports appended to one file, read back: every line twice as often."""
    path = shared_path(spark, "report")
    for _ in range(2):
        append_report(report_lines(spark, sf_dir), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


# --- models ----------------------------------------------------------------


@lru_cache(maxsize=4)
def prepared(spark: SparkSession, sf_dir: str) -> train.Prepared:
    """Dictionary and vectors of the corpus, written once per session and scale."""
    return train.prepare(corpus(spark, sf_dir), SETTINGS)


@lru_cache(maxsize=4)
def trained(spark: SparkSession, sf_dir: str) -> train.TrainingRun:
    return train.train_classifier(prepared(spark, sf_dir), SETTINGS)


@lru_cache(maxsize=4)
def trained_one_class(spark: SparkSession, sf_dir: str) -> one_class.OneClassModels:
    return train.train_one_class(prepared(spark, sf_dir), SETTINGS)


@query
def default_gamma(spark, sf_dir):
    """Kernel width of the training vectors where none is set."""
    return classifier.default_gamma(prepared(spark, sf_dir).part("train"))


@query
def svm_rbf_predict(spark, sf_dir):
    return train.held_out_predictions(trained(spark, sf_dir))


@query
def svm_class_metrics(spark, sf_dir):
    return train.evaluate(trained(spark, sf_dir))


@query
def model_roundtrip(spark, sf_dir):
    """Held-out predictions of the saved and reloaded classifier."""
    run = trained(spark, sf_dir)
    path = shared_path(spark, "classifier")
    run.classifier.save(path)
    again = train.TextClassifier.load(spark, path)
    return classifier.predict_labels(run.prepared.part("test"), again.model, again.labels)


@query
def one_class_predict(spark, sf_dir):
    accepted = one_class.accepted_labels(prepared(spark, sf_dir).part("test"), trained_one_class(spark, sf_dir))
    return one_class.own_class_accepted(accepted)


@query
def one_class_model_metrics(spark, sf_dir):
    return train.evaluate_one_class(trained_one_class(spark, sf_dir), prepared(spark, sf_dir))


@query
def classify_pages(spark, sf_dir):
    return label_pages(page_scan(spark, sf_dir), trained(spark, sf_dir).classifier)


@query
def classify_multi(spark, sf_dir):
    models, dictionary = trained_one_class(spark, sf_dir), prepared(spark, sf_dir).dictionary
    labelled = multi_label_pages(page_scan(spark, sf_dir), dictionary, models)
    return labelled.select("page_id", "url", F.array_join("labels", " ").alias("labels"))


@query
def classify_pages_stream(spark, sf_dir):
    """Pages drained as a stream into parquet, read back."""
    out, checkpoint = shared_path(spark, "labelled"), shared_path(spark, "stream")
    pages = page_source.stream_table(spark, f"{sf_dir}/pages.parquet")
    run = label_page_stream(pages, trained(spark, sf_dir).classifier, out, checkpoint, once=True)
    run.awaitTermination()
    return spark.read.parquet(out).select("page_id", "url", "prediction")


# --- what is exact about the models ----------------------------------------


@query
def svm_known_labels(spark, sf_dir):
    """Every held-out document has a category of the corpus as its prediction."""
    known = F.col("prediction").isin(list(trained(spark, sf_dir).classifier.labels))
    return svm_rbf_predict(spark, sf_dir).select("doc_id", "label", F.coalesce(known, F.lit(False)).alias("known"))


@query
def svm_class_rows(spark, sf_dir):
    """Held-out documents of each category, from the metrics."""
    return svm_class_metrics(spark, sf_dir).select("label", (F.col("a") + F.col("b")).cast("long").alias("docs"))


@query
def model_roundtrip_same(spark, sf_dir):
    """The reloaded classifier agrees with the saved one on every held-out document."""
    before = svm_rbf_predict(spark, sf_dir).select("doc_id", "label", F.col("prediction").alias("before"))
    return before.join(model_roundtrip(spark, sf_dir), ["doc_id", "label"]).select(
        "doc_id", "label", F.col("before").eqNullSafe(F.col("prediction")).alias("same")
    )


@query
def one_class_refusals(spark, sf_dir):
    """No category refuses more than the share nu of its own training documents."""
    accepted = one_class.accepted_labels(prepared(spark, sf_dir).part("train"), trained_one_class(spark, sf_dir))
    own = one_class.own_class_accepted(accepted).groupBy("label")
    counted = own.agg(F.count(F.lit(1)).alias("docs"), F.count_if(~F.col("accepted")).alias("refused"))
    return counted.select("label", "docs", (F.col("refused") <= F.floor(F.col("docs") * SETTINGS.default_nu)).alias("within"))


@query
def one_class_gamma(spark, sf_dir):
    """Kernel width of each category's model."""
    models = trained_one_class(spark, sf_dir)
    rows = [(label, float(gamma)) for label, gamma in zip(models.labels, models.gammas)]
    return spark.createDataFrame(rows, "label string, gamma double")


@query
def one_class_roundtrip_same(spark, sf_dir):
    """The reloaded one-class models agree with the saved ones on every held-out document."""
    models, test = trained_one_class(spark, sf_dir), prepared(spark, sf_dir).part("test")
    path = shared_path(spark, "one-class-models")
    models.save(spark, path)
    before = one_class.accepted_labels(test, models).select("doc_id", "label", F.col("accepted").alias("before"))
    after = one_class.accepted_labels(test, one_class.OneClassModels.load(spark, path))
    return before.join(after, ["doc_id", "label"]).select("doc_id", "label", (F.col("before") == F.col("accepted")).alias("same"))


@query
def label_line_file(spark, sf_dir):
    """Labelled pages written as lines and read back: url first, a category of the corpus last."""
    path = shared_path(spark, "label-lines")
    write_label_lines(classify_pages(spark, sf_dir), path)
    # A label follows a long url without a space.
    label = "(" + "|".join(trained(spark, sf_dir).classifier.labels) + r")\s*$"
    url = F.rtrim(F.regexp_replace("value", label, ""))
    lines = spark.read.text(path).select(url.alias("url"), F.col("value").rlike(label).alias("known"))
    return lines.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.every("known").alias("known"))


@query
def classify_pages_known(spark, sf_dir):
    """Every page has a category of the corpus as its label."""
    known = F.col("prediction").isin(list(trained(spark, sf_dir).classifier.labels))
    return classify_pages(spark, sf_dir).select("page_id", "url", F.coalesce(known, F.lit(False)).alias("known"))


@query
def classify_pages_twice(spark, sf_dir):
    """Repeated page rows stay apart: every row of the doubled table has a label of its own."""
    pages = page_scan(spark, sf_dir)
    labelled = label_pages(pages.unionAll(pages), trained(spark, sf_dir).classifier)
    return labelled.groupBy("page_id", "url").agg(F.count("prediction").alias("n"))


@query
def classify_multi_rows(spark, sf_dir):
    """Every page has one category or more, or ``unknown`` alone."""
    labels = F.split("labels", " ")
    alone = ~F.array_contains(labels, one_class.UNKNOWN) | (F.size(labels) == 1)
    return classify_multi(spark, sf_dir).select("page_id", "url", (alone & (F.col("labels") != "")).alias("labelled"))


@query
def classify_stream_same(spark, sf_dir):
    """The stream gives each page the label of the batch."""
    streamed = classify_pages_stream(spark, sf_dir).withColumnRenamed("prediction", "streamed")
    return classify_pages(spark, sf_dir).join(streamed, ["page_id", "url"]).select(
        "page_id", "url", F.col("prediction").eqNullSafe(F.col("streamed")).alias("same")
    )
