"""Run 3: vectors -> models, their held-out evaluation and its report."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import classifier, counts, evaluation, one_class
from corpusloom.plans.dictionary import build_dictionary
from corpusloom.plans.vectorize import vectorize_corpus
from corpusloom.session import materialize, release
from corpusloom.settings import MAX_BROADCAST_BYTES, Settings
from corpusloom.sources.categories import categories_from_names
from corpusloom.sources.results import append_report


@dataclass(frozen=True)
class TextClassifier:
    """What labelling needs: dictionary, category names in code order, model, scale."""

    dictionary: DataFrame
    labels: tuple[str, ...]
    model: PipelineModel
    scale: str = "minmax"
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES

    def save(self, path: str) -> None:
        spark = self.dictionary.sparkSession
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        categories_from_names(spark, self.labels).write.mode("overwrite").parquet(f"{path}/labels")
        options = [(self.scale, self.max_broadcast_bytes)]
        options = spark.createDataFrame(options, "scale string, max_broadcast_bytes long")
        options.write.mode("overwrite").parquet(f"{path}/options")
        self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextClassifier":
        labels = spark.read.parquet(f"{path}/labels").orderBy("code").collect()  # one row per category
        options = spark.read.parquet(f"{path}/options").first()
        return cls(
            spark.read.parquet(f"{path}/dictionary"),
            tuple(row["label"] for row in labels),
            PipelineModel.load(f"{path}/model"),
            options["scale"],
            options["max_broadcast_bytes"],
        )


@dataclass(frozen=True)
class Prepared:
    """Dictionary and split vectors of a corpus, both written tables, and its category names."""

    dictionary: DataFrame
    vectors: DataFrame
    labels: tuple[str, ...]
    scale: str

    def part(self, split: str) -> DataFrame:
        """``(doc_id, label, features)`` of ``train`` or ``test``."""
        return self.vectors.where(F.col("split") == split).drop("split")


@dataclass(frozen=True)
class TrainingRun:
    classifier: TextClassifier
    prepared: Prepared


def prepare(docs: DataFrame, settings: Settings, scale: str = "minmax") -> Prepared:
    """What every kind of training starts from. Texts are read once, into a table of term bags that is released at the end."""
    bags = counts.bag_table(docs, settings.category_names)
    run = build_dictionary(bags, settings)
    vectors = materialize(vectorize_corpus(bags, run.dictionary, settings, scale), "vectors")
    release(bags)
    return Prepared(run.dictionary, vectors, run.totals.labels, scale)


def train_classifier(prepared: Prepared, settings: Settings) -> TrainingRun:
    """Fit the multi-class model on the training part.

    The scale of the vectors serves both sides, so that labelling sees weights
    as training did; :func:`with_serving_scale` restores the historic mix.
    """
    model = classifier.fit_classifier(prepared.part("train"), prepared.labels, settings)
    made = TextClassifier(
        prepared.dictionary, prepared.labels, model, prepared.scale, settings.max_broadcast_bytes
    )
    return TrainingRun(made, prepared)


def with_serving_scale(text_classifier: TextClassifier, scale: str = "max") -> TextClassifier:
    """The same classifier, labelling with another scale than it was trained on."""
    return replace(text_classifier, scale=scale)


def held_out_predictions(run: TrainingRun) -> DataFrame:
    """``(doc_id, label, prediction)`` of the test documents."""
    return classifier.predict_labels(run.prepared.part("test"), run.classifier.model, run.classifier.labels)


def evaluate(run: TrainingRun) -> DataFrame:
    """Held-out metrics per category."""
    predictions = held_out_predictions(run)
    categories = categories_from_names(predictions.sparkSession, run.classifier.labels)
    return evaluation.class_metrics(evaluation.confusion(predictions, categories))


def train_and_report(docs: DataFrame, settings: Settings, report_path: str) -> TrainingRun:
    """Train, evaluate on the held-out part, append the report."""
    run = train_classifier(prepare(docs, settings), settings)
    metrics = materialize(evaluate(run), "metrics")
    append_report(evaluation.report_lines(metrics, settings), report_path)
    return run


def train_one_class(prepared: Prepared, settings: Settings) -> one_class.OneClassModels:
    """One model per category from its training documents."""
    return one_class.fit_one_class(prepared.part("train"), prepared.labels, settings)


def evaluate_one_class(models: one_class.OneClassModels, prepared: Prepared) -> DataFrame:
    """Held-out acceptance per category."""
    own = one_class.own_class_accepted(one_class.accepted_labels(prepared.part("test"), models))
    categories = categories_from_names(own.sparkSession, models.labels)
    return evaluation.one_class_metrics(own, categories)


def one_class_report(
    models: one_class.OneClassModels, prepared: Prepared, settings: Settings, report_path: str
) -> DataFrame:
    """Held-out acceptance per category; the report is appended to ``report_path``."""
    metrics = materialize(evaluate_one_class(models, prepared), "metrics")
    append_report(evaluation.one_class_report_lines(metrics, settings), report_path)
    return metrics
