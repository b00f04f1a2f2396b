"""Multi-class kernel classifier: Fourier features and one linear SVM per class."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.kernel import RandomFourierFeatures
from corpusloom.session import materialize
from corpusloom.settings import Settings

# Kernel features a task works on per iteration.
TASK_BYTES = 32 << 20


def default_gamma(vectors: DataFrame) -> DataFrame:
    """One row ``(max_id, gamma)``: 1 / the largest feature id in use."""
    top = vectors.agg(F.max(F.array_max(F.col("features")["id"])).alias("max_id"))
    return top.select("max_id", (1.0 / F.col("max_id")).alias("gamma"))


def resolve_gamma(vectors: DataFrame, gamma: float) -> float:
    """``gamma``, or the default where it is 0."""
    return gamma if gamma > 0 else default_gamma(vectors).first()["gamma"] or 1.0


def label_code(labels: Sequence[str], label: str = "label") -> F.Column:
    """1-based code of a label column in ``labels`` (a few names, as a literal)."""
    return F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("int")


def fit_classifier(vectors: DataFrame, labels: Sequence[str], settings: Settings) -> PipelineModel:
    """Fit on ``(label, features)`` rows; classes are coded in ``labels`` order.

    A hinge loss weighted by the cost C against |w|^2 / 2 is MLlib's linear SVM
    with regParam = 1 / (C * rows). The kernel features are written out once,
    since every iteration of every class reads them. They are read in
    partitions worth a task each; where those leave cores idle, classes are
    fitted side by side. Each of those keeps its own cached copy, so a corpus
    that fills the cluster is fitted class by class.

    Categories without a training row are left out of the fit and are never
    predicted; where one category has all rows, every prediction is it, and
    without any row predictions are null.
    """
    gamma = resolve_gamma(vectors, settings.gamma)
    kernel = RandomFourierFeatures(dims=settings.fourier_dims, gamma=gamma, seed=settings.seed)
    coded = vectors.withColumn("class", (label_code(labels) - 1).cast("double"))
    ready = materialize(kernel.transform(coded).select("class", "kernel"), "kernel")
    counted = {r["class"]: r["count"] for r in ready.groupBy("class").count().collect()}  # one row per category
    present, rows = sorted(counted), sum(counted.values())
    if len(present) < 2:
        only = f"{present[0]}D" if present else "CAST(NULL AS DOUBLE)"
        return PipelineModel([kernel, SQLTransformer(statement=f"SELECT *, {only} AS class_prediction FROM __THIS__")])
    partitions = max(1, math.ceil(rows * settings.fourier_dims * 8 / TASK_BYTES))
    cores = ready.sparkSession.sparkContext.defaultParallelism
    svm = LinearSVC(
        regParam=1.0 / (settings.cost * max(1, rows)),
        maxIter=settings.max_iterations,
        tol=settings.tolerance,
        standardization=False,
    )
    one_vs_rest = OneVsRest(
        classifier=svm,
        featuresCol="kernel",
        labelCol="dense",
        predictionCol="dense_prediction",
        parallelism=min(len(present), max(1, cores // partitions)),
    )
    # The fit wants classes 0 .. k - 1 without gaps; predictions go back to label codes.
    dense = (F.array_position(F.array(*map(F.lit, present)), F.col("class")) - 1).cast("double")
    fitted = one_vs_rest.fit(ready.withColumn("dense", dense).coalesce(partitions))
    codes = ", ".join(f"{code}D" for code in present)
    back = f"SELECT *, element_at(array({codes}), CAST(dense_prediction AS INT) + 1) AS class_prediction FROM __THIS__"
    return PipelineModel([kernel, fitted, SQLTransformer(statement=back)])


def predict_labels(vectors: DataFrame, model: PipelineModel, labels: Sequence[str]) -> DataFrame:
    """Add ``prediction``, the category name; all columns but the vector stay."""
    names = F.array(*map(F.lit, labels))
    kept = [c for c in vectors.columns if c != "features"]
    return model.transform(vectors).select(
        *kept, F.get(names, F.col("class_prediction").cast("int")).alias("prediction")
    )
