"""One-class models: is a document close enough to what a category holds?

A category is summarised by the mean of its Fourier features, so a score is the
mean kernel value against all its training documents. At nu = 1 this is the
exact one-class SVM solution (all multipliers equal); for smaller nu it is the
Parzen density with the same share nu of training documents left outside.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.classifier import label_code
from corpusloom.operators.indexing import value_at_rank
from corpusloom.operators.kernel import kept_draws, projected_array, projections, waves
from corpusloom.session import materialize
from corpusloom.settings import Settings

UNKNOWN = "unknown"


@dataclass(frozen=True)
class OneClassModels:
    """One mean, cut and kernel width per category: categories x dims numbers in all."""

    labels: tuple[str, ...]
    means: np.ndarray
    cuts: np.ndarray
    gammas: np.ndarray
    seed: int

    def own_scores(self, projected: np.ndarray, code: int) -> np.ndarray:
        """Scores against one category. A row's score does not depend on the rows around it."""
        return (waves(projected, self.gammas[code]) * self.means[code]).sum(axis=1)

    def scores(self, features: Column) -> Column:
        """Score against every category, in ``labels`` order."""

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            drawn = kept_draws(self.means.shape[1] // 2, self.seed)
            for ids, weights in batches:
                projected = projections(ids, weights, self.means.shape[1] // 2, self.seed, drawn)
                columns = [self.own_scores(projected, code) for code in range(len(self.labels))]
                yield pd.Series(list(np.stack(columns, axis=1)))

        return score(features["id"], features["w"])

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (code, label, mean.tolist(), float(cut), float(gamma), self.seed)
            for code, (label, mean, cut, gamma) in enumerate(zip(self.labels, self.means, self.cuts, self.gammas), 1)
        ]
        schema = "code int, label string, mean array<double>, cut double, gamma double, seed long"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "OneClassModels":
        rows = spark.read.parquet(path).orderBy("code").collect()  # one row per category
        means, cuts, gammas = (np.array([r[c] for r in rows]) for c in ("mean", "cut", "gamma"))
        return cls(tuple(r["label"] for r in rows), means, cuts, gammas, rows[0]["seed"])


def default_gammas(vectors: DataFrame) -> DataFrame:
    """``(label, max_id, gamma)``: 1 / the largest feature id in a category's own rows."""
    top = F.max(F.array_max(F.col("features")["id"])).alias("max_id")
    return vectors.groupBy("label").agg(top).select("label", "max_id", (1.0 / F.col("max_id")).alias("gamma"))


def fit_one_class(vectors: DataFrame, labels: Sequence[str], settings: Settings, gamma: float = 0.0) -> OneClassModels:
    """Fit all categories together on ``(doc_id, label, features)`` rows.

    ``gamma`` is the width of every category, or 0 for each one's own default.
    The cut of a category is the exact score at rank floor(nu * n) + 1 of its
    own documents; where nu leaves no such rank, the category accepts nothing.
    Documents are projected once and written, since means and cuts read them.
    """
    half = settings.fourier_dims // 2
    own_gamma = {}
    if gamma <= 0:
        own_gamma = {r["label"]: r["gamma"] for r in default_gammas(vectors).collect()}  # one row per category
    gammas = np.array([gamma if gamma > 0 else own_gamma.get(label) or 1.0 for label in labels])
    code = (label_code(labels) - 1).alias("code")
    projected = projected_array(F.col("features"), half, settings.seed).alias("projected")
    rows = materialize(vectors.select("doc_id", "label", code, projected).where("code >= 0"), "projected")

    width = F.get(F.array(*[F.lit(float(np.sqrt(2.0 * g))) for g in gammas]), F.col("code"))
    angles = rows.select("label", F.transform("projected", lambda x: x * width).alias("angles"))
    kernel = array_to_vector(F.concat(F.transform("angles", F.cos), F.transform("angles", F.sin)))
    means = angles.groupBy("label").agg(Summarizer.mean(kernel).alias("mean")).collect()  # one row per category
    found = {row["label"]: row["mean"].toArray() / np.sqrt(half) for row in means}
    means = np.array([found.get(label, np.zeros(2 * half)) for label in labels])
    models = OneClassModels(tuple(labels), means, np.full(len(labels), np.inf), gammas, settings.seed)

    @F.pandas_udf("double")
    def own_score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for codes, values in batches:
            codes, values = codes.to_numpy(), np.array(values.tolist()).reshape(len(values), half)
            out = np.zeros(len(codes))
            for c in np.unique(codes):
                out[codes == c] = models.own_scores(values[codes == c], c)
            yield pd.Series(out)

    own = rows.select("doc_id", "label", own_score("code", "projected").alias("score"))
    nu = F.create_map(*[F.lit(x) for label in labels for x in (label, settings.nu_of(label))])
    rank = F.floor(F.col("n") * F.try_element_at(nu, F.col("label"))) + 1
    cuts = {
        row["label"]: row["cut"]
        for row in value_at_rank(own, "label", ["score", "doc_id"], rank).collect()  # one row per category
        if row["cut"] is not None
    }
    cuts = np.array([cuts.get(label, np.inf) for label in labels])
    return OneClassModels(models.labels, means, cuts, gammas, settings.seed)


def accepted_labels(vectors: DataFrame, models: OneClassModels) -> DataFrame:
    """Add ``accepted``: every category whose model takes the document."""
    kept = [c for c in vectors.columns if c != "features"]
    names = F.array(*map(F.lit, models.labels))
    cuts = F.array(*[F.lit(float(c)) for c in models.cuts])
    scored = vectors.select(*kept, models.scores(F.col("features")).alias("_scores"))
    hits = F.filter(
        F.transform(
            F.arrays_zip(names.alias("label"), cuts.alias("cut"), F.col("_scores").alias("score")),
            lambda x: F.when(x["score"] >= x["cut"], x["label"]),
        ),
        lambda label: label.isNotNull(),
    )
    return scored.select(*kept, hits.alias("accepted"))


def multi_labels(accepted: DataFrame) -> DataFrame:
    """Accepted categories, or the single label ``unknown``."""
    labels = F.when(F.size("accepted") == 0, F.array(F.lit(UNKNOWN))).otherwise(F.col("accepted"))
    return accepted.withColumn("accepted", labels).withColumnRenamed("accepted", "labels")


def own_class_accepted(accepted: DataFrame) -> DataFrame:
    """``(doc_id, label, accepted)``: does the own category's model take the document?"""
    return accepted.select("doc_id", "label", F.array_contains("accepted", F.col("label")).alias("accepted"))
