"""Corpus counts: term bags, document frequency, class tables.

One text is one row, so a document's term counts are made inside the row. The
only wide step is the sum over (term, label), which combines on the map side
first: a term or a class that holds a third of all rows reaches the shuffle as
one row per task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scoring import class_pull, plogp
from corpusloom.functions.text import term_bag, tokens
from corpusloom.session import materialize
from corpusloom.sources.categories import bounded_rows, categories_from_names

# Categories up to which a term's counts are a sum per class: its counts then meet in one shuffle. More sums cost more than a second one.
DENSE_CATEGORIES = 8
# Fixed value: tokens of documents, or entries of bags, that a task counts at once; one document at least.
COUNTED_TOKENS = 1 << 21


def members(docs: DataFrame, categories: Sequence[str] | None) -> DataFrame:
    """The documents of the configured categories; all labelled ones if none are named."""
    label = F.col("label")
    return docs.where(label.isin(list(categories)) if categories else label.isNotNull())


def token_stream(docs: DataFrame) -> DataFrame:
    """One row per token, with its position counted from 1."""
    found = docs.select("doc_id", F.posexplode_outer(tokens(F.col("text"))).alias("pos", "term"))
    return found.where("term IS NOT NULL").select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "term"
    )


def term_bags(docs: DataFrame) -> DataFrame:
    """``(doc_id, label, bag)``: every document with its term counts, made where it is read.

    A table of :func:`bag_table` already is that.
    """
    if "bag" in docs.columns:
        return docs
    return docs.select("doc_id", "label", term_bag(F.col("text")).alias("bag"))


def bag_table(docs: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """The term bags of a corpus, written once for a run that needs them more than once.

    Dictionary, split and vectors take this table in place of the corpus: texts
    are read and cut into tokens once, and counts of documents and the split
    read its two narrow columns only.
    """
    return materialize(term_bags(members(docs, categories)), "bags")


def term_freq(bags: DataFrame) -> DataFrame:
    """``(doc_id, label, term, tf)``, one row per distinct term of a document."""
    # The outer form keeps the optimizer from evaluating the bag twice.
    return bags.select("doc_id", "label", F.inline_outer("bag")).where("term IS NOT NULL")


def class_counts(docs: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """``(code, label, n_docs)``, one row per category, 0 for an empty one."""
    counts = docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))
    if categories:
        # Both sides hold one row per category.
        named = categories_from_names(docs.sparkSession, categories)
        return named.join(counts, "label", "left").select(
            "code", "label", F.coalesce("n_docs", F.lit(0)).alias("n_docs")
        )
    rows = bounded_rows(counts, F.struct("label", "n_docs"))
    return rows.select(F.posexplode("rows").alias("pos", "row")).select(
        (F.col("pos") + 1).alias("code"), "row.label", "row.n_docs"
    )


def class_entropy(classes: DataFrame) -> DataFrame:
    """One row ``(n, entropy)``: corpus size and negative class entropy."""
    totals = CorpusTotals.of(classes)
    terms = plogp(F.col("n_docs"), F.lit(float(totals.n)))
    return classes.agg(F.sum("n_docs").alias("n"), F.sum(terms).alias("entropy"))


@dataclass(frozen=True)
class CorpusTotals:
    """Documents per category, in code order: one number per category."""

    labels: tuple[str, ...]
    n_docs: tuple[int, ...]

    @classmethod
    def of(cls, classes: DataFrame) -> "CorpusTotals":
        rows = classes.orderBy("code").collect()  # one row per category
        return cls(tuple(r["label"] for r in rows), tuple(r["n_docs"] for r in rows))

    @property
    def n(self) -> int:
        return sum(self.n_docs)

    @property
    def entropy(self) -> float:
        return sum(c / self.n * math.log2(c / self.n) for c in self.n_docs if c)

    def _per_class(self, of_class: Callable[[Column], Column]) -> Column:
        rows = [[label, float(n_c), class_pull(n_c, self.n)] for label, n_c in zip(self.labels, self.n_docs)]
        # One value that is parsed once, however many categories: no expression per category.
        named = json.dumps([dict(zip(("label", "n_docs", "pull"), row)) for row in rows])
        return F.transform(F.from_json(F.lit(named), "array<struct<label:string,n_docs:double,pull:double>>"), of_class)

    def cells(self, by_label: Column) -> Column:
        """Per category a struct of doubles ``a, n_docs, pull``; a = 0 where ``by_label`` has no entry."""
        return self._per_class(
            lambda c: F.struct(
                F.coalesce(F.try_element_at(by_label, c["label"])["a"].cast("double"), F.lit(0.0)).alias("a"),
                c["n_docs"].alias("n_docs"),
                c["pull"].alias("pull"),
            )
        )

    def class_tf(self, by_label: Column) -> Column:
        """Term frequency per category, 0 where ``by_label`` has no entry."""
        return self._per_class(lambda c: F.coalesce(F.try_element_at(by_label, c["label"])["tf"], F.lit(0)))


def label_term_counts(bags: DataFrame) -> DataFrame:
    """``(term, label, a, tf)``: documents of the class with the term, and its tf there."""
    return (
        bags.select("label", F.inline_outer("bag"))
        .where("term IS NOT NULL")
        .groupBy("term", "label")
        .agg(F.count(F.lit(1)).alias("a"), F.sum("tf").alias("tf"))
    )


def doc_freq(bags: DataFrame) -> DataFrame:
    """``(term, df)``: every document counts a term once."""
    return (
        bags.select(F.inline_outer("bag"))
        .where("term IS NOT NULL")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def term_profiles(label_terms: DataFrame) -> DataFrame:
    """``(term, df, by_label)``: one row per term with its counts per class.

    A term brings at most one row per class to this step, whatever its frequency,
    and ``by_label`` names only the classes that hold the term.
    """
    return label_terms.groupBy("term").agg(
        F.sum("a").alias("df"),
        F.map_from_entries(F.collect_list(F.struct("label", F.struct("a", "tf")))).alias("by_label"),
    )


def dense_profiles(bags: DataFrame, labels: Sequence[str]) -> DataFrame:
    """:func:`term_profiles` of few categories, all of which are in ``labels``: one sum per class and one shuffle, on the term."""
    labels = list(dict.fromkeys(labels))
    code = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int").alias("code")
    rows = bags.select(code, F.inline_outer("bag")).where("term IS NOT NULL")
    sums = [
        F.sum(F.when(F.col("code") == at, value)).alias(f"{name}{at}")
        for at in range(1, len(labels) + 1)
        for name, value in (("a", F.lit(1)), ("tf", F.col("tf")))
    ]
    counted = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), *sums)
    cells = [
        F.when(F.col(f"a{at}").isNotNull(), F.struct(F.lit(label).alias("label"), F.struct(F.col(f"a{at}").alias("a"), F.col(f"tf{at}").alias("tf"))))
        for at, label in enumerate(labels, 1)
    ]
    return counted.select("term", "df", F.map_from_entries(F.array_compact(F.array(*cells))).alias("by_label"))


def _combined(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(term, label, a, tf)`` of some documents with ``label``, ``_terms`` and, where these differ, ``_tf``."""
    listed, names = batch.column("_terms"), batch.column("label").dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
    own, coded = np.repeat(np.arange(len(batch)), sizes), listed.flatten().dictionary_encode()
    code, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    if "_tf" in batch.schema.names:
        tf = batch.column("_tf").flatten().to_numpy(zero_copy_only=False)
    else:
        held, tf = np.unique(own * width + code, return_counts=True)
        own, code = held // width, held % width
    count = max(1, len(names.dictionary))
    pair, place = np.unique(code * count + names.indices.to_numpy(zero_copy_only=False)[own], return_inverse=True)
    # Sums of whole numbers of one batch, exact in a double.
    sums = np.bincount(place, weights=tf, minlength=len(pair)).astype(np.int64)
    columns = [coded.dictionary.take(pa.array(pair // count)), names.dictionary.take(pa.array(pair % count))]
    columns += [pa.array(np.bincount(place, minlength=len(pair)).astype(np.int64)), pa.array(sums)]
    return pa.RecordBatch.from_arrays(columns, names=["term", "label", "a", "tf"])


def combined_counts(docs: DataFrame) -> DataFrame:
    """:func:`label_term_counts` of labelled documents or bags, laid out by term.

    Documents are counted many at a time where they are read, without a bag
    for each, and a batch sends a row for each of its terms and labels.
    """
    if "bag" in docs.columns:
        rows = docs.select("label", F.col("bag.term").alias("_terms"), F.col("bag.tf").alias("_tf"))
    else:
        rows = docs.select("label", tokens(F.col("text")).alias("_terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_terms")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(ends):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + COUNTED_TOKENS, side="right")))
                yield _combined(batch.slice(start, stop - start))
                start = stop

    counted = rows.mapInArrow(run, "term string, label string, a bigint, tf bigint")
    return counted.repartition("term").groupBy("term", "label").agg(F.sum("a").alias("a"), F.sum("tf").alias("tf"))


def profiles(docs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``(term, df, by_label)`` of a corpus, or its bags, whose categories are ``labels``."""
    if 0 < len(labels) <= DENSE_CATEGORIES:
        return dense_profiles(term_bags(docs), labels)
    return term_profiles(combined_counts(docs))


def candidates(terms: DataFrame) -> DataFrame:
    """Terms that may enter a dictionary: longer than one character, in two documents."""
    return terms.where((F.length("term") > 1) & (F.col("df") > 1))
