"""Run 1: corpus -> scored and pruned term dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import counts, selection
from corpusloom.session import materialize, release
from corpusloom.settings import Settings
from corpusloom.sources.dictionary import write_dictionary, write_dictionary_text


@dataclass(frozen=True)
class DictionaryRun:
    """The pieces of a dictionary run. ``scored`` is a written table."""

    totals: counts.CorpusTotals
    scored: DataFrame
    dictionary: DataFrame

    @property
    def meta(self) -> DataFrame:
        """``(n, max_id)``; ids are dense before pruning."""
        max_id = F.coalesce(F.max("id"), F.lit(0)).cast("long")
        return self.scored.agg(F.lit(self.totals.n).cast("long").alias("n"), max_id.alias("max_id"))

    def with_class_arrays(self) -> DataFrame:
        return selection.class_arrays(self.dictionary, self.totals)

    def save(self, path: str) -> None:
        write_dictionary(self.with_class_arrays(), self.meta, path)

    def save_text(self, path: str) -> None:
        write_dictionary_text(self.with_class_arrays(), self.meta, path)


def candidate_profiles(docs: DataFrame, settings: Settings) -> tuple[DataFrame, counts.CorpusTotals]:
    """``(term, df, by_label)`` of all candidate terms, and the class totals.

    The texts are read once; the totals come from a scan of the label column.
    """
    docs = counts.members(docs, settings.category_names)
    totals = counts.CorpusTotals.of(counts.class_counts(docs, settings.category_names))
    return counts.candidates(counts.profiles(docs, totals.labels)), totals


def score_corpus(docs: DataFrame, settings: Settings) -> tuple[DataFrame, counts.CorpusTotals]:
    """Scores of all candidate terms without ids: nothing is sorted or written."""
    profiles, totals = candidate_profiles(docs, settings)
    return selection.score_terms(profiles, totals), totals


def build_dictionary(docs: DataFrame, settings: Settings) -> DictionaryRun:
    """Score the terms of a corpus against its categories and keep the telling ones.

    The counts of candidate terms are written once, since the sort by term reads
    them twice. The id assignment writes one scored row per candidate term to
    the shared folder; pruning is a filter on that table.
    """
    profiles, totals = candidate_profiles(docs, settings)
    profiles = materialize(profiles, "profiles")
    scored = selection.feature_ids(profiles, lambda rows: selection.score_terms(rows, totals))
    release(profiles)
    return DictionaryRun(totals, scored, selection.select_terms(scored, settings.score_threshold))
