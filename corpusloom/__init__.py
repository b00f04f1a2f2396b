"""Labelled-corpus analytics on Spark: term statistics, term selection,
sparse document vectors, kernel classifiers and page labelling."""

from corpusloom.settings import Settings

__all__ = ["Settings"]
