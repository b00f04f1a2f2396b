"""Random Fourier features for the RBF kernel exp(-gamma * |x - y|^2)
(Rahimi and Recht, 2007).

The frequencies of a feature id are drawn from a counter-based generator keyed
by (seed, id), so a task makes only the rows its documents need and nothing
that grows with the dictionary is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Features whose ids are looked up at once inside a task, ids drawn at once, and features of a document summed at once:
# the first bounds its memory, the others are small enough for a core's cache.
BLOCK_FEATURES = 32_768
DRAWN_IDS = 256
SUMMED_FEATURES = 2_048
# Ids whose frequencies a Python worker keeps: those it meets first, and so most of the frequent ones.
KEPT_IDS = 131_072

# Constants of the splitmix64 generator.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def _uniforms(counter: np.ndarray) -> np.ndarray:
    """Uniforms in (0, 1) from 64-bit counters."""
    z = counter * np.uint64(GOLDEN)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def frequencies(ids: np.ndarray, count: int, gamma: float, seed: int) -> np.ndarray:
    """One row of ``count`` N(0, 2 gamma) draws per feature id."""
    table = np.empty((len(ids), count))
    for first in range(0, len(ids), DRAWN_IDS):
        part = slice(first, first + DRAWN_IDS)
        table[part] = _normals(ids[part], count, seed) * np.sqrt(2.0 * gamma)
    return table


def _normals(ids: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Standard normals by the Box-Muller transform."""
    half = (count + 1) // 2
    steps = np.arange(1, 2 * half + 1, dtype=np.uint64)
    start = ids.astype(np.uint64)[:, None] * np.uint64(2 * half) + np.uint64((seed * MIX_1) % 2**64)
    u = _uniforms(start + steps[None, :])
    radius = np.sqrt(-2.0 * np.log(u[:, :half]))
    angle = 2.0 * np.pi * u[:, half:]
    return np.concatenate([radius * np.cos(angle), radius * np.sin(angle)], axis=1)[:, :count]


class Drawn:
    """Frequencies of unit width, drawn once for the first ``KEPT_IDS`` ids and again for others."""

    def __init__(self, count: int, seed: int):
        self.count, self.seed = count, seed
        # Sorted ids and their places in the table, which is filled from the top; after the kept ones come those of a block.
        self.ids, self.places = np.empty(0, np.int64), np.empty(0, np.int64)
        self.table = np.empty((KEPT_IDS + BLOCK_FEATURES, count))

    def places_of(self, unique: np.ndarray) -> np.ndarray:
        """The row in ``table`` of each of some sorted ids; the next call may overwrite those that are not kept."""
        at = np.searchsorted(self.ids, unique)
        kept = np.zeros(len(unique), bool)
        inside = at < len(self.ids)
        kept[inside] = self.ids[at[inside]] == unique[inside]
        places = np.empty(len(unique), np.int64)
        places[kept] = self.places[at[kept]]
        new = np.flatnonzero(~kept)
        filled = len(self.ids)
        keep = new[: KEPT_IDS - filled]
        places[keep] = np.arange(filled, filled + len(keep))
        rest = new[len(keep) :]
        places[rest] = np.arange(KEPT_IDS, KEPT_IDS + len(rest))
        if KEPT_IDS + len(rest) > len(self.table):
            # A document longer than a block.
            self.table = np.concatenate([self.table, np.empty((KEPT_IDS + len(rest) - len(self.table), self.count))])
        # Frequencies of width 1/2 have variance 1.
        for some in (keep, rest):
            for first in range(0, len(some), DRAWN_IDS):
                part = some[first : first + DRAWN_IDS]
                self.table[places[part[0]] : places[part[0]] + len(part)] = frequencies(unique[part], self.count, 0.5, self.seed)
        self.places = np.insert(self.places, at[keep], places[keep])
        self.ids = np.insert(self.ids, at[keep], unique[keep])
        return places


@lru_cache(maxsize=1)
def kept_draws(count: int, seed: int) -> Drawn:
    """The draws of this Python worker, for all its tasks: drawing costs more than using them, and a task has few documents for an id."""
    return Drawn(count, seed)


def projections(ids: pd.Series, weights: pd.Series, count: int, seed: int, drawn: Drawn | None = None) -> np.ndarray:
    """Rows wx for ``count`` frequencies of unit width; an empty vector is x = 0.

    A row's sums do not depend on the rows around it. A task hands the same ``drawn`` to all its calls.
    """
    drawn = drawn or Drawn(count, seed)
    sizes = np.fromiter((len(x) for x in ids), dtype=np.int64, count=len(ids))
    projected = np.zeros((len(ids), count))
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ids):
        base = ends[first - 1] if first else 0
        # At least one whole document per block.
        last = max(first + 1, int(np.searchsorted(ends, base + BLOCK_FEATURES, side="right")))
        block_ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids.iloc[first:last]])
        unique, position = np.unique(block_ids, return_inverse=True)
        block_weights = np.concatenate([np.asarray(x, dtype=np.float64) for x in weights.iloc[first:last]])
        rows = drawn.places_of(unique)[position]
        # A product per document, and per piece of a long one: frequencies are gathered into a core's cache and read once.
        for row in first + np.flatnonzero(sizes[first:last]):
            for start in range(ends[row] - sizes[row] - base, ends[row] - base, SUMMED_FEATURES):
                here = slice(start, min(start + SUMMED_FEATURES, ends[row] - base))
                projected[row] += block_weights[here] @ drawn.table[rows[here]]
        first = last
    return projected


def waves(projected: np.ndarray, gamma: float) -> np.ndarray:
    """Feature rows [cos(wx), sin(wx)] / sqrt(dims / 2) of the kernel of width ``gamma``."""
    angles = projected * np.sqrt(2.0 * gamma)
    return np.concatenate([np.cos(angles), np.sin(angles)], axis=1) / np.sqrt(projected.shape[1])


def fourier_rows(
    ids: pd.Series, weights: pd.Series, dims: int, gamma: float, seed: int, drawn: Drawn | None = None
) -> np.ndarray:
    return waves(projections(ids, weights, dims // 2, seed, drawn), gamma)


def projected_array(features: Column, count: int, seed: int) -> Column:
    """:func:`projections` of a sparse ``array<struct<id,w>>`` as ``array<double>``."""

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        drawn = kept_draws(count, seed)
        for ids, weights in batches:
            yield pd.Series(list(projections(ids, weights, count, seed, drawn)))

    return project(features["id"], features["w"])


def fourier_array(features: Column, dims: int, gamma: float, seed: int) -> Column:
    """Fourier features of a sparse ``array<struct<id,w>>`` as ``array<double>``."""

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        drawn = kept_draws(dims // 2, seed)
        for ids, weights in batches:
            yield pd.Series(list(fourier_rows(ids, weights, dims, gamma, seed, drawn)))

    return project(features["id"], features["w"])


class RandomFourierFeatures(
    Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """Pipeline stage from ``array<struct<id,w>>`` to an MLlib vector."""

    dims = Param(Params._dummy(), "dims", "even number of output dimensions", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "RBF kernel width", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, dims=256, gamma=0.125, seed=42, inputCol="features", outputCol="kernel"):
        super().__init__()
        self._setDefault(dims=256, gamma=0.125, seed=42, inputCol="features", outputCol="kernel")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column = fourier_array(
            F.col(self.getInputCol()),
            self.getOrDefault(self.dims),
            self.getOrDefault(self.gamma),
            self.getSeed(),
        )
        return dataset.withColumn(self.getOutputCol(), array_to_vector(column))
