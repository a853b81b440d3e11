"""Attributions of boosted trees: interventional Shapley values over a background, exact.

A leaf's value counts for a row x against a background row z by the features on
its path alone: those that only x sends towards the leaf, those that only z
does, and those that neither does, which rule it out. So a leaf needs of x and
of z no more than a pattern, one bit a feature of its path. The background is
reduced to the counts of its patterns at each leaf.

Rows that no threshold of any tree parts take the same way through all trees
and are explained alike. So each row is moved to the upper ends of its bins
between thresholds, its cell; different cells are explained once, over the
tasks, and joined to their rows. Trees cut a column into a bounded number of
bins, so the work on leaves is bounded whatever the rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatquery.operators.cells import CELLS
from threatquery.sources.sinks import materialise

#: Rows of the background, a sample by hash.
BACKGROUND = 100
#: Features of a path; a table has 4 to this power rows.
PATH = 10
_NODE = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)|Predict: (\S+)")


@dataclass
class Leaf:
    """value, and for each feature of its path the interval (low, high] that leads to it."""

    value: float
    features: list[int]
    low: np.ndarray
    high: np.ndarray

    def patterns(self, x: np.ndarray) -> np.ndarray:
        """Bit j: whether the row's value lies in the interval of the path's jth feature."""
        own = x[:, self.features]
        return ((own > self.low) & (own <= self.high)) @ (1 << np.arange(len(self.features)))


def leaves_of(text: str, weight: float) -> list[Leaf]:
    """The leaves of a tree as MLlib prints it."""
    out: list[Leaf] = []
    path: list[tuple[int, int, bool, float]] = []  # depth, feature, whether at most, threshold
    for line in text.splitlines()[1:]:
        if not line.strip():
            continue
        if not (m := _NODE.search(line)):
            raise ValueError(f"a line of a tree that isn't known: {line.strip()}")
        depth = len(line) - len(line.lstrip())
        while path and path[-1][0] >= depth:
            path.pop()
        if m[5] is None:
            path.append((depth, int(m[2]), m[3] == "<=", float(m[4])))
            continue
        bounds: dict[int, tuple[float, float]] = {}
        for _, f, at_most, cut in path:
            low, high = bounds.get(f, (-np.inf, np.inf))
            bounds[f] = (low, min(high, cut)) if at_most else (max(low, cut), high)
        features = sorted(bounds)
        out.append(Leaf(weight * float(m[5]), features, np.array([bounds[f][0] for f in features]), np.array([bounds[f][1] for f in features])))
    return out


def cuts_of(leaves: list[Leaf], d: int) -> list[np.ndarray]:
    """The thresholds of each of ``d`` features, in order."""
    held: list[set[float]] = [set() for _ in range(d)]
    for leaf in leaves:
        for f, low, high in zip(leaf.features, leaf.low.tolist(), leaf.high.tolist(), strict=True):
            held[f] |= {low, high}
    return [np.array(sorted(v for v in x if np.isfinite(v))) for x in held]


def moved(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Each value at the upper end of its bin, infinity in the last: no threshold lies between the two."""
    return np.column_stack([np.append(c, np.inf)[np.searchsorted(c, x[:, k], "left")] for k, c in enumerate(cuts)])


@lru_cache(maxsize=16)
def shares(d: int) -> np.ndarray:
    """[pattern of x, pattern of z, feature]: the share of a leaf's value that the feature gets, for a path of ``d`` features."""
    if d > PATH:
        raise ValueError(f"a path of {d} features, of {PATH} at most")
    every = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    x, z = every[:, None, :].astype(bool), every[None, :, :].astype(bool)
    mine, other = x & ~z, ~x & z
    a, b = mine.sum(2)[..., None], other.sum(2)[..., None]
    f = np.array([factorial(k) for k in range(d + 1)], float)
    whole = f[np.minimum(a + b, d)]
    out = np.where(mine, f[np.maximum(a - 1, 0)] * f[b] / whole, 0) - np.where(other, f[a] * f[np.maximum(b - 1, 0)] / whole, 0)
    out[(~x & ~z).any(2)] = 0
    return out


class Explainer:
    """Leaves with the counts of the background's patterns; ``base`` is the background's mean margin."""

    def __init__(self, leaves: list[Leaf], background: np.ndarray):
        self.leaves = leaves
        self.counts = [np.bincount(x.patterns(background), minlength=1 << len(x.features)) / len(background) for x in leaves]
        self.base = float(self.margins(background).mean())

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for leaf in self.leaves:
            out[leaf.patterns(x) == (1 << len(leaf.features)) - 1] += leaf.value
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        """A row of attributions for each row; with ``base`` they add up to its margin."""
        out = np.zeros(x.shape)
        for leaf, counts in zip(self.leaves, self.counts, strict=True):
            if leaf.features:
                table = leaf.value * np.einsum("xzf,z->xf", shares(len(leaf.features)), counts)
                out[:, leaf.features] += table[leaf.patterns(x)]
        return out


def tree_shap(rows: DataFrame, background: DataFrame, model, columns: list[str], key: str) -> DataFrame:
    """key, margin (of class 1, as the model has it) and the attribution of each of ``columns`` towards class 0.

    ``model``: fitted boosted trees of MLlib or over cells, over ``columns``, in
    this order and without nulls. ``background``: some hundred rows, which reach
    the driver. The query fails where a row's attributions don't add up to the
    margin that the model itself gives.
    """
    leaves = [x for tree, weight in zip(model.trees, model.treeWeights, strict=True) for x in leaves_of(tree.toDebugString, weight)]
    sample = background.select(*[F.col(c).cast("double") for c in columns]).toPandas().to_numpy(float)
    cuts, context = cuts_of(leaves, len(columns)), rows.sparkSession.sparkContext
    shared = context.broadcast(Explainer(leaves, sample))

    @F.pandas_udf("array<double>")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(list(moved(np.stack(x.to_list()), cuts)) if len(x) else [], dtype=object)

    def explain(batches):
        for pdf in batches:
            if len(pdf):
                values = shared.value.values(np.stack(pdf["_cell"].to_list()))
                yield pd.DataFrame({"_cell": pdf["_cell"], "_values": list(-values), "_sum": shared.value.base + values.sum(1)})

    inputs = rows.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    placed = inputs.withColumn("_cell", cell(F.array(*[F.col(c) for c in columns])))
    cells = placed.select("_cell").distinct().repartition(context.defaultParallelism)
    explained = materialise(cells.mapInPandas(explain, "_cell array<double>, _values array<double>, _sum double"), "explained")
    if np.prod([len(c) + 1.0 for c in cuts]) <= CELLS:
        explained = F.broadcast(explained)  # a bounded number of rows
    scored = model.transform(VectorAssembler(inputCols=columns, outputCol=model.getFeaturesCol()).transform(placed))
    out = scored.select(key, "_cell", vector_to_array(model.getRawPredictionCol())[1].alias("margin")).join(explained, "_cell")
    adds_up = F.abs(F.col("_sum") - F.col("margin")) <= 1e-6 + 1e-6 * F.abs("margin")
    out = out.where(F.when(adds_up, True).otherwise(F.raise_error(F.lit("attributions don't add up to the margin"))))
    return out.select(key, "margin", *[F.col("_values")[k].alias(c) for k, c in enumerate(columns)])


def ranking(explained: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean_abs, signed."""
    one = explained.agg(*[f(F.col(c)).alias(f"{c}__{n}") for c in columns for n, f in (("mean_abs", lambda x: F.avg(F.abs(x))), ("signed", F.avg))])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}__mean_abs`").alias("mean_abs"), F.col(f"`{c}__signed`").alias("signed")) for c in columns]
    return one.select(F.explode(F.array(*structs)).alias("x")).select("x.*")
