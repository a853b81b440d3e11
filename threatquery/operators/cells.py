"""Forests and boosted trees over cells: MLlib's trees, with a row's work done once for all rows of a cell.

MLlib's trees see a column as at most ``maxBins`` bins, so rows that agree in
all bins take the same way through every tree. Rows are therefore counted by
(cell, label, weight) in one aggregate, and trees grow from the counts, of
which there is a bounded number whatever the rows. What MLlib draws for each
row is drawn for each count, from the distribution of the sum over its rows:
Poisson of n for a bootstrap, binomial of (n, rate) without replacement. Bins,
impurities, ends and pruning are MLlib's; where nothing is drawn the models are
equal (tests). Forests grow a tree a row, over the tasks; boosted trees follow
from one another and grow in one task, from the counts.

Where cells or counts are too many, or a setting is not one of ``_KNOWN``, MLlib itself fits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells, and counts by (cell, label, weight), up to which trees grow from counts.
CELLS, COUNTS = 1 << 18, 1 << 18
#: Rows from which MLlib takes the ends of bins; below an impurity of EPSILON it ends a branch.
SAMPLE, EPSILON = 10_000, 2.0**-52
#: Settings that are followed here, or that change no result.
_KNOWN = {"featuresCol", "labelCol", "weightCol", "predictionCol", "probabilityCol", "rawPredictionCol", "numTrees", "maxIter", "maxDepth", "maxBins", "seed", "stepSize", "subsamplingRate", "bootstrap", "featureSubsetStrategy", "maxMemoryInMB", "cacheNodeIds", "checkpointInterval"}
_TREE = "turn bigint, feature binary, cut binary, left binary, value binary"


@dataclass
class Tree:
    """Nodes in the order they were made: ``left`` is a node's child up to ``cut``, the other one follows it. A leaf's feature is -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def spread(self, shape: list[int]) -> np.ndarray:
        """The value of every cell; cuts are bins."""
        out = np.zeros((*shape, self.value.shape[1]))
        todo = [(0, [(0, n) for n in shape])]
        while todo:
            at, box = todo.pop()
            f = self.feature[at]
            if f < 0:
                out[tuple(slice(*side) for side in box)] = self.value[at]
                continue
            cut = int(self.cut[at]) + 1
            todo.append((self.left[at], [*box[:f], (box[f][0], cut), *box[f + 1 :]]))
            todo.append((self.left[at] + 1, [*box[:f], (cut, box[f][1]), *box[f + 1 :]]))
        return out.reshape(-1, self.value.shape[1])


def ends(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """The upper ends of the bins of a column but its last, of its sorted distinct values and their weights, as MLlib takes them."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < bins:
        return middles
    stride, out = weights.sum() / bins, []
    reached = np.cumsum(weights)
    target = stride
    for k, middle in enumerate(middles):
        if abs(reached[k] - target) < abs(reached[k + 1] - target):
            out.append(middle)
            target += stride
    return np.array(out)


def gini(stats: np.ndarray) -> np.ndarray:
    whole, out = stats.sum(-1), 1.0
    for k in range(stats.shape[-1]):  # in MLlib's order, as ties fall by the last bit
        out = out - (stats[..., k] / np.where(whole, whole, 1)) ** 2
    return out


def variance(stats: np.ndarray) -> np.ndarray:
    """Of weight, weighted sum and weighted sum of squares."""
    n = np.where(stats[..., 0], stats[..., 0], 1)
    return (stats[..., 2] - stats[..., 1] ** 2 / n) / n


def grow(bins: np.ndarray, raw: np.ndarray, stats: np.ndarray, shape: list[int], depth: int, take: int, rng, impurity: Callable, size: Callable, value: Callable) -> Tree:
    """A tree from counts: ``raw`` rows and the sums ``stats`` of each; ``take`` features are drawn for each node.

    ``impurity`` and ``size`` (weight) of sums; ``value``: what a leaf says and, last, what it is pruned by.
    """
    d, s = len(shape), stats.shape[1]
    feature, cut, left, held = [-1], [0], [0], [stats.sum(0)]
    live, at, born = np.zeros(1, int), np.zeros(len(raw), int), 1  # nodes of a level, each count's place among them, nodes so far
    for level in range(depth):
        if not len(live):
            break
        m = len(live)
        parent = np.array([held[k] for k in live])
        pure, whole = impurity(parent), np.maximum(size(parent), np.finfo(float).tiny)[:, None]
        drawn = np.ones((m, d), bool)
        if take < d:
            drawn[:] = False
            np.put_along_axis(drawn, rng.random((m, d)).argsort(1)[:, :take], True, 1)
        gains, lefts = [], []
        for f, n in enumerate(shape):
            cell = at * n + bins[:, f]
            sums = np.stack([np.bincount(cell, v, m * n).reshape(m, n) for v in (raw, *stats.T)], -1).cumsum(1)
            low, high = sums[:, :-1], sums[:, -1:] - sums[:, :-1]
            fits = (low[..., 0] >= 1) & (high[..., 0] >= 1) & drawn[:, f, None]
            gain = pure[:, None]
            for side in (low[..., 1:], high[..., 1:]):
                gain = gain - size(side) / whole * impurity(side)
            gains.append(np.where(fits, gain, -np.inf))
            lefts.append(low[..., 1:])
        start = np.cumsum([0, *[g.shape[1] for g in gains]])
        if not start[-1]:
            break
        gains = np.concatenate(gains, 1)
        best = gains.argmax(1)
        goes = gains[np.arange(m), best] > 0
        which = np.searchsorted(start, best, "right") - 1
        step = np.full(m, -1)
        for k in np.flatnonzero(goes):
            f, b, node = int(which[k]), int(best[k] - start[which[k]]), live[k]
            feature[node], cut[node], left[node], step[k] = f, b, len(feature), len(feature)
            for own in (lefts[f][k, b], parent[k] - lefts[f][k, b]):
                feature.append(-1)
                cut.append(0)
                left.append(0)
                held.append(own)
        here = np.flatnonzero(step[at] >= 0)
        own = which[at[here]]
        node = step[at[here]] + (bins[here, own] > best[at[here]] - start[own])
        made, born = np.arange(born, len(feature)), len(feature)
        live = made[np.abs(impurity(np.array([held[k] for k in made]).reshape(-1, s))) >= EPSILON]
        place = np.full(born, -1)
        place[live] = np.arange(len(live))
        stay = place[node] >= 0
        bins, raw, stats, at = bins[here][stay], raw[here][stay], stats[here][stay], place[node][stay]
    feature, cut, left = np.array(feature), np.array(cut), np.array(left)
    values = value(np.array(held))
    for k in range(len(feature) - 1, -1, -1):  # children come after their parents
        if feature[k] >= 0 and (feature[left[k] : left[k] + 2] < 0).all() and values[left[k], -1] == values[left[k] + 1, -1]:
            feature[k] = -1
    return Tree(feature, cut, left, values[:, :-1])


def forest_tree(bins, label, weight, n, shape, classes: int, turn: int, depth: int, take: int, rate: float, bootstrap: bool, seed: int) -> Tree:
    rng = np.random.default_rng([seed, turn])
    raw = (rng.poisson(n * rate) if bootstrap else n if rate >= 1 else rng.binomial(n, rate)).astype(float)
    stats = np.zeros((len(n), classes))
    stats[np.arange(len(n)), label.astype(int)] = raw * weight
    kept = raw > 0

    def value(held):
        whole = held.sum(1, keepdims=True)
        return np.column_stack([held / np.where(whole, whole, 1), held.argmax(1)])

    return grow(bins[kept], raw[kept], stats[kept], shape, depth, take, rng, gini, lambda v: v.sum(-1), value)


def boosted_trees(bins, label, weight, n, shape, rounds: int, depth: int, take: int, step: float, rate: float, seed: int):
    """Each round's tree, on the negative gradients of the log loss; the first one is on labels of -1 and 1."""
    sign = 2 * label - 1
    cell, margin = np.ravel_multi_index(tuple(bins.T), shape), np.zeros(len(n))
    for turn in range(rounds):
        y = sign if not turn else 4 * sign / (1 + np.exp(2 * sign * margin))
        rng = np.random.default_rng([seed, turn])
        raw = (n if rate >= 1 else rng.binomial(n, rate)).astype(float)
        w, kept = raw * weight, raw > 0
        stats = np.column_stack([w, w * y, w * y * y])
        mean = lambda held: (held[:, 1] / np.where(held[:, 0], held[:, 0], 1))[:, None].repeat(2, 1)
        tree = grow(bins[kept], raw[kept], stats[kept], shape, depth, take, rng, variance, lambda v: v[..., 0], mean)
        margin = margin + (step if turn else 1.0) * tree.spread(shape)[cell, 0]
        yield tree


def row_of(turn: int, tree: Tree) -> pa.RecordBatch:
    held = [np.asarray(v, float).tobytes() for v in (tree.feature, tree.cut, tree.left, tree.value)]
    return pa.RecordBatch.from_arrays([pa.array([turn], pa.int64()), *[pa.array([v], pa.binary()) for v in held]], names=["turn", "feature", "cut", "left", "value"])


def read(row) -> Tree:
    feature, cut, left, value = (np.frombuffer(v, float) for v in (row.feature, row.cut, row.left, row.value))
    return Tree(feature.astype(int), cut.astype(int), left.astype(int), value.reshape(len(feature), -1))


def numbered_cells(cuts: list[np.ndarray]):
    """The number of the cell of each row of a column of arrays."""
    shape = tuple(len(c) + 1 for c in cuts)

    def number(x: pd.Series) -> np.ndarray:
        own = np.stack(x.to_list()) if len(x) else np.zeros((0, len(cuts)))
        return np.ravel_multi_index(tuple(np.searchsorted(c, own[:, k], "left") for k, c in enumerate(cuts)), shape)

    return number


def counted(est, dataset: DataFrame) -> tuple[list[np.ndarray], pa.Table] | None:
    """The ends of bins, and counts by (cell, label, weight) in an order of their own; None where MLlib is to fit: too many of them, or rows that it refuses."""
    if any(est.isSet(p) and p.name not in _KNOWN for p in est.params) or not est.getFeatureSubsetStrategy().replace(".", "", 1).isalnum():
        return None
    weight = F.col(est.getWeightCol()).cast("double") if est.isSet("weightCol") and est.getWeightCol() else F.lit(1.0)
    rows = dataset.select(vector_to_array(est.getFeaturesCol()).alias("x"), F.col(est.getLabelCol()).cast("double").alias("label"), weight.alias("weight"))
    odd = F.col("label").isNull() | (F.col("label") != F.floor("label")) | (F.col("label") < 0) | F.col("weight").isNull() | ~(F.col("weight") >= 0) | F.exists("x", F.isnan)
    n, wrong, d = rows.agg(F.count("*"), F.coalesce(F.max(odd.cast("int")), F.lit(1)), F.max(F.size("x"))).first()
    if not n or wrong or not d:
        return None
    bins, need = min(est.getMaxBins(), n), max(est.getMaxBins() ** 2, SAMPLE)
    some = rows.sample(False, need / n, est.getSeed() % (1 << 31)) if need < n else rows
    found = some.select(F.posexplode("x").alias("f", "v"), "weight").groupBy("f", "v", "weight").count().orderBy("f", "v", "weight").toPandas()  # of a sample of bounded size
    found = found.assign(w=found["weight"] * found["count"]).groupby(["f", "v"], as_index=False).w.sum()
    cuts = [ends(found.v[found.f == f].to_numpy(), found.w[found.f == f].to_numpy(), bins) for f in range(d)]
    if np.prod([float(len(c) + 1) for c in cuts]) > CELLS:
        return None
    number = numbered_cells(cuts)

    @F.pandas_udf("long")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(number(x))

    counts = rows.groupBy(cell("x").alias("cell"), "label", "weight").agg(F.count("*").alias("n")).limit(COUNTS + 1).toArrow()
    if counts.num_rows > COUNTS:
        return None
    return cuts, counts.sort_by([(c, "ascending") for c in ("cell", "label", "weight")])


def taken(strategy: str, d: int, trees: int, forest: bool) -> int:
    """How many features a node draws, as MLlib reads the setting."""
    named = {"all": d, "sqrt": int(np.ceil(d**0.5)), "log2": max(1, int(np.ceil(np.log2(d)))), "onethird": int(np.ceil(d / 3)), "auto": int(np.ceil(d**0.5)) if forest and trees > 1 else d if trees == 1 else int(np.ceil(d / 3))}
    if strategy in named:
        return named[strategy]
    return min(int(strategy), d) if strategy.isdigit() and int(strategy) > 0 else min(d, int(np.ceil(float(strategy) * d)))


def grown(spark, counts: pa.Table, shape: list[int], turns: int, parts: int, make: Callable) -> list[Tree]:
    """All trees, from ``parts`` tasks; ``make`` gives those of some turns from the counts' columns."""
    held = tuple(counts.column(c).to_numpy() for c in ("cell", "label", "weight", "n"))
    shared = spark.sparkContext.broadcast((np.column_stack(np.unravel_index(held[0], shape)), *held[1:]))

    def run(batches):
        for batch in batches:
            for turn, tree in make(batch.column("id").to_pylist(), *shared.value):
                yield row_of(turn, tree)

    return [read(r) for r in spark.range(0, turns, 1, parts).mapInArrow(run, _TREE).orderBy("turn").collect()]


class CellModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """``transform`` adds what MLlib's models add: raw predictions, probabilities, prediction."""

    ends = Param(Params._dummy(), "ends", "the upper ends of each column's bins but its last", TypeConverters.identity)
    grown = Param(Params._dummy(), "grown", "each tree's features, cuts, left children and values", TypeConverters.identity)
    weights = Param(Params._dummy(), "weights", "the weight of each tree", TypeConverters.toListFloat)

    @classmethod
    def of(cls, est, cuts: list[np.ndarray], trees: list[Tree], weights: list[float]) -> CellModel:
        model = cls()
        model._set(ends=[c.tolist() for c in cuts], grown=[[v.tolist() for v in (t.feature, t.cut, t.left, t.value)] for t in trees], weights=weights)
        return model._set(**{c: est.getOrDefault(c) for c in ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol")})

    @property
    def treeWeights(self) -> list[float]:  # noqa: N802
        return self.getOrDefault("weights")

    @property
    def trees(self) -> list[Printed]:
        cuts = self.getOrDefault("ends")
        return [Printed.of(Tree(*map(np.array, t)), cuts) for t in self.getOrDefault("grown")]

    def table(self) -> np.ndarray:
        """Raw predictions of every cell."""
        shape = [len(c) + 1 for c in self.getOrDefault("ends")]
        return sum(w * Tree(*map(np.array, t)).spread(shape) for w, t in zip(self.treeWeights, self.getOrDefault("grown"), strict=True))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        number = numbered_cells([np.array(c) for c in self.getOrDefault("ends")])
        shared = dataset.sparkSession.sparkContext.broadcast(self.table())

        @F.pandas_udf("array<double>")
        def raw(x: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value[number(x)]))

        names = [self.getRawPredictionCol(), self.getProbabilityCol(), self.getPredictionCol()]
        made = dataset.withColumn(names[0], raw(vector_to_array(self.getFeaturesCol())))
        shares = self.probabilities(F.col(names[0]))
        out = made.withColumns({names[1]: array_to_vector(shares), names[2]: (F.array_position(names[0], F.array_max(names[0])) - 1).cast("double")})
        return out.withColumn(names[0], array_to_vector(names[0]))


class ForestModel(CellModel):
    def probabilities(self, raw):
        return F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


class BoostedModel(CellModel):
    def table(self) -> np.ndarray:
        margin = super().table()
        return np.column_stack([-margin[:, 0], margin[:, 0]])

    def probabilities(self, raw):
        one = 1 / (1 + F.exp(-2 * raw[1]))
        return F.array(1 - one, one)


@dataclass
class Printed:
    """A tree as MLlib prints it."""

    toDebugString: str  # noqa: N815

    @classmethod
    def of(cls, tree: Tree, cuts: list[list[float]]) -> Printed:
        lines = ["a tree over cells"]

        def walk(at: int, depth: int) -> None:
            f = int(tree.feature[at])
            if f < 0:
                lines.append(f"{' ' * depth}Predict: {float(tree.value[at, 0])!r}")
                return
            for word, sign, child in (("If", "<=", 0), ("Else", ">", 1)):
                lines.append(f"{' ' * depth}{word} (feature {f} {sign} {float(cuts[f][tree.cut[at]])!r})")
                walk(tree.left[at] + child, depth + 1)

        walk(0, 1)
        return cls("\n".join(lines))


class CellForest(RandomForestClassifier):
    """MLlib's forest, from counts where it can."""

    def _fit(self, dataset: DataFrame):
        if not (found := counted(self, dataset)):
            return super()._fit(dataset)
        cuts, counts = found
        shape, spark, trees = [len(c) + 1 for c in cuts], dataset.sparkSession, self.getNumTrees()
        setting = (shape, int(max(counts.column("label").to_pylist())) + 1)
        rest = (self.getMaxDepth(), taken(self.getFeatureSubsetStrategy(), len(cuts), trees, True), self.getSubsamplingRate(), self.getBootstrap(), self.getSeed() % (1 << 63))

        def make(turns, *held):
            for turn in turns:
                yield turn, forest_tree(*held, *setting, turn, *rest)

        made = grown(spark, counts, shape, trees, min(trees, 4 * spark.sparkContext.defaultParallelism), make)
        return ForestModel.of(self, cuts, made, [1.0] * trees)


class CellBoosting(GBTClassifier):
    """MLlib's boosted trees, from counts where it can."""

    def _fit(self, dataset: DataFrame):
        found = counted(self, dataset)
        if not found or max(found[1].column("label").to_pylist()) > 1:
            return super()._fit(dataset)
        cuts, counts = found
        shape, rounds, step = [len(c) + 1 for c in cuts], self.getMaxIter(), self.getStepSize()
        setting = (shape, rounds, self.getMaxDepth(), taken(self.getFeatureSubsetStrategy(), len(cuts), 1, False), step, self.getSubsamplingRate(), self.getSeed() % (1 << 63))

        def make(_, *held):
            yield from enumerate(boosted_trees(*held, *setting))

        return BoostedModel.of(self, cuts, grown(dataset.sparkSession, counts, shape, 1, 1, make), [1.0] + [step] * (rounds - 1))
