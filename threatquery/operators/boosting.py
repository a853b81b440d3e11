"""Second-order boosting of trees for a label of two classes, which MLlib doesn't have.

Each round fits a tree to the gradients and Hessians of the logistic loss. A
round is one job: tasks add up both by the bins of the round's columns, Spark
adds up what tasks send, and the driver takes for each node the split with the
largest regularised gain from these sums, of which there are a bounded number
whatever the rows. Where the bins of a round's columns make too many cells, a
job adds up by (node, feature, bin) for each level of the tree. Gradients and Hessians are counted in whole units, so sums
don't depend on how rows are dealt to tasks or whether one ran twice, and the
same rows always give the same trees.

Rows lie in written blocks: bins of each column, label, weight, and the margin
after the trees of the last REFRESH rounds; tasks add the trees since. Values
are cut into at most ``bins`` bins: one a value where there are few values,
quantiles elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.operators.features_ml import medians
from threatquery.sources.sinks import Scratch

# The settings of the model.
ROUNDS, DEPTH, STEP, ROW_SHARE, COLUMN_SHARE, LAMBDA, LEAST_HESSIAN, BINS, SEED = 300, 6, 0.1, 0.8, 0.8, 1.0, 1.0, 256, 42
#: A split gains more than this.
LEAST_GAIN = 1e-6
#: Whole units of a gradient or Hessian; rows of a block; rounds after which margins are written.
UNIT, BLOCK, REFRESH = 1 << 36, 1 << 14, 20
#: Cells (of bins of all of a round's columns) up to which a round is one job.
CELLS = 1 << 18
_HALVES = ("g_high", "g_low", "h_high", "h_low")
_STATE = "key binary, y binary, weight binary, bins binary, margin binary"


@dataclass
class Tree:
    """A heap: node k has the children 2 k + 1 (at most the cut) and 2 k + 2. A leaf's feature is -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1), np.zeros(n), np.zeros(n))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by bins or by values, as the cuts are."""
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            live = np.flatnonzero(f >= 0)
            if not len(live):
                return at
            at[live] = 2 * at[live] + 1 + (x[live, f[live]] > self.cut[at[live]])

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(x)]


@dataclass
class Boosted:
    """``transform`` adds margin (of class 1), probability (of class 1) and prediction."""

    columns: list[str]
    filled: dict[str, float]
    trees: list[Tree] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return sum((t.margins(x) for t in self.trees), np.zeros(len(x)))

    def inputs(self) -> list[Column]:
        return [_filled(c, self.filled).alias(c) for c in self.columns]

    def transform(self, rows: DataFrame) -> DataFrame:
        trees, n = rows.sparkSession.sparkContext.broadcast(self.trees), len(self.columns)

        @F.pandas_udf("double")
        def margin(x: pd.DataFrame) -> pd.Series:
            own = x.to_numpy(float).reshape(-1, n)
            return pd.Series(sum((t.margins(own) for t in trees.value), np.zeros(len(own))))

        out = rows.withColumn("margin", margin(F.struct(*self.inputs())))
        return out.withColumn("probability", 1 / (1 + F.exp(-F.col("margin")))).withColumn("prediction", (F.col("margin") > 0).cast("double"))


def _filled(c: str, fitted: dict[str, float]) -> Column:
    return F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), F.lit(fitted.get(c, 0.0)))


def edges(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """The upper ends of the bins of each column but its last: values where there are at most ``bins``, quantiles elsewhere."""
    few = rows.agg(*[F.count_distinct(c) for c in columns]).first()
    out = []
    for c, n in zip(columns, few, strict=True):
        if n <= bins:
            values = [r[0] for r in rows.select(c).distinct().orderBy(c).collect()]  # at most ``bins``
        else:
            values = rows.agg(F.percentile_approx(c, [k / bins for k in range(1, bins + 1)], 100 * bins)).first()[0]
        out.append(np.unique(np.array(values, float))[:-1])
    return out


def packed(rows: DataFrame, columns: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """Blocks of rows; ``rows``: key (a hash), y, weight and the columns."""

    def whole(batches):
        """Tables of BLOCK rows, but for the last, however many a batch has."""
        held, n = [], 0
        for batch in batches:
            while n + batch.num_rows >= BLOCK:
                yield pa.Table.from_batches([*held, batch.slice(0, BLOCK - n)])
                held, n, batch = [], 0, batch.slice(BLOCK - n)
            held, n = [*held, batch], n + batch.num_rows
        if n:
            yield pa.Table.from_batches(held)

    def run(batches):
        for own in whole(batches):
            x = [np.searchsorted(e, np.asarray(own.column(c), float), "left") for c, e in zip(columns, cuts, strict=True)]
            held = (np.asarray(own.column("key"), np.int64), np.asarray(own.column("y"), np.float64), np.asarray(own.column("weight"), np.float64), np.column_stack(x).astype(np.uint16), np.zeros(own.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in held], names=["key", "y", "weight", "bins", "margin"])

    return rows.select("key", "y", "weight", *columns).mapInArrow(run, _STATE)


def _blocks(batches, d: int, pending: list[Tree]):
    """key, y, weight, bins and margins of each block, with the trees since the last write."""
    for batch in batches:
        for key, y, weight, bins, margin in zip(*(batch.column(c) for c in ("key", "y", "weight", "bins", "margin")), strict=True):
            x = np.frombuffer(bins.as_py(), np.uint16).reshape(-1, d)
            m = np.frombuffer(margin.as_py(), np.float64) + sum((t.margins(x) for t in pending), np.zeros(len(x)))
            yield key, y, weight, bins, x, m


def sampled(keys: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Which rows a round takes: by a hash of the row's own hash and the round."""
    h = keys.view(np.uint64) ^ np.uint64((turn * 0x9E3779B97F4A7C15) % (1 << 64))
    for factor, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def derivatives(y: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss, in whole units."""
    p = 1 / (1 + np.exp(-margin))
    return np.round((p - y) * weight * UNIT), np.round(p * (1 - p) * weight * UNIT)


def sums(key, y, weight, x, margin, tree: Tree, turn: int, level: int, features: list[int], wide: int, share: float) -> np.ndarray:
    """Gradients and Hessians of a block's sampled rows by (node of the level, feature, bin), in whole units."""
    first, n = (1 << level) - 1, (1 << level) * len(features) * wide
    take = sampled(key, turn, share)
    at = tree.nodes(x)
    take &= at >= first
    out = np.zeros((2, n))
    g, h = derivatives(y, weight, margin)
    for j, f in enumerate(features):
        cell = ((at[take] - first) * len(features) + j) * wide + x[take, f]
        for k, v in enumerate((g, h)):
            out[k] += np.bincount(cell, v[take], n)
    return out


def totals(state: DataFrame, d: int, pending: list[Tree], n: int, of_block) -> np.ndarray:
    """By one job: the sums g and h of each of ``n`` cells over all blocks, exact. ``of_block`` gives a block's own."""

    def cells(total: np.ndarray) -> pa.RecordBatch:
        full = np.flatnonzero((total != 0).any(0))
        halves = [half for v in total[:, full] for half in (v >> 32, v & 0xFFFFFFFF)]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (full, *halves)], names=["cell", *_HALVES])

    def run(batches):
        total, seen = np.zeros((2, n), np.int64), 0
        for key, y, weight, _, x, m in _blocks(batches, d, pending):
            held = (np.frombuffer(v.as_py(), k) for v, k in ((key, np.int64), (y, np.float64), (weight, np.float64)))
            total += of_block(*held, x, m).astype(np.int64)
            seen += 1
            if seen == 4096:  # before 64 bits are full
                yield cells(total)
                total, seen = np.zeros((2, n), np.int64), 0
        yield cells(total)

    found = state.mapInArrow(run, "cell bigint, " + ", ".join(f"{c} bigint" for c in _HALVES)).groupBy("cell").agg(*[F.sum(c).alias(c) for c in _HALVES]).toArrow()
    at, *halves = (np.asarray(found.column(c).combine_chunks(), np.int64) for c in ("cell", *_HALVES))
    wide = any(len(v) and np.abs(v).max() >= 1 << 20 for v in halves[::2])
    out = np.zeros((2, n), object if wide else np.int64)  # 64 bits hold the sum of all cells too, or Python's numbers do
    for k in (0, 1):
        out[k, at] = halves[2 * k].astype(out.dtype) * (1 << 32) + halves[2 * k + 1].astype(out.dtype)
    return out


def split(g: np.ndarray, h: np.ndarray, reg: float = LAMBDA, least: float = LEAST_HESSIAN) -> tuple[float, int, int]:
    """The best (gain, feature, bin) of sums by (feature, bin); rows up to the bin go left. Of equal gains the first counts."""
    left, whole = (np.cumsum(g, 1), np.cumsum(h, 1)), (g.sum(1, keepdims=True), h.sum(1, keepdims=True))
    right = (whole[0] - left[0], whole[1] - left[1])
    gain = left[0] ** 2 / (left[1] + reg) + right[0] ** 2 / (right[1] + reg) - whole[0] ** 2 / (whole[1] + reg)
    gain = np.where((left[1] >= least) & (right[1] >= least), gain, -np.inf)
    k = int(np.argmax(gain))
    return float(gain.flat[k]), k // g.shape[1], k % g.shape[1]


def grow(summed, features: list[int], sizes: list[int], depth: int, step: float, reg: float) -> Tree:
    """A tree whose cuts are bins. ``summed``: of a tree so far and a level, the sums g and h of each cell."""
    tree, wide = Tree.empty(depth), max(sizes)
    for level in range(depth):
        first = (1 << level) - 1
        g, h = summed(tree, level)
        more = False
        for k in range(1 << level):
            own = [v.reshape(1 << level, len(features), wide)[k] for v in (g, h)]
            whole = own[0][0].sum(), own[1][0].sum()
            if not whole[1]:
                continue
            if not level:
                tree.value[0] = -step * whole[0] / (whole[1] + reg)
            gain, j, b = split(*own, reg)
            if gain <= LEAST_GAIN:
                continue
            at, more = first + k, True
            tree.feature[at], tree.cut[at] = features[j], b
            sides = [(v[j, : b + 1].sum(), v[j, b + 1 :].sum()) for v in own]
            for side in (0, 1):
                tree.value[2 * at + 1 + side] = -step * sides[0][side] / (sides[1][side] + reg)
        if not more:
            break
    return tree


def over_rows(state: DataFrame, pending: list[Tree], turn: int, features: list[int], sizes: list[int], share: float):
    """Sums by a job over all blocks for each level."""
    d, wide = len(sizes), max(sizes)

    def summed(tree: Tree, level: int):
        own = totals(state, d, pending, (1 << level) * len(features) * wide, lambda *block: sums(*block, tree, turn, level, features, wide, share))
        return (own / UNIT).astype(float)

    return summed


def over_cells(state: DataFrame, pending: list[Tree], turn: int, features: list[int], sizes: list[int], share: float):
    """The same sums from one job a round: rows that agree in the bins of the round's columns take the same way through its tree."""
    shape, d, wide = [sizes[f] for f in features], len(sizes), max(sizes)
    n = int(np.prod(shape))

    def of_block(key, y, weight, x, margin):
        take = sampled(key, turn, share)
        cell = np.ravel_multi_index(tuple(x[take, f].astype(np.int64) for f in features), shape)
        return np.stack([np.bincount(cell, v[take], n) for v in derivatives(y, weight, margin)])

    whole = totals(state, d, pending, n, of_block)
    full = np.flatnonzero((whole != 0).any(0))
    whole, bins = whole[:, full], np.zeros((len(full), d), np.uint16)
    for f, own in zip(features, np.unravel_index(full, shape), strict=True):
        bins[:, f] = own

    def summed(tree: Tree, level: int):
        first = (1 << level) - 1
        at = tree.nodes(bins)
        take = at >= first
        out = np.zeros((2, (1 << level) * len(features) * wide), whole.dtype)
        for j, f in enumerate(features):
            cell = ((at[take] - first) * len(features) + j) * wide + bins[take, f]
            for k in (0, 1):
                np.add.at(out[k], cell, whole[k, take])
        return (out / UNIT).astype(float)

    return summed


def in_one_block(state: DataFrame, rounds: int, sizes: list[int], pick, grown, share: float) -> list[Tree]:
    """All trees from a state of one block, in the task that has it: the same sums without a job for each level."""

    def run(batches):
        trees = []
        for key, y, weight, _, x, margin in _blocks(batches, len(sizes), []):
            key, y, weight = (np.frombuffer(v.as_py(), k) for v, k in ((key, np.int64), (y, np.float64), (weight, np.float64)))
            for turn in range(rounds):
                features = pick(turn)
                tree = grown(lambda t, level: sums(key, y, weight, x, margin, t, turn, level, features, max(sizes), share) / UNIT, features)  # noqa: B023
                margin = margin + tree.margins(x)
                trees.append(tree)
        columns = [pa.array([getattr(t, c).astype(np.float64).tobytes() for t in trees], pa.binary()) for c in ("feature", "cut", "value")]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trees)), pa.int64()), *columns], names=["turn", "feature", "cut", "value"])

    found = state.mapInArrow(run, "turn bigint, feature binary, cut binary, value binary").orderBy("turn").collect()
    read = lambda b: np.frombuffer(b, np.float64)
    return [Tree(read(r.feature).astype(np.int64), read(r.cut), read(r.value)) for r in found]


def refreshed(state: DataFrame, d: int, pending: list[Tree]) -> DataFrame:
    def run(batches):
        for key, y, weight, bins, _, m in _blocks(batches, d, pending):
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (key.as_py(), y.as_py(), weight.as_py(), bins.as_py(), m.tobytes())], names=["key", "y", "weight", "bins", "margin"])

    return state.mapInArrow(run, _STATE)


def chosen(turn: int, d: int, share: float, seed: int) -> list[int]:
    """The columns of a round."""
    return sorted(np.random.default_rng([seed, turn]).permutation(d)[: max(1, int(share * d))].tolist())


def fit(
    train: DataFrame, columns: list[str], label: str = "label", weight: str | None = None, rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP, row_share: float = ROW_SHARE, column_share: float = COLUMN_SHARE, reg: float = LAMBDA, bins: int = BINS, seed: int = SEED
) -> Boosted:
    """Median imputation, then ``rounds`` trees; ``label`` is 0 or 1, rows without one are left out.

    A null weight counts as 0. With no rows or one class the model still scores:
    by trees of one leaf. Equal rows are sampled alike.
    """
    filled = medians(train, columns)
    y, w = F.col(f"`{label}`").cast("double"), F.lit(1.0) if weight is None else F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0))
    names = [f"x{k}" for k in range(len(columns))]
    rows = train.where(y.isNotNull()).select(y.alias("y"), w.alias("weight"), *[_filled(c, filled).alias(n) for c, n in zip(columns, names, strict=True)])
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "y", "weight", *names))
    model = Boosted(list(columns), filled)
    with Scratch(train.sparkSession, "boosting") as scratch:
        cuts = edges(rows, names, bins)
        sizes = [len(e) + 1 for e in cuts]
        parts = max(1, -(-rows.count() // BLOCK))
        state = scratch.write(packed(rows.repartition(parts), names, cuts), "state0")
        state = state.coalesce(1) if parts == 1 else state
        pick = lambda turn: chosen(turn, len(columns), column_share, seed)
        grown = lambda summed, features: grow(summed, features, sizes, depth, step, reg)
        if parts == 1 and state.count() <= 1:  # a row of the state is a block
            made = in_one_block(state, rounds, sizes, pick, grown, row_share)
            made = made or [Tree.empty(depth)] * rounds  # no rows
        else:
            made, pending = [], []
            for turn in range(rounds):
                features = pick(turn)
                over = over_cells if np.prod([float(sizes[f]) for f in features]) <= CELLS else over_rows
                made.append(grown(over(state, pending, turn, features, sizes, row_share), features))
                pending.append(made[-1])
                if len(pending) == REFRESH and turn + 1 < rounds:
                    state, pending = scratch.write(refreshed(state, len(columns), pending), f"state{turn + 1}"), []
                    scratch.drop(f"state{turn + 1 - REFRESH}")
    for tree in made:
        inner = tree.feature >= 0
        cut = tree.cut.copy()
        cut[inner] = [cuts[f][int(b)] for f, b in zip(tree.feature[inner], tree.cut[inner], strict=True)]
        model.trees.append(Tree(tree.feature, cut, tree.value))
    return model
