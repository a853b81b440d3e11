"""A linear machine with the squared hinge, which MLlib doesn't have.

Minimises |w|^2 / 2 + c * sum of weight * max(0, 1 - y (w . x))^2, with the
constant as one more feature, by Newton steps over the rows inside the margin.
A step is one aggregate of products of columns; only these sums reach the
driver, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.operators.features_ml import medians, standard_moments
from threatquery.operators.models import balanced
from threatquery.sources.sinks import Scratch


@dataclass
class SquaredHinge:
    """Weights in units of the imputed columns; ``transform`` adds margin (of class 1) and prediction."""

    columns: list[str]
    filled: dict[str, float]
    weights: dict[str, float]
    bias: float

    def margin(self) -> Column:
        out = F.lit(self.bias)
        for c in self.columns:
            out = out + F.lit(self.weights[c]) * _filled(c, self.filled)
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("margin", self.margin()).withColumn("prediction", (F.col("margin") > 0).cast("double"))


def _filled(c: str, fitted: dict[str, float]) -> Column:
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(fitted.get(c, 0.0)))


def fit(train: DataFrame, columns: list[str], label: str = "label", c: float = 1.0, max_iter: int = 5000, tolerance: float = 1e-10) -> SquaredHinge:
    """Median imputation, scaling by the population deviation, classes of equal weight; ``label`` is 0 or 1."""
    filled = medians(train, columns)
    with Scratch(train.sparkSession, "margin") as scratch:
        return _fit(train, columns, label, c, max_iter, tolerance, filled, scratch)


def _fit(train: DataFrame, columns: list[str], label: str, c: float, max_iter: int, tolerance: float, filled: dict[str, float], scratch: Scratch) -> SquaredHinge:
    rows = balanced(train.withColumn("label", F.col(label)), "label").select((2.0 * F.col("label") - 1.0).alias("y"), "weight", *[_filled(k, filled).alias(k) for k in columns])
    moments = standard_moments(rows, columns)
    scaled = [(F.col(k) - F.lit(moments[k][0] or 0.0)) / F.lit(moments[k][1] or 1.0) for k in columns] + [F.lit(1.0)]
    names = [f"z{k}" for k in range(len(scaled))]
    # written once, as each step reads it
    rows = scratch.write(rows.select("y", "weight", *[z.alias(n) for z, n in zip(scaled, names, strict=True)]), "rows")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The loss at ``w``, and over the rows inside the margin the sums of z z' and of y z."""
        score = sum((F.lit(float(x)) * F.col(n) for x, n in zip(w, names, strict=True)), F.lit(0.0))
        slack = F.greatest(F.lit(0.0), 1.0 - F.col("y") * score)
        own = rows.withColumn("slack", slack).withColumn("active", F.when(F.col("slack") > 0, F.col("weight")).otherwise(0.0))
        row = own.agg(
            F.sum(F.col("weight") * F.col("slack") * F.col("slack")),
            *[F.sum(F.col("active") * F.col(names[i]) * F.col(names[j])) for i, j in pairs],
            *[F.sum(F.col("active") * F.col("y") * F.col(n)) for n in names],
        ).first()
        values = [float(x or 0.0) for x in row]
        square = np.zeros((len(names), len(names)))
        for (i, j), x in zip(pairs, values[1:], strict=False):
            square[i, j] = square[j, i] = x
        return float(w @ w) / 2 + c * values[0], square, np.array(values[1 + len(pairs) :])

    w = np.zeros(len(names))
    loss, square, linear = sums(w)
    for _ in range(max_iter):
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * square, 2 * c * linear) - w
        size = 1.0
        after = sums(w + step)
        while after[0] > loss + 1e-12 * abs(loss) and size > 1e-6:
            size /= 2
            after = sums(w + size * step)
        gain, w = loss - after[0], w + size * step
        loss, square, linear = after
        if gain <= tolerance * max(1.0, loss):
            break
    weights = {k: float(x) / (moments[k][1] or 1.0) for k, x in zip(columns, w, strict=False)}
    return SquaredHinge(list(columns), filled, weights, float(w[-1]) - sum(weights[k] * (moments[k][0] or 0.0) for k in columns))
