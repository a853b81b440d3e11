"""Classification metrics as aggregates; curves over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.sources.sinks import cumulated


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts by (true, predicted) of the classes 0 and 1, zero cells too."""
    cells = [(t, p) for t in (0, 1) for p in (0, 1)]
    one = rows.agg(*[F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(f"c{t}{p}") for t, p in cells])
    structs = [F.struct(F.lit(t).alias("truth"), F.lit(p).alias("predicted"), F.col(f"c{t}{p}").alias("n")) for t, p in cells]
    return one.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def per_class(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1 of every class that is true or predicted somewhere."""
    pairs = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("pred")), F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("pred")))).alias("x"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    out = sides.groupBy("x.class").agg(F.sum("x.true").alias("support"), F.sum("x.pred").alias("predicted"), F.sum(F.when(F.col("x.true") > 0, F.col("hit")).otherwise(0)).alias("hits"))
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return out.select("class", "support", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def summary(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, macro_f1, weighted_f1."""
    classes = per_class(rows, truth, predicted)
    return classes.agg(
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def binary(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """accuracy, precision, recall, f1 of a positive class given as flags."""
    counts = rows.select(truth.alias("t"), predicted.alias("p")).agg(F.count_if("t").alias("p"), F.count_if("p").alias("q"), F.count_if(F.col("t") & F.col("p")).alias("hit"), F.count_if(F.col("t") == F.col("p")).alias("ok"), F.count("*").alias("n"))
    precision, recall = ratio(F.col("hit"), F.col("q")), ratio(F.col("hit"), F.col("p"))
    return counts.select(ratio(F.col("ok"), F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def _curve(rows: DataFrame, positive: Column, score: str) -> DataFrame:
    """Distinct scores with their positives and rows, and the sums of these over scores as large or larger.

    Sums run within ranges of about as many scores each, so that no task sees
    all scores, however close together they lie.
    """
    grouped = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count("*").alias("n"))
    return cumulated(grouped, [], "s", ["p", "n"], descending=True).select("s", "p", "n", F.col("p_to").alias("tp"), F.col("n_to").alias("seen"))


def roc_auc(rows: DataFrame, positive: Column, score: str) -> DataFrame:
    """Tie-aware; null with one class only."""
    c = _curve(rows, positive, score)
    # each negative counts the positives above it, and half of those at its score
    won = F.sum((F.col("n") - F.col("p")) * ((F.col("tp") - F.col("p")) + F.col("p") / 2))
    return c.agg(F.try_divide(won, (F.sum("p") * F.sum(F.col("n") - F.col("p"))).cast("double")).alias("roc_auc"))


def average_precision(rows: DataFrame, positive: Column, score: str) -> DataFrame:
    """Sum of precision over the steps of recall; null without positives."""
    c = _curve(rows, positive, score)
    return c.agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("seen")), F.sum("p").cast("double")).alias("average_precision"))


def compare(tables: dict[str, DataFrame]) -> DataFrame:
    """Metric rows of several models."""
    out = None
    for name, one in tables.items():
        row = one.withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
