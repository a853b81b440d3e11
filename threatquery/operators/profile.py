"""Profiling: value counts, exact describes, correlations, medians, skewness. One aggregate each, unpivoted."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatquery.sources.sinks import cumulated

DESCRIBE = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """value, n, share, percent; nulls are skipped."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.crossJoin(F.broadcast(total))  # one row
    return out.select("value", "n", (F.col("n") / F.col("total")).alias("share"), F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))


def _moments(x: Column) -> dict[str, Column]:
    return {"count": F.count(x).cast("double"), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}


def quantiles(rows: DataFrame, columns: list[str], shares: dict[str, float], by: Column | None = None) -> DataFrame:
    """column, class and a column for each share: exact quantiles, between neighbours in proportion.

    Values are counted, and the counts summed up over sorted ranges of values,
    so that no task holds all values of a column. Columns or classes without a
    value have no row.
    """
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    each = rows.select((F.lit(None).cast("int") if by is None else by).alias("class"), F.explode(values).alias("x")).select("class", "x.*").where("value is not null")
    counts = cumulated(each.groupBy("column", "class", "value").agg(F.count("*").alias("n")), ["column", "class"], "value", ["n"])
    totals = counts.groupBy("column", "class").agg(F.sum("n").alias("total")).select(F.col("column").alias("of"), F.col("class").alias("in"), "total")
    counts = counts.join(totals, (F.col("column") == F.col("of")) & F.col("class").eqNullSafe(F.col("in")))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("n_to") > place) & (F.col("n_to") - F.col("n") <= place), F.col("value")))

    aggs = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("total") - 1)
        aggs += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high"), F.max(place - F.floor(place)).alias(f"{name}_part")]
    found = counts.groupBy("column", "class").agg(*aggs)
    return found.select("column", "class", *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in shares])


def grouped_describe(rows: DataFrame, by: str, column: str) -> DataFrame:
    """Exact count, mean, sample deviation and quantiles of a column by class."""
    x = F.col(column).cast("double")
    found = quantiles(rows, [column], QUARTILES, F.col(by)).select(F.col("class").alias("of"), *QUARTILES)
    base = rows.groupBy(by).agg(*[c.alias(n) for n, c in _moments(x).items()])
    return base.join(found, F.col(by).eqNullSafe(F.col("of")), "left").select(by, *DESCRIBE)


def unpivot(one: DataFrame, keys: Iterable[str], fields: Iterable[str], name: str = "column") -> DataFrame:
    """One row with columns key__field to rows (name, fields)."""
    structs = [F.struct(F.lit(k).alias(name), *[F.col(f"`{k}__{f}`").alias(f) for f in fields]) for k in keys]
    return one.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def histogram(rows: DataFrame, by: str, column: str, bins: int = 40) -> DataFrame:
    """``by``, bin from 0, low, high and n: equal bins between the exact least and greatest value of each class.

    A bin holds its lower edge, the last one also its upper edge; empty bins are
    there. A class of one value has bins from half below to half above it, and
    one without values, or null, has none of its own. NaN is no value.
    """
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    known = rows.select(F.col(by).alias("class"), x.alias("x")).where(F.col("x").isNotNull() & F.col("class").isNotNull())
    ends = known.groupBy("class").agg(F.min("x").alias("low"), F.max("x").alias("high"))  # a row for each class
    same = F.col("low") == F.col("high")
    ends = ends.select("class", F.when(same, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(same, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    edge = lambda k: F.when(k == bins, F.col("high")).otherwise(F.col("low") + k * ((F.col("high") - F.col("low")) / bins))
    # by proportion, then by the edges themselves, which rounding may have put on the other side
    near = known.join(ends, "class").withColumn("bin", F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)))
    near = near.withColumn("bin", F.when(F.col("x") < edge(F.col("bin")), F.col("bin") - 1).otherwise(F.col("bin")))
    near = near.withColumn("bin", F.when((F.col("x") >= edge(F.col("bin") + 1)) & (F.col("bin") < bins - 1), F.col("bin") + 1).otherwise(F.col("bin")))
    counts = near.groupBy("class", "bin").agg(F.count("*").alias("n"))
    spine = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("bin", F.col("bin").cast("bigint"))
    spine = spine.select("class", "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"))
    out = spine.join(counts, ["class", "bin"], "left")
    return out.select(F.col("class").alias(by), "bin", "low", "high", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same for all columns at once, a row each."""
    one = rows.agg(*[c.cast("double").alias(f"{k}__{n}") for k in columns for n, c in _moments(F.col(k).cast("double")).items()])
    found = quantiles(rows, columns, QUARTILES).select("column", *QUARTILES)
    return unpivot(one, columns, ["count", "mean", "std", "min", "max"]).join(found, "column", "left").select("column", *DESCRIBE)


def distinct_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_distinct without nulls. Each column is aggregated by itself, so nothing is expanded."""
    out = None
    for c in columns:
        one = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1).alias("_")).agg(F.lit(c).alias("column"), F.count("*").alias("n_distinct"))
        out = one if out is None else out.unionByName(one)
    return out


def low_cardinality(counts: DataFrame, most: int = 10) -> DataFrame:
    """Columns with at most ``most`` values; constant ones are marked."""
    return counts.where(F.col("n_distinct") <= most).withColumn("constant", F.col("n_distinct") <= 1)


def correlation(a: Column, b: Column) -> Column:
    """Pearson over rows where both are known; null where either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def correlations_with(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    one = rows.agg(*[correlation(F.col(c), F.col(label)).alias(f"{c}__r") for c in columns])
    return unpivot(one, columns, ["r"]).withColumn("abs_r", F.abs("r"))


def correlation_pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of all pairs of columns, one pass."""
    pairs = list(combinations(columns, 2))
    one = rows.agg(*[correlation(F.col(a), F.col(b)).alias(f"{a}|{b}__r") for a, b in pairs])
    flat = unpivot(one, [f"{a}|{b}" for a, b in pairs], ["r"], "pair")
    return flat.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")


def correlation_matrix(rows: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    pairs = correlation_pairs(rows, columns).select("a", "b", F.round("r", digits).alias("r"))
    own = rows.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(own)


def high_pairs(rows: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    return correlation_pairs(rows, columns).where(F.abs("r") >= least)


def means_by_label(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """column, one mean for each of the classes 0 and 1."""
    one = rows.agg(*[F.avg(F.when(F.col(label) == k, F.col(c))).alias(f"{c}__mean_{k}") for c in columns for k in (0, 1)])
    return unpivot(one, columns, ["mean_0", "mean_1"])


def binary_differences(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Features with exactly two values: class means and their difference."""
    two = distinct_counts(rows, columns).where("n_distinct = 2").select("column")
    out = means_by_label(rows, columns, label).join(two, "column", "left_semi")
    return out.withColumn("difference", F.col("mean_1") - F.col("mean_0"))


def medians_by_label(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Exact medians."""
    found = quantiles(rows.where(F.col(label).isin(0, 1)), columns, {"median": 0.5}, F.col(label).cast("int"))
    found = found.groupBy("column").agg(*[F.max(F.when(F.col("class") == k, F.col("median"))).alias(f"median_{k}") for k in (0, 1)])
    every = rows.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(found, "column", "left")


def skewness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected skewness; null for fewer than three values or a constant."""

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        n = F.count(x).cast("double")
        return F.when((n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)))

    return unpivot(rows.agg(*[one(c).alias(f"{c}__skew") for c in columns]), columns, ["skew"])


def split_summary(rows: DataFrame, split: str, label: str, key: str, group: str, phishing: int = 0) -> DataFrame:
    """Rows, unique keys and groups, class counts and the deviation of the phishing share from the whole."""
    whole = rows.agg(F.avg((F.col(label) == phishing).cast("double")).alias("overall"))
    each = rows.groupBy(split).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(key).alias("n_keys"),
        F.count_distinct(group).alias("n_groups"),
        F.count_if(F.col(label) == 0).alias("n_0"),
        F.count_if(F.col(label) == 1).alias("n_1"),
        F.avg((F.col(label) == phishing).cast("double")).alias("share"),
    )
    return each.crossJoin(F.broadcast(whole)).withColumn("deviation", F.col("share") - F.col("overall")).drop("overall")  # one row


def majority(rows: DataFrame, label: str) -> DataFrame:
    """The most frequent class, the smallest of equals, with its share."""
    counts = value_counts(rows, label)
    return counts.orderBy(F.col("n").desc(), "value").limit(1).select("value", "n", "share")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) of each class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))  # one row


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", rank).where(F.col("place") <= k)
