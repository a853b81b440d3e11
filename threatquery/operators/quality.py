"""Contracts on tables: violations as rows or counters, never a scan on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from threatquery.functions.text import strip
from threatquery.operators.dedup import keep_first
from threatquery.operators.features_ml import clean_number


def missing_columns(columns: Iterable[str], required: Iterable[str]) -> list[str]:
    have = set(columns)
    return [c for c in required if c not in have]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def type_histogram(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    for f in df.schema:
        out[f.dataType.simpleString()] = out.get(f.dataType.simpleString(), 0) + 1
    return out


def invalid_labels(rows: DataFrame, label: str, allowed: Iterable) -> DataFrame:
    """label, n of values outside the domain."""
    return rows.where(F.col(label).isNotNull() & ~F.col(label).isin(*allowed)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def contract(rows: DataFrame, required: list[str], label: str, unique: str) -> DataFrame:
    """One row of counters: rows, nulls in required columns, labels outside {0, 1}, classes that occur, repeated keys."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]
    keys = rows.groupBy(unique).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    base = rows.agg(
        F.count("*").alias("n_rows"),
        *nulls,
        F.count_if(~F.col(label).isin(0, 1)).alias("bad_labels"),
        F.array_join(F.array_sort(F.collect_set(F.col(label).cast("string"))), ",").alias("classes"),
    )
    return base.crossJoin(F.broadcast(keys))  # one row each


def require(rows: DataFrame, ok: Column, message: str) -> DataFrame:
    """``rows``, or a failure at the first row for which ``ok`` doesn't hold."""
    return rows.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def clean_urls(rows: DataFrame, order: str, url: str = "URL", label: str = "label", identifier: str = "FILENAME", domain: str = "Domain") -> DataFrame:
    """A URL table without its identifier column, rows that lack a URL or a label, and later rows of an equal URL.

    URLs and domains lose the blanks around them after that, so two URLs that
    differ in these only both stay. A label other than 0 or 1 fails the query.
    ``order`` is distinct and says which row comes first.
    """
    out = rows.drop(identifier).na.drop(subset=[url, label])
    out = keep_first(out, [url], order)
    stripped = {c: strip(F.col(c).cast("string")) for c in (url, domain) if c in out.columns}
    out = require(out.withColumns(stripped), F.col(label).isin(0, 1), "a label is neither 0 nor 1")
    return out.withColumn(label, F.col(label).cast("int"))


def null_totals(rows: DataFrame) -> DataFrame:
    """column, n_null of every column, and the total under ''."""
    each = [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns]
    one = rows.agg(*each)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null")) for c in rows.columns])
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n_null"])
    return one.select(F.explode(F.concat(pairs, F.array(F.struct(F.lit("").alias("column"), total.alias("n_null"))))).alias("x")).select("x.*")


def coercion(rows: DataFrame, column: Column) -> DataFrame:
    """How many values are numbers, and how many turn to null."""
    return rows.select(column.alias("raw"), clean_number(column).alias("x")).agg(
        F.count("*").alias("n_rows"), F.count("x").alias("n_numbers"), F.count_if(F.col("raw").isNotNull() & F.col("x").isNull()).alias("n_coerced"), F.round(F.sum("x"), 6).alias("total")
    )


def metric_violations(rows: DataFrame, truth: str, predicted: str, score: str) -> DataFrame:
    """Counters of inputs that metrics refuse."""
    x = F.col(score)
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(~F.col(truth).isin(0, 1) | F.col(truth).isNull()).alias("bad_truth"),
        F.count_if(~F.col(predicted).isin(0, 1) | F.col(predicted).isNull()).alias("bad_prediction"),
        F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad_score"),
    )


def class_presence(rows: DataFrame, split: str, label: str, classes: int = 2) -> DataFrame:
    """Splits that lack a class."""
    return rows.groupBy(split).agg(F.count_distinct(label).alias("n_classes")).where(F.col("n_classes") != classes)
