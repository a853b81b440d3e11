"""Profiling queries over ``lineitem``, ``documents``, ``labels`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatquery.operators import profile as ops
from threatquery.plans.catalogue import query, table
from threatquery.plans.scan import HOST, LISTED_SQL, listed, pages
from threatquery.plans.text import MESSAGES, messages
from threatquery.functions import urls

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_LABELLED = "SELECT d.*, l.quality, l.toxic, length(d.text) AS n_text, (d.lang = 'en')::INT AS is_en FROM documents d JOIN labels l USING (doc_id)"


def labelled(spark, sf_dir, **numbers):
    """Labelled documents without their texts, and ``numbers`` of these; all are taken before the join, which would shuffle texts."""
    rows = table(spark, sf_dir, "documents").withColumns({"n_text": F.length("text"), "is_en": (F.col("lang") == "en").cast("int"), **numbers})
    return rows.drop("text").join(table(spark, sf_dir, "labels"), "doc_id")


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("SELECT lang AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_counts_share(spark, sf_dir):
    return rounded(ops.value_counts(table(spark, sf_dir, "documents"), "lang"), "share")


def _describe_sql(x):
    return f"""count({x})::DOUBLE AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x})::DOUBLE AS min, round(quantile_cont({x}, 0.25), 6) AS p25,
  round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75, max({x})::DOUBLE AS max"""


@query(f"SELECT lang, {_describe_sql('n')} FROM (SELECT lang, length(text)::DOUBLE AS n FROM documents) GROUP BY lang")
def grouped_describe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("n"))
    return rounded(ops.grouped_describe(rows, "lang", "n"), "mean", "std", "p25", "p50", "p75")


_SIZED = f"SELECT label, length(text)::DOUBLE AS x FROM ({MESSAGES})"


@query(
    f"""WITH m AS ({_SIZED}), e AS (SELECT label, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS a, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS b FROM m GROUP BY label),
s AS (SELECT label, k AS bin, a + k * ((b - a) / 40) AS low, CASE WHEN k = 39 THEN b ELSE a + (k + 1) * ((b - a) / 40) END AS high FROM e, range(40) r(k))
SELECT s.label, bin::BIGINT AS bin, round(low, 6) AS low, round(high, 6) AS high, count(x) AS n FROM s LEFT JOIN m ON m.label = s.label AND x >= low AND (x < high OR bin = 39 AND x <= high) GROUP BY ALL"""
)
def length_histogram(spark, sf_dir):
    """What stands behind the chart of message lengths by class."""
    rows = messages(spark, sf_dir).select("label", F.length("text").alias("x"))
    return rounded(ops.histogram(rows, "label", "x"), "low", "high")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_describe_sql(f'{c}::DOUBLE')} FROM lineitem" for c in NUMBERS))
def describe_all(spark, sf_dir):
    return rounded(ops.describe(table(spark, sf_dir, "lineitem"), NUMBERS), "mean", "std", "p25", "p50", "p75")


_COUNTED = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in _COUNTED))
def distinct_counts(spark, sf_dir):
    return ops.distinct_counts(table(spark, sf_dir, "lineitem"), _COUNTED)


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 1 AS constant FROM lineitem HAVING count(DISTINCT {c}) <= 10" for c in _COUNTED)
    + " UNION ALL SELECT 'one', 1, true"
)
def constant_lowcard(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return ops.low_cardinality(ops.distinct_counts(rows, [*_COUNTED, "one"]))


_FEATURES = ["n_chars", "n_text", "is_en", "toxic"]


def _corr(a, b):
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 6) END"


@query(
    f"WITH r AS ({_LABELLED}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_corr(c, 'quality')} AS r, abs({_corr(c, 'quality')}) AS abs_r FROM r" for c in _FEATURES) + " UNION ALL SELECT 'constant', NULL, NULL"
)
def corr_with_label(spark, sf_dir):
    out = ops.correlations_with(labelled(spark, sf_dir).withColumn("constant", F.lit(3)), [*_FEATURES, "constant"], "quality")
    return rounded(out, "r", "abs_r")


@query(f"WITH r AS ({_LABELLED}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN quality = 0 THEN {c} END), 6) AS mean_0, round(avg(CASE WHEN quality = 1 THEN {c} END), 6) AS mean_1 FROM r" for c in _FEATURES))
def mean_by_label(spark, sf_dir):
    return rounded(ops.means_by_label(labelled(spark, sf_dir), _FEATURES, "quality"), "mean_0", "mean_1")


_MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 2) AS r FROM lineitem" if a != b else f"SELECT '{a}' AS a, '{a}' AS b, 1.0 AS r" for a in _MATRIX for b in _MATRIX))
def corr_matrix(spark, sf_dir):
    return ops.correlation_matrix(table(spark, sf_dir, "lineitem"), _MATRIX)


@query(
    f"WITH r AS ({_LABELLED}), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b)} AS r FROM r" for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1 :]) + ") SELECT * FROM p WHERE abs(r) >= 0.8"
)
def high_corr_pairs(spark, sf_dir):
    return rounded(ops.high_pairs(labelled(spark, sf_dir), _FEATURES), "r")


_BINARY = ["is_en", "toxic"]


@query(
    f"WITH r AS ({_LABELLED}), m AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS k, avg(CASE WHEN quality = 0 THEN {c} END) AS m0, avg(CASE WHEN quality = 1 THEN {c} END) AS m1 FROM r" for c in _FEATURES)
    + ') SELECT "column", round(m0, 6) AS mean_0, round(m1, 6) AS mean_1, round(m1 - m0, 6) AS difference FROM m WHERE k = 2'
)
def binary_feature_diff(spark, sf_dir):
    return rounded(ops.binary_differences(labelled(spark, sf_dir), _FEATURES, "quality"), "mean_0", "mean_1", "difference")


@query(f"WITH r AS ({_LABELLED}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(median(CASE WHEN quality = 0 THEN {c}::DOUBLE END), 6) AS median_0, round(median(CASE WHEN quality = 1 THEN {c}::DOUBLE END), 6) AS median_1 FROM r" for c in _FEATURES))
def median_by_label(spark, sf_dir):
    return rounded(ops.medians_by_label(labelled(spark, sf_dir), _FEATURES, "quality"), "median_0", "median_1")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(skewness({c}::DOUBLE), 6) AS skew FROM lineitem" for c in NUMBERS) + " UNION ALL SELECT 'one', NULL")
def skewness_g1(spark, sf_dir):
    return rounded(ops.skewness(table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1)), [*NUMBERS, "one"]), "skew")


@query(
    f"""WITH p AS (SELECT page_id, url, {HOST} AS host, CASE WHEN {LISTED_SQL} THEN 0 ELSE 1 END AS label, CASE WHEN page_id % 10 < 7 THEN 'train' WHEN page_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM pages)
SELECT split, count(*) AS n_rows, count(DISTINCT url) AS n_keys, count(DISTINCT host) AS n_groups, count_if(label = 0) AS n_0, count_if(label = 1) AS n_1, round(avg((label = 0)::INT), 6) AS share,
  round(avg((label = 0)::INT) - (SELECT avg((label = 0)::INT) FROM p), 6) AS deviation FROM p GROUP BY split"""
)
def split_summary(spark, sf_dir):
    k = F.col("page_id") % 10
    rows = pages(spark, sf_dir).select("url", urls.hostname(urls.components(F.col("url"))["domain"]).alias("host"), F.when(listed(F.col("url")), 0).otherwise(1).alias("label"), F.when(k < 7, "train").when(k < 9, "val").otherwise("test").alias("split"))
    return rounded(ops.split_summary(rows, "split", "label", "url", "host"), "share", "deviation")


@query("SELECT quality AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY quality ORDER BY n DESC, value LIMIT 1")
def majority_baseline(spark, sf_dir):
    return rounded(ops.majority(table(spark, sf_dir, "labels"), "quality"), "share")


@query("SELECT lang, count(*) AS n, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight FROM documents GROUP BY lang")
def class_weights(spark, sf_dir):
    return rounded(ops.class_weights(table(spark, sf_dir, "documents"), "lang"), "weight")
