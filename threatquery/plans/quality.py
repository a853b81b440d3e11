"""Contract and coercion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatquery.functions.text import strip
from threatquery.operators import metrics as met, quality as ops
from threatquery.plans.catalogue import query, table
from threatquery.plans.scan import HOST, LISTED_SQL, listed, pages
from threatquery.plans.text import MESSAGES, messages
from threatquery.functions import urls


@query(f"SELECT label, count(*) AS n FROM ({MESSAGES}) WHERE label NOT IN ('benign', 'malicious') GROUP BY label")
def invalid_labels(spark, sf_dir):
    return ops.invalid_labels(messages(spark, sf_dir), "label", ["benign", "malicious"])


@query("SELECT count(*) AS n_rows, count(l.quality) AS n_kept FROM documents d LEFT JOIN labels l USING (doc_id)")
def drop_null_subset(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kept = rows.na.drop(subset=["text", "quality"]).agg(F.count("*").alias("n_kept"))
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(kept))  # one row each


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END::INT AS lang_id, CASE WHEN lang = 'de' THEN 'phishing' WHEN lang = 'en' THEN 'legitimate' ELSE 'unknown' END AS name FROM documents")
def label_index(spark, sf_dir):
    """Ids by sorted distinct label; the label set is small and joined back by broadcast of its proven few rows."""
    from threatquery.operators.models import index_labels

    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    out = index_labels("lang", "lang_id").fit(rows).transform(rows).withColumn("lang_id", F.col("lang_id").cast("int"))
    name = F.when(F.col("lang_id") == 0, "phishing").when(F.col("lang_id") == 1, "legitimate").otherwise("unknown")
    return out.select("doc_id", "lang_id", name.alias("name"))


@query(
    f"""SELECT count(*) AS n_rows, count_if(url IS NULL) AS null_url, count_if({HOST} IS NULL) AS null_host, count_if(NOT (CASE WHEN {LISTED_SQL} THEN 0 ELSE 1 END IN (0, 1))) AS bad_labels,
  array_to_string(list_sort(list_distinct(list(CASE WHEN {LISTED_SQL} THEN '0' ELSE '1' END))), ',') AS classes, count(*) - count(DISTINCT url) AS repeated FROM pages"""
)
def input_contract(spark, sf_dir):
    rows = pages(spark, sf_dir).select("url", urls.hostname(urls.components(F.col("url"))["domain"]).alias("host"), F.when(listed(F.col("url")), 0).otherwise(1).alias("label"))
    return ops.contract(rows, ["url", "host"], "label", "url")


@query(
    """WITH r AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'n/a' WHEN event_id % 10 = 1 THEN 'Infinity' WHEN event_id % 10 = 2 THEN NULL ELSE json_extract_string(props, '$.k') END AS raw FROM events),
x AS (SELECT raw, CASE WHEN isfinite(try_cast(raw AS DOUBLE)) THEN try_cast(raw AS DOUBLE) END AS x FROM r)
SELECT count(*) AS n_rows, count(x) AS n_numbers, count_if(raw IS NOT NULL AND x IS NULL) AS n_coerced, round(sum(x), 6) AS total FROM x"""
)
def numeric_coercion(spark, sf_dir):
    k = F.col("event_id") % 10
    raw = F.when(k == 0, "n/a").when(k == 1, "Infinity").when(k == 2, None).otherwise(F.get_json_object("props", "$.k"))
    return ops.coercion(table(spark, sf_dir, "events"), raw)


@query(
    """WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), n AS (
  SELECT count_if(doc_id IS NULL) AS a, count_if(lang IS NULL) AS b, count_if(quality IS NULL) AS c, count_if(toxic IS NULL) AS d FROM j)
SELECT 'doc_id' AS "column", a AS n_null FROM n UNION ALL SELECT 'lang', b FROM n UNION ALL SELECT 'quality', c FROM n UNION ALL SELECT 'toxic', d FROM n UNION ALL SELECT '', a + b + c + d FROM n"""
)
def null_totals(spark, sf_dir):
    return ops.null_totals(table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left"))


@query(
    """SELECT count(*) AS n_rows, count_if(truth NOT IN (0, 1) OR truth IS NULL) AS bad_truth, count_if(predicted NOT IN (0, 1)) AS bad_prediction, count_if(score IS NULL OR NOT isfinite(score)) AS bad_score FROM (
  SELECT l.quality AS truth, CASE WHEN doc_id % 9 = 0 THEN 2 ELSE doc_id % 2 END AS predicted, CASE WHEN doc_id % 8 = 0 THEN 'NaN'::DOUBLE WHEN doc_id % 8 = 1 THEN NULL ELSE n_chars / 100.0 END AS score
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
)
def metric_input_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    made = rows.select(
        F.col("quality").alias("truth"),
        F.when(k % 9 == 0, 2).otherwise(k % 2).alias("predicted"),
        F.when(k % 8 == 0, float("nan")).when(k % 8 == 1, None).otherwise(F.col("n_chars") / 100).alias("score"),
    )
    return ops.metric_violations(made, "truth", "predicted", "score")


@query("SELECT lang, count(DISTINCT quality) AS n_classes FROM documents JOIN labels USING (doc_id) GROUP BY lang HAVING count(DISTINCT quality) <> 2 UNION ALL SELECT 'all', 2")
def class_presence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = ops.class_presence(rows, "lang", "quality")
    return out.unionByName(rows.agg(F.lit("all").alias("lang"), F.count_distinct("quality").alias("n_classes")))


@query(
    f"""WITH raw AS (SELECT page_id AS k, CASE WHEN page_id % 8 = 0 THEN NULL WHEN page_id % 8 = 1 THEN ' ' || url ELSE url END AS u, CASE WHEN page_id % 9 = 0 THEN NULL WHEN {LISTED_SQL} THEN 0 ELSE 1 END AS y, {HOST} AS h FROM pages),
again AS (SELECT * FROM raw UNION ALL SELECT k + 1000000, u, y, h FROM raw)
SELECT k AS "row", trim(u) AS "URL", h AS "Domain", y::INT AS label FROM again WHERE u IS NOT NULL AND y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY u ORDER BY k) = 1"""
)
def url_clean(spark, sf_dir):
    """A raw table made of the pages: file names, missing values, padded and repeated URLs."""
    k = F.col("page_id")
    url = F.when(k % 8 == 0, None).when(k % 8 == 1, F.concat(F.lit(" "), "url")).otherwise(F.col("url"))
    label = F.when(k % 9 == 0, None).when(listed(F.col("url")), 0.0).otherwise(1.0)
    host = F.concat(urls.hostname(urls.components(F.col("url"))["domain"]), F.lit("\t"))
    raw = pages(spark, sf_dir).select(k.alias("row"), F.concat(k.cast("string"), F.lit(".txt")).alias("FILENAME"), url.alias("URL"), host.alias("Domain"), label.alias("label"))
    return ops.clean_urls(raw.unionByName(raw.withColumn("row", F.col("row") + 1000000)), "row")


@query("SELECT page_id, length(url) AS n FROM pages WHERE url IS NOT NULL")
def require_clean_rows(spark, sf_dir):
    """The failing form of a contract: a bad row would stop the query."""
    rows = ops.require(pages(spark, sf_dir), urls.admissible(strip(F.col("url"))), "a URL isn't admissible")
    return rows.select("page_id", F.length("url").cast("bigint").alias("n"))


@query("SELECT round(avg((quality = 1)::INT), 6) AS accuracy FROM labels")
def constant_prediction_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return met.binary(rows, F.col("quality") == 1, F.lit(True)).select(F.round("accuracy", 6).alias("accuracy"))
