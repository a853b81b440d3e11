"""Duplicate and set-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatquery.operators import dedup as ops, splits as sp
from threatquery.plans.catalogue import query, table
from threatquery.plans.scan import HOST, pages
from threatquery.functions import urls


@query("SELECT doc_id, source FROM documents WHERE length(text) > 0 QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def exact_dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    # ranked by the hash of a text: only ids and digests are shuffled
    keyed = rows.select("doc_id", "source", F.length("text").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return ops.keep_first(keyed, ["h"], "doc_id").where("n > 0").select("doc_id", "source")


@query(
    """SELECT 'rows' AS what, count(*) - count(DISTINCT (url, html)) AS duplicates FROM pages UNION ALL SELECT 'urls', count(*) - count(DISTINCT url) FROM pages
UNION ALL SELECT 'text', (SELECT count(*) - count(DISTINCT text) FROM documents)"""
)
def duplicate_counts(spark, sf_dir):
    p = ops.duplicate_counts(pages(spark, sf_dir).withColumn("h", F.sha2(F.col("html").cast("binary"), 256)), rows=["url", "h"], urls=["url"])
    d = ops.duplicate_counts(table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h")), text=["h"])
    return p.unionByName(d)


@query()
def near_dup_mask(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    return ops.near_mask(rows, "row_id", "text")


@query()
def near_dup_mask_documents(spark, sf_dir):
    return ops.near_mask(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def _close_pairs(rows):
    """A theta join on a length band, met by blocks of the logarithm of the length; empty texts are a block of their own."""
    rows = rows.withColumn("n", F.length("text"))
    # a step a little wider than the band, so that rounding of a logarithm can't part a pair at its edge
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.09 / 0.92))).cast("int")
    band = F.when(F.col("n") == 0, -9).otherwise(step)
    a = rows.select(F.col("item_id").alias("a"), F.col("text").alias("x"), F.col("n").alias("m"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    b = rows.select(F.col("item_id").alias("b"), F.col("text").alias("y"), "n", band.alias("band"))
    pairs = a.join(b, "band").where("a < b and abs(m - n) <= 0.08 * (m + n)").withColumn("distance", F.levenshtein("x", "y"))
    return pairs.where("distance <= 0.7 * greatest(m, n)").select("a", "b", "distance")


@query(
    """WITH c AS (SELECT c, chr(row_number() OVER (ORDER BY c)::INT) AS k FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark)),
m AS (SELECT string_agg(c, '' ORDER BY c) AS a, string_agg(k, '' ORDER BY c) AS b FROM c),
t AS (SELECT item_id, translate(text, a, b) AS text FROM benchmark, m)
SELECT a.item_id AS a, b.item_id AS b, levenshtein(a.text, b.text)::INT AS distance FROM t a JOIN t b
ON a.item_id < b.item_id AND abs(length(a.text) - length(b.text)) <= 0.08 * (length(a.text) + length(b.text)) WHERE levenshtein(a.text, b.text) <= 0.7 * greatest(length(a.text), length(b.text))"""
)
def near_dup_candidates(spark, sf_dir):
    """Pairs of whole texts, by code points. DuckDB counts edits by bytes, so its twin first gives each character of the table a byte of its own, which holds for up to 127 of them."""
    return _close_pairs(table(spark, sf_dir, "benchmark").select("item_id", "text"))


_SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END"


def _split():
    k = F.col("doc_id") % 10
    return F.when(k < 7, "train").when(k < 9, "val").otherwise("test")


@query(f"SELECT md5(text) AS key, count(DISTINCT {_SPLIT}) AS n_splits FROM documents GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1")
def split_overlap_md5(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(_split().alias("split"), "text")
    return ops.overlaps(rows, "split", F.md5(F.col("text").cast("binary")))


@query(f"SELECT key, n_splits FROM (SELECT {HOST} AS key, count(DISTINCT page_id % 5) AS n_splits FROM pages GROUP BY 1) WHERE n_splits > 1 ORDER BY key LIMIT 10")
def domain_overlap(spark, sf_dir):
    """At most ten sorted examples."""
    rows = pages(spark, sf_dir).select((F.col("page_id") % 5).alias("fold"), urls.hostname(urls.components(F.col("url"))["domain"]).alias("host"))
    return ops.overlaps(rows, "fold", F.col("host")).orderBy("key").limit(10)


@query(
    """WITH parts AS (SELECT CASE WHEN page_id % 9 = 0 THEN url || '?x' ELSE url END AS url FROM pages UNION ALL SELECT url FROM pages WHERE length(url) < 32),
a AS (SELECT url, count(*) AS a FROM pages GROUP BY url), b AS (SELECT url, count(*) AS b FROM parts GROUP BY url)
SELECT (SELECT count(*) FROM pages) AS n_whole, (SELECT count(*) FROM parts) AS n_parts, count_if(coalesce(b, 0) = 0) AS missing, count_if(coalesce(a, 0) = 0) AS extra, count_if(coalesce(b, 0) > 1) AS repeated FROM a FULL JOIN b USING (url)"""
)
def coverage_check(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", "url")
    parts = rows.select(F.when(F.col("page_id") % 9 == 0, F.concat("url", F.lit("?x"))).otherwise(F.col("url")).alias("url")).unionByName(rows.where("length(url) < 32").select("url"))
    return ops.coverage(rows.select("url"), parts, "url")


@query("SELECT origin, count(*) AS n, count(DISTINCT text) AS n_texts FROM (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY origin")
def merge_sources(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text")
    b = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), "text")
    hashed = a.unionByName(b).select("origin", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return hashed.groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("h").alias("n_texts"))


_ORDER = "md5('42|' || doc_id::VARCHAR)"
_STRATIFIED = f"""SELECT doc_id, lang, CASE WHEN r <= t THEN 'train' WHEN r <= t + (n - t) // 2 THEN 'val' ELSE 'test' END AS split FROM (
  SELECT doc_id, lang, r, n, floor(n * 0.7 + 0.5)::BIGINT AS t FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents))"""


@query(_STRATIFIED)
def stratified_split(spark, sf_dir):
    return sp.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "split")


@query(f"SELECT split, lang, count(*) AS n FROM ({_STRATIFIED}) GROUP BY split, lang")
def stratified_split_counts(spark, sf_dir):
    return stratified_split(spark, sf_dir).groupBy("split", "lang").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, ('0x' || substr(md5({HOST}), 1, 8))::BIGINT % 5 AS fold FROM pages")
def group_folds_hash(spark, sf_dir):
    host = urls.hostname(urls.components(F.col("url"))["domain"])
    return pages(spark, sf_dir).select("page_id", sp.hash_fold(host).alias("fold"))


@query()
def group_folds_greedy(spark, sf_dir):
    from threatquery.plans.scan import listed

    host = urls.hostname(urls.components(F.col("url"))["domain"])
    return sp.greedy_folds(pages(spark, sf_dir).select(host.alias("host"), listed(F.col("url")).cast("int").alias("label")), "host", "label")


@query(f"SELECT doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}, doc_id) - 1) % 5)::INT AS fold FROM documents")
def stratified_cv_folds(spark, sf_dir):
    return sp.stratified_folds(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "fold")


@query(f"SELECT doc_id FROM documents ORDER BY {_ORDER}, doc_id LIMIT 100")
def sample_hash(spark, sf_dir):
    return sp.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)
