"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatquery.llm import _store, chat, collocations, decontaminate, jaccard, language, lines, lm, packing, quality, resample, secrets, topk, toxicity

#: Name of a vocabulary file of the installed public tokenizers.
VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _store.bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (_store.remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op4_ngram_jaccard_join"] = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [x for x in [array_to_string(w, ' ')] if x <> ''] ELSE [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (n + m - c)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, x.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) x ON r.reached = x.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (doc_id)"""


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), ids.alias("items_sha256"), "contaminated")


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary()))


@query
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


ORACLES["op2_secret_scans"] = secrets.oracle()


#: The conversation that the contract adds to the table.
TRICKY = ((-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"))


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = [spark.range(1).select(F.lit(c).cast("bigint").alias("conv_id"), F.lit(t).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in TRICKY]
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky[0]).unionByName(tricky[1])
    return chat.digests(chat.formatted(every))


ORACLES["op6_chat_formatting"] = chat.oracle(TRICKY)


@query
def op9_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


ORACLES["op9_exact_top_k_search"] = """WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] for i in range(1, least(len(q.e), len(c.e)) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.row <> q.row
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM s
) WHERE rank <= 20"""


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", (_store.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (_store.remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op8_benchmark_decontamination"] = f"""WITH b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
h AS (SELECT DISTINCT doc_id, i, k, item_id FROM g JOIN win USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# DuckDB has no crc32: the table of the 256 bytes is made by its rule, and words are folded over it.
ORACLES["op11_importance_resampling"] = f"""WITH tab AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x FROM d), bw AS (SELECT unnest(w) AS x FROM b),
h AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
k AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h[2*i+1:2*i+2])::BIGINT for i in range(len(h) // 2)]), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (x) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (x) GROUP BY 1),
z AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), z),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN k USING (x) JOIN g USING (bucket) GROUP BY 1),
n AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(d.doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r FROM n)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM n WHERE n_features >= 20) * 10 // 100 THEN r END::BIGINT AS rank FROM r"""


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.report(table(spark, sf_dir, "documents"), least_docs=10, least_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_STRIPPED = "regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
ORACLES["op12_line_dedup"] = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT row, i, w[i] AS x FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d)), k AS (SELECT row, i, x, {_STRIPPED} AS k FROM l),
f AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row) >= 10),
o AS (SELECT row, count(*) AS n_lines, count(f.k) AS n_dropped, string_agg(x, chr(10) ORDER BY i) FILTER (f.k IS NULL) AS kept FROM k LEFT JOIN f ON k.k = f.k GROUP BY row)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN o USING (row)"""


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_phrase_collocations"] = f"""WITH p AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY 1),
g AS (SELECT lang, w[i:i+k-1] AS w, count(*)::HUGEINT AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) t(k)) GROUP BY 1, 2 HAVING count(*) >= 100),
c AS (SELECT lang, w, f AS a, unnest(range(1, len(w))) AS k FROM g WHERE len(w) > 1),
s AS (SELECT c.lang, c.w, a, k, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score FROM c JOIN g l ON l.lang = c.lang AND l.w = c.w[1:k] JOIN g r ON r.lang = c.lang AND r.w = c.w[k+1:] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
t AS (SELECT lang, w[i:i+k-1] AS w, max(f) AS longer FROM (SELECT lang, w, f, k, unnest(range(1, len(w) - k + 2)) AS i FROM g, range(2, 5) t(k) WHERE len(w) > k) GROUP BY 1, 2),
o AS (SELECT b.* FROM b LEFT JOIN t ON t.lang = b.lang AND t.w = b.w WHERE longer IS NULL OR 100 * longer < 100 * a),
q AS (SELECT *, array_to_string(w, ' ') AS phrase FROM o)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q) WHERE rank <= 2000"""
