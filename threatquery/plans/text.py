"""Message queries over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatquery.functions import hashing, lexicons as lex, text as tx
from threatquery.operators import lemmas
from threatquery.plans.catalogue import literal, query, table

# Classes of the supplied rows in the spellings of a raw message table.
LABEL_SQL = "CASE WHEN l.toxic = 1 THEN ' Smishing ' WHEN l.quality = 0 THEN 'SPAM' WHEN l.doc_id IS NOT NULL THEN 'ham' ELSE 'Unlabelled' END"
STANDARD_SQL = "CASE WHEN l.toxic = 1 THEN 'malicious' WHEN l.quality = 0 THEN 'malicious' WHEN l.doc_id IS NOT NULL THEN 'benign' ELSE 'unlabelled' END"
MESSAGES = f"SELECT d.doc_id, d.text, {STANDARD_SQL} AS label FROM documents d LEFT JOIN labels l USING (doc_id)"


def messages(spark, sf_dir, raw: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("_known", F.lit(True)), "doc_id", "left")
    label = F.when(F.col("toxic") == 1, " Smishing ").when(F.col("quality") == 0, "SPAM").when(F.col("_known"), "ham").otherwise("Unlabelled")
    return rows.select("doc_id", "text", (label if raw else tx.standard_label(label)).alias("label"))


def in_sql(words, column: str = "text") -> str:
    return f"regexp_matches({column}, {literal(lex.bounded_re2(words))})"


def category_sql(categories) -> str:
    cases = " ".join(f"WHEN {in_sql(words)} THEN '{name}'" for name, words in categories.items())
    return f"CASE WHEN label <> 'malicious' THEN '{lex.BENIGN}' {cases} ELSE '{lex.OTHER_SCAM}' END"


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\\s\\x0B]+', ' ', 'g'))) AS digest, length(trim(regexp_replace(lower(text), '[\\s\\x0B]+', ' ', 'g'))) AS size FROM documents")
def text_normalize(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", tx.normalize(F.col("text")).alias("t"))
    return out.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("bigint").alias("size"))


@query(f"SELECT label, count(*) AS n FROM ({MESSAGES}) GROUP BY label")
def label_standardize(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


def _categories(spark, sf_dir, categories):
    return messages(spark, sf_dir).select("doc_id", "label", "text", tx.category(F.col("text"), F.col("label"), categories).alias("category"))


@query(f"SELECT doc_id, label, {category_sql(lex.CATEGORIES)} AS category FROM ({MESSAGES})")
def category_assign(spark, sf_dir):
    return _categories(spark, sf_dir, lex.CATEGORIES).drop("text")


@query(f"SELECT doc_id, label, {category_sql(lex.DATA_CATEGORIES)} AS category FROM ({MESSAGES})")
def category_assign_data_list(spark, sf_dir):
    return _categories(spark, sf_dir, lex.DATA_CATEGORIES).drop("text")


def _matched_sql(categories):
    found = {name: "[x for x in [" + ", ".join(f"CASE WHEN {in_sql([w])} THEN {literal(w)} END" for w in words) + "] if x IS NOT NULL]" for name, words in categories.items()}
    return ", ".join(f"array_to_string({e}, ',') AS {n}" for n, e in found.items())


def _matched(spark, sf_dir, categories):
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.matched_keywords(F.col("text"), categories).alias("m"))
    return rows.select("doc_id", *[F.coalesce(F.array_join(F.try_element_at("m", F.lit(n)), ","), F.lit("")).alias(n) for n in categories])


@query(f"SELECT doc_id, {_matched_sql(lex.CATEGORIES)} FROM documents")
def keyword_matches(spark, sf_dir):
    return _matched(spark, sf_dir, lex.CATEGORIES)


@query(f"SELECT doc_id, {_matched_sql(lex.DATA_CATEGORIES)} FROM documents")
def keyword_matches_data_list(spark, sf_dir):
    return _matched(spark, sf_dir, lex.DATA_CATEGORIES)


_CATEGORIZED = f"SELECT doc_id, text, label, {category_sql(lex.DATA_CATEGORIES)} AS category FROM ({MESSAGES})"
_HAS_OWN = "CASE category " + " ".join(f"WHEN '{n}' THEN {in_sql(w)}" for n, w in lex.DATA_CATEGORIES.items()) + " ELSE false END"
_MATCHES = " + ".join(f"{in_sql(w)}::INT" for w in lex.DATA_CATEGORIES.values())


@query(f"SELECT category, count(*) AS total, count_if(NOT {_HAS_OWN}) AS zero_keyword FROM ({_CATEGORIZED}) WHERE category NOT IN ('benign') GROUP BY category")
def zero_keyword_audit(spark, sf_dir):
    own = F.coalesce(*[F.when(F.col("category") == n, F.col("text").rlike(p)) for n, p in lex.patterns(lex.DATA_CATEGORIES).items()], F.lit(False))
    rows = _categories(spark, sf_dir, lex.DATA_CATEGORIES).where("category <> 'benign'")
    return rows.groupBy("category").agg(F.count("*").alias("total"), F.count_if(~own).alias("zero_keyword"))


def _n_categories() -> Column:
    parts = [F.col("text").rlike(p).cast("int") for p in lex.patterns(lex.DATA_CATEGORIES).values()]
    return sum(parts[1:], parts[0])


@query(f"SELECT label, count(*) AS total, count_if({_MATCHES} >= 2) AS ambiguous FROM ({MESSAGES}) GROUP BY label")
def ambiguity_audit(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("label").agg(F.count("*").alias("total"), F.count_if(_n_categories() >= 2).alias("ambiguous"))


@query(f"SELECT doc_id, label, category FROM ({_CATEGORIZED}) WHERE {_MATCHES} >= 2 ORDER BY label <> 'malicious', doc_id LIMIT 10")
def ambiguity_examples(spark, sf_dir):
    """The first ten, malicious ones before the others."""
    rows = _categories(spark, sf_dir, lex.DATA_CATEGORIES).where(_n_categories() >= 2)
    return rows.orderBy(F.col("label") != "malicious", "doc_id").limit(10).select("doc_id", "label", "category")


@query(f"SELECT category, count(*) AS n, count(*) < 50 AS flagged FROM ({_CATEGORIZED}) GROUP BY category")
def category_support(spark, sf_dir):
    return _categories(spark, sf_dir, lex.DATA_CATEGORIES).groupBy("category").agg(F.count("*").alias("n")).withColumn("flagged", F.col("n") < 50)


_W = "[^\\p{L}\\p{N}_]"
_IPV4 = "((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_STOP = "[^\\s<>{}\"'']"
_SHORT = lex.alternation(lex.MESSAGE_SHORTENERS)
_FLAGS = {
    "https_present": f"regexp_matches(text, '(?i)(^|{_W})https://')",
    "shortener_used": f"regexp_matches(text, '(?i)({_SHORT})([/?#\\s]|$)')",
    "ip_as_domain": f"regexp_matches(text, '(?i)(https?://|^|{_W}){_IPV4}(:[0-9]{{1,5}})?([/?#\\s]|$)')",
    "plain": f"regexp_matches(text, '(?i)(^|{_W})(https?://|www\\.){_STOP}+|(^|{_W})[a-z0-9.-]+\\.({'|'.join(lex.BARE_TLDS)})')",
}


@query(f"SELECT doc_id, https_present OR shortener_used OR ip_as_domain OR plain AS has_url, shortener_used, ip_as_domain, https_present FROM (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in _FLAGS.items())} FROM documents)")
def message_url_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in tx.url_flags(F.col("text")).items()])


def _text_flags_sql(urgent, money):
    return f"length(text)::INT AS length, {in_sql(urgent)} AS has_urgent_word, regexp_matches(text, '[{lex.MONEY_SIGNS}]') OR {in_sql(money)} AS has_money_word"


@query(f"SELECT doc_id, {_text_flags_sql(lex.URGENT, lex.MONEY)} FROM documents")
def message_text_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in tx.text_flags(F.col("text")).items()])


@query(f"SELECT doc_id, {_text_flags_sql(lex.DATA_URGENT, lex.DATA_MONEY)} FROM documents")
def message_text_flags_data_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in tx.text_flags(F.col("text"), lex.DATA_URGENT, lex.DATA_MONEY).items()])


@query(
    f"""SELECT doc_id, ((https_present OR shortener_used OR ip_as_domain OR plain)::INT)::DOUBLE AS f1, shortener_used::INT::DOUBLE AS f2, ip_as_domain::INT::DOUBLE AS f3, https_present::INT::DOUBLE AS f4,
  length::DOUBLE AS f5, has_urgent_word::INT::DOUBLE AS f6, has_money_word::INT::DOUBLE AS f7
FROM (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in _FLAGS.items())}, {_text_flags_sql(lex.DATA_URGENT, lex.DATA_MONEY)} FROM documents)"""
)
def handcrafted_vector(spark, sf_dir):
    made = tx.handcrafted(F.col("text"), urgent=lex.DATA_URGENT, money=lex.DATA_MONEY)
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("v")).select("doc_id", *[F.col("v")[k].alias(f"f{k + 1}") for k in range(7)])


@query()
def nlp_tokens(spark, sf_dir):
    stop = tx.default_stopwords()
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.nlp_tokens(F.col("text"), stop), " ").alias("tokens"))


_NLP_STOP = ["the", "of", "and", "der", "la"]


@query(
    f"""SELECT doc_id, array_to_string([t for t in string_split(regexp_replace(regexp_replace(lower(text), '[0-9]{{5,}}', 'numtoken', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), ' ')
  if t <> '' AND t NOT IN ({', '.join(map(literal, _NLP_STOP))})], ' ') AS tokens
FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"""
)
def nlp_tokens_plain(spark, sf_dir):
    """Conversations hold neither URLs nor phone numbers, so SQL can follow; without lemmas."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return rows.select("doc_id", F.array_join(tx.nlp_tokens(F.col("text"), _NLP_STOP, lemmatize=False), " ").alias("tokens"))


_RULES = " ".join(f"UNION ALL SELECT word, left(word, length(word) - {len(end)}) || '{new}' AS result FROM own WHERE suffix(word, '{end}')" for end, new in lemmas.RULES)
_RULES2 = " ".join(f"UNION ALL SELECT word, left(result, length(result) - {len(end)}) || '{new}' AS result FROM once WHERE suffix(result, '{end}')" for end, new in lemmas.RULES)


@query(
    f"""WITH t AS (SELECT doc_id, [t for t in string_split(regexp_replace(regexp_replace(lower(text), '[0-9]{{5,}}', 'numtoken', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), ' ')
  if t <> '' AND t NOT IN ({', '.join(map(literal, _NLP_STOP))})] AS w FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)),
own AS (SELECT DISTINCT unnest(w) AS word FROM t), once AS ({_RULES.removeprefix("UNION ALL ")}), twice AS ({_RULES2.removeprefix("UNION ALL ")}),
f AS (SELECT 0 AS late, word, word AS result FROM own UNION ALL SELECT 0, * FROM once UNION ALL SELECT 1, * FROM twice),
l AS (SELECT word, arg_min(result, (late, length(result))) AS lemma FROM f WHERE result IN (SELECT word FROM own) GROUP BY word),
e AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t))
SELECT t.doc_id, coalesce(x, '') AS tokens FROM t LEFT JOIN (SELECT doc_id, string_agg(lemma, ' ' ORDER BY i) AS x FROM e JOIN l USING (word) GROUP BY doc_id) USING (doc_id)"""
)
def nlp_tokens_lemmas(spark, sf_dir):
    """Lemmas that the table's own words know."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    made = rows.select("doc_id", tx.nlp_tokens(F.col("text"), _NLP_STOP, lemmatize=False).alias("tokens"))
    return lemmas.lemmatized(made, "doc_id", "tokens").select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query()
def nlp_tokens_documents(spark, sf_dir):
    """The whole preprocessing over documents, with lemmas that their own words know."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.nlp_tokens(F.col("text"), tx.default_stopwords(), lemmatize=False).alias("tokens"))
    return lemmas.lemmatized(rows, "doc_id", "tokens").select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"SELECT label, count(*) AS n, round(avg(regexp_matches(text, 'http[s]?://|www\\.|Licensed')::INT), 6) AS rate, sum(regexp_matches(text, 'http[s]?://|www\\.')::INT)::BIGINT AS n_url FROM ({MESSAGES}) GROUP BY label")
def presence_rate(spark, sf_dir):
    hit = F.col("text").rlike(tx.PLAIN_URL + "|Licensed").cast("int")
    return messages(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("rate"), F.sum(F.col("text").rlike(tx.PLAIN_URL).cast("int")).alias("n_url"))


_EDGE = """[.,!?:;"'']"""


@query(
    f"""WITH w AS (SELECT label, regexp_replace(regexp_replace(t, '^{_EDGE}+', ''), '{_EDGE}+$', '') AS word
  FROM (SELECT label, unnest(string_split_regex(lower(text), '[\\s\\x0B]+')) AS t FROM ({MESSAGES})) WHERE t <> ''),
c AS (SELECT label, word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(map(literal, lex.EDA_STOPWORDS))}) GROUP BY label, word),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS place FROM c)
SELECT label, word, n, place::INT AS place FROM r WHERE place <= 15"""
)
def top_words_per_class(spark, sf_dir):
    words = messages(spark, sf_dir).select("label", F.explode(tx.edge_stripped_words(F.col("text"))).alias("word")).where(~F.col("word").isin(*lex.EDA_STOPWORDS))
    counts = words.groupBy("label", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.col("n").desc(), "word"))
    return counts.withColumn("place", place).where("place <= 15")


_GRAMS = """WITH t AS (SELECT conv_id * 1000 + turn AS id, [x for x in regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')] AS w FROM conversations),
g AS (SELECT id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS term FROM t),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY id, term),
df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
vocab AS (SELECT term, df FROM df QUALIFY row_number() OVER (ORDER BY total DESC, term) <= 5000),
w AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS x FROM tf JOIN vocab USING (term)),
n AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM w)"""


@query(f"{_GRAMS} SELECT term, count(*) AS n_docs, round(sum(weight), 6) AS total_weight FROM n GROUP BY term QUALIFY row_number() OVER (ORDER BY round(sum(weight), 6) DESC, term) <= 100")
def tfidf_top_terms(spark, sf_dir):
    """The hundred terms with the largest weight; the vocabulary is the 5000 most frequent uni- and bigrams."""
    return _top_terms(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))


_GRAMS_DOCUMENTS = _GRAMS.replace("conv_id * 1000 + turn AS id", "doc_id AS id").replace("FROM conversations", "FROM documents")


@query(f"{_GRAMS_DOCUMENTS} SELECT term, count(*) AS n_docs, round(sum(weight), 6) AS total_weight FROM n GROUP BY term QUALIFY row_number() OVER (ORDER BY round(sum(weight), 6) DESC, term) <= 100")
def tfidf_top_terms_documents(spark, sf_dir):
    return _top_terms(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _top_terms(rows):
    from threatquery.operators.features_ml import tfidf

    out = tfidf(rows, "id", "text", max_features=5000).groupBy("term").agg(F.count("*").alias("n_docs"), F.round(F.sum("weight"), 6).alias("total_weight"))
    return out.orderBy(F.col("total_weight").desc(), "term").limit(100)


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(translate(trim(text), '‘’“”‚„`´', '''''\"\"''\"''''')), '[\\p{L}\\p{M}\\p{Nd}_]+|[^\\s\\p{L}\\p{M}\\p{Nd}_]+'), ' ') AS canonical FROM documents")
def message_canonical(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.message_tokens(F.col("text")).alias("canonical"))


@query()
def message_canonical_nfkc(spark, sf_dir):
    """The full form; SQL has no NFKC."""
    return table(spark, sf_dir, "documents").select("doc_id", hashing.canonical_message_column(F.col("text")).alias("canonical"))


@query()
def message_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", hashing.message_fingerprint(F.col("text")).alias("threat_hash"))
