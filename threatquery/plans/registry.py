"""Registry queries: seeding, guarded inserts, export, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatquery.functions import hashing, text as tx
from threatquery.operators import ownership, registry as reg
from threatquery.plans.catalogue import query, table
from threatquery.plans.scan import CANONICAL, LISTED_SQL, REGISTRY, listed, pages, registry_of, simple_hash
from threatquery.plans.text import LABEL_SQL, messages

# URL rows with a label in several spellings, some blank or unknown; conversations of pages repeat URLs with another spelling.
_SEED_SQL = f"""SELECT page_id AS source_row, url AS raw, CASE WHEN page_id % 11 = 0 THEN 'odd' WHEN page_id % 13 = 0 THEN '' WHEN {LISTED_SQL} THEN '0' ELSE 'Legitimate' END AS key, {CANONICAL} AS canonical FROM pages
UNION ALL SELECT 1000000 + page_id, upper(regexp_extract(url, '^[a-z]+')) || substr(url, length(regexp_extract(url, '^[a-z]+')) + 1), 'phishing', {CANONICAL} FROM pages WHERE {LISTED_SQL}
UNION ALL SELECT 2000000 + page_id, url, ' PHISHING ', {CANONICAL} FROM pages WHERE {LISTED_SQL}"""
_CLASSIFIED = f"""WITH rows AS ({_SEED_SQL}), states AS (
  SELECT *, CASE WHEN trim(key) = '' OR lower(trim(key)) = 'odd' THEN 'invalid' WHEN lower(trim(key)) IN ('0', 'phishing', 'malicious', 'threat') THEN 'threat' ELSE 'benign' END AS state,
    md5('url:' || canonical) AS h FROM rows
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY state, raw ORDER BY source_row) AS raw_rank, row_number() OVER (PARTITION BY state, h ORDER BY source_row) AS hash_rank FROM states
)"""


def _seed_rows(spark, sf_dir):
    rows = pages(spark, sf_dir)
    k = F.col("page_id")
    first = rows.select(k.alias("source_row"), "url", F.when(k % 11 == 0, "odd").when(k % 13 == 0, "").when(listed(F.col("url")), "0").otherwise("Legitimate").alias("label"))
    threat = rows.where(listed(F.col("url")))
    scheme = F.regexp_extract("url", "^[a-z]+", 0)
    upper = F.concat(F.upper(scheme), F.regexp_replace("url", "^[a-z]+", ""))
    again = threat.select((k + 1000000).alias("source_row"), upper.alias("url"), F.lit("phishing").alias("label"))
    third = threat.select((k + 2000000).alias("source_row"), "url", F.lit(" PHISHING ").alias("label"))
    return first.unionByName(again).unionByName(third)


def _classified(spark, sf_dir, limit=None):
    # an equal stand-in in SQL: the scheme's case is settled before the hash
    rows = _seed_rows(spark, sf_dir)
    return reg.classified(rows, "url", "label", "source_row", simple_hash, reg.URL, limit=limit)


@query(f"{_CLASSIFIED} SELECT h AS threat_hash, 1 AS threat_type, 1 AS verdict, 100 AS confidence, source_row FROM ranked WHERE state = 'threat' AND hash_rank = 1")
def seed_records(spark, sf_dir):
    return reg.seeds(_classified(spark, sf_dir), reg.URL)


@query(f"{_CLASSIFIED} SELECT h AS threat_hash, source_row FROM ranked WHERE state = 'threat' AND hash_rank = 1 ORDER BY source_row LIMIT 5")
def seed_limit_prefix(spark, sf_dir):
    """The limit counts unique records, and ends reading and hashing."""
    return reg.seeds(_classified(spark, sf_dir, 5), reg.URL, limit=5).select("threat_hash", "source_row")


@query(
    f"""{_CLASSIFIED} SELECT count(*) AS total_records, count_if(state = 'invalid') AS invalid_records, count_if(state = 'benign') AS benign_records, count_if(state = 'threat') AS threat_records,
  count_if(state = 'threat' AND raw_rank > 1) AS raw_duplicate_records, count_if(state = 'threat' AND hash_rank > 1) AS canonical_duplicate_records,
  count_if(state = 'threat' AND hash_rank = 1) AS unique_threat_hashes, count_if(state = 'threat' AND hash_rank = 1) AS url_threats, 0::BIGINT AS message_threats FROM ranked"""
)
def seed_two_tier_stats(spark, sf_dir):
    return reg.statistics(_classified(spark, sf_dir), reg.URL)


@query(
    f"""{_CLASSIFIED}, cut AS (SELECT max(source_row) AS last_row FROM (SELECT source_row FROM ranked WHERE state = 'threat' AND hash_rank = 1 ORDER BY source_row LIMIT 5)),
seen AS (SELECT * FROM ranked, cut WHERE source_row <= last_row)
SELECT count(*) AS total_records, count_if(state = 'invalid') AS invalid_records, count_if(state = 'benign') AS benign_records, count_if(state = 'threat') AS threat_records,
  count_if(state = 'threat' AND raw_rank > 1) AS raw_duplicate_records, count_if(state = 'threat' AND hash_rank > 1) AS canonical_duplicate_records,
  count_if(state = 'threat' AND hash_rank = 1) AS unique_threat_hashes, count_if(state = 'threat' AND hash_rank = 1) AS url_threats, 0::BIGINT AS message_threats FROM seen"""
)
def seed_limit_stats(spark, sf_dir):
    """Seeding stops at the fifth unique record, and so do its counters."""
    return reg.statistics(_classified(spark, sf_dir, 5), reg.URL, limit=5)


@query(f"{_CLASSIFIED} SELECT h AS \"threatHash\", 'URL' AS \"threatType\", 1 AS \"threatTypeInt\", 1 AS verdict, 100 AS confidence FROM ranked WHERE state = 'threat' AND hash_rank = 1")
def seed_export(spark, sf_dir):
    return reg.export(reg.seeds(_classified(spark, sf_dir), reg.URL))


@query()
def seed_records_keccak(spark, sf_dir):
    """Seeds with the real fingerprint; messages by their toxicity labels."""
    rows = messages(spark, sf_dir, raw=True)
    found = reg.classified(rows, "text", "label", "doc_id", hashing.message_fingerprint, reg.MESSAGE)
    return reg.seeds(found, reg.MESSAGE)


@query(f"WITH registry AS ({REGISTRY}) SELECT page_id FROM pages WHERE md5('url:' || {CANONICAL}) NOT IN (SELECT threat_hash FROM registry)")
def registry_skip_existing(spark, sf_dir):
    rows = pages(spark, sf_dir)
    return reg.missing(rows.select("page_id", simple_hash().alias("threat_hash")), registry_of(rows)).select("page_id")


@query(f"SELECT count(*) AS total, count_if(threat_type = 0) AS messages, count_if(threat_type = 1) AS urls FROM (SELECT threat_hash, threat_type FROM ({REGISTRY}) UNION ALL SELECT DISTINCT md5('message:' || text), 0 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def registry_counters(spark, sf_dir):
    urls = registry_of(pages(spark, sf_dir))
    toxic = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    made = toxic.select(F.md5(F.concat(F.lit("message:"), "text").cast("binary")).alias("threat_hash")).distinct().select("threat_hash", F.lit(reg.MESSAGE).alias("threat_type"), F.lit(1).alias("verdict"), F.lit(100).alias("confidence"))
    return reg.counters(urls.unionByName(made))


# A batch with every kind of refusal, by nulls too; rows repeat hashes within the batch.
_BATCH = f"""SELECT page_id AS seq, CASE WHEN page_id % 17 = 0 THEN '{reg.ZERO_HASH}' WHEN page_id % 37 = 0 THEN NULL ELSE md5((page_id // 2)::VARCHAR) END AS threat_hash,
  CASE WHEN page_id % 7 = 0 THEN 2 WHEN page_id % 23 = 0 THEN NULL ELSE (page_id % 2)::INT END AS verdict, CASE WHEN page_id % 31 = 0 THEN NULL ELSE (page_id % 120)::INT END AS confidence,
  CASE WHEN page_id % 19 = 0 THEN 'eve' WHEN page_id % 29 = 0 THEN NULL ELSE 'owner' END AS submitter FROM pages"""
_KNOWN = "SELECT DISTINCT md5((page_id // 2)::VARCHAR) AS threat_hash FROM pages WHERE length(url) > 45"


@query(
    f"""WITH batch AS ({_BATCH}), known AS ({_KNOWN}), s AS (
  SELECT b.*, CASE WHEN submitter IS DISTINCT FROM 'owner' THEN 'NotOwner' WHEN b.threat_hash IS NULL OR b.threat_hash = '{reg.ZERO_HASH}' THEN 'ZeroHash' WHEN k.threat_hash IS NOT NULL THEN 'DuplicateHash'
    WHEN verdict IS NULL OR verdict NOT BETWEEN 0 AND 1 THEN 'InvalidVerdict' WHEN confidence IS NULL OR confidence NOT BETWEEN 0 AND 100 THEN 'ConfidenceOutOfRange' END AS st
  FROM batch b LEFT JOIN known k ON b.threat_hash = k.threat_hash
), e AS (SELECT *, coalesce(max((st IS NULL)::INT) OVER (PARTITION BY threat_hash ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM s)
SELECT seq, CASE WHEN earlier = 1 AND (st IS NULL OR st IN ('InvalidVerdict', 'ConfidenceOutOfRange')) THEN 'DuplicateHash' ELSE st END AS reason FROM e"""
)
def registry_insert_guarded(spark, sf_dir):
    return _decided(spark, sf_dir).select("seq", "reason")


def _decided(spark, sf_dir):
    rows = pages(spark, sf_dir)
    k = F.col("page_id")
    half = F.md5(F.floor(k / 2).cast("string").cast("binary"))
    batch = rows.select(
        k.alias("seq"),
        F.when(k % 17 == 0, reg.ZERO_HASH).when(k % 37 != 0, half).alias("threat_hash"),
        F.lit(reg.URL).alias("threat_type"),
        F.when(k % 7 == 0, 2).when(k % 23 != 0, k % 2).cast("int").alias("verdict"),
        F.when(k % 31 != 0, k % 120).cast("int").alias("confidence"),
        F.when(k % 19 == 0, "eve").when(k % 29 != 0, "owner").alias("submitter"),
    )
    known = rows.where("length(url) > 45").select(half.alias("threat_hash"))
    return reg.guarded_insert(known, batch, "owner")


# Calls by the second: each event is an insert or a transfer of one of four owners, some to nobody.
_CALLS = """SELECT event_id AS seq, CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN 'transfer' ELSE 'insert' END AS kind, CASE WHEN user_id % 13 = 0 THEN NULL ELSE 'owner ' || (user_id % 4) END AS caller,
  CASE WHEN event_id % 11 = 0 THEN '0x0000000000000000000000000000000000000000' WHEN event_id % 17 = 0 THEN NULL ELSE 'owner ' || ((user_id + event_id) % 4) END AS new_owner FROM events"""


@query(
    f"""WITH RECURSIVE c AS ({_CALLS}), t AS (SELECT seq, caller, new_owner FROM c WHERE kind = 'transfer' AND caller IS NOT NULL AND new_owner IS NOT NULL AND new_owner <> '0x0000000000000000000000000000000000000000'),
p AS (SELECT -1::BIGINT AS seq, 'owner 0' AS owner UNION ALL SELECT n.seq, n.new_owner FROM p, LATERAL (SELECT seq, new_owner FROM t WHERE t.seq > p.seq AND t.caller = p.owner ORDER BY seq LIMIT 1) n)
SELECT c.seq, p.owner, CASE WHEN c.caller IS DISTINCT FROM p.owner THEN 'NotOwner' WHEN kind = 'transfer' AND (new_owner IS NULL OR new_owner = '0x0000000000000000000000000000000000000000') THEN 'ZeroAddress' END AS reason
FROM c ASOF JOIN p ON c.seq > p.seq"""
)
def registry_owners(spark, sf_dir):
    """The owner at each call and the guards of ownership, over transfers among several owners."""
    return ownership.owners(_calls(spark, sf_dir), "owner 0")


def _calls(spark, sf_dir):
    e, k, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    named = lambda n: F.concat(F.lit("owner "), (n % 4).cast("string"))
    return e.select(
        k.alias("seq"),
        F.when((F.col("event_type") == "error") | (k % 5 == 0), ownership.TRANSFER).otherwise(ownership.INSERT).alias("kind"),
        F.when(u % 13 != 0, named(u)).alias("caller"),
        F.when(k % 11 == 0, ownership.ZERO_ADDRESS).when(k % 17 != 0, named(u + k)).alias("new_owner"),
    )


@query(
    f"""WITH batch AS ({_BATCH}), known AS ({_KNOWN}), ok AS (
  SELECT * FROM batch WHERE submitter = 'owner' AND threat_hash <> '{reg.ZERO_HASH}' AND threat_hash NOT IN (SELECT threat_hash FROM known) AND verdict BETWEEN 0 AND 1 AND confidence BETWEEN 0 AND 100
) SELECT 'ThreatSubmitted' AS event, threat_hash, 1 AS threat_type, verdict, confidence, seq AS submitted_at, submitter FROM ok QUALIFY row_number() OVER (PARTITION BY threat_hash ORDER BY seq) = 1"""
)
def registry_events(spark, sf_dir):
    """The log of accepted inserts; the row's number stands for its time."""
    return reg.events(_decided(spark, sf_dir), F.col("seq"))


@query(f"WITH registry AS ({REGISTRY}) SELECT page_id, threat_type, verdict, confidence FROM pages JOIN registry ON threat_hash = md5('url:' || {CANONICAL}) WHERE {LISTED_SQL}")
def registry_get(spark, sf_dir):
    """The records of listed pages; a page without one would fail the query."""
    rows = pages(spark, sf_dir)
    asked = rows.where(listed(F.col("url"))).select("page_id", simple_hash().alias("threat_hash"))
    return reg.get(asked, registry_of(rows)).select("page_id", "threat_type", "verdict", "confidence")


@query(
    f"""SELECT shown, count(*) AS n FROM (SELECT CASE WHEN lower(trim(label)) IN ('1', 'spam', 'malicious', 'smishing', 'phishing') THEN 'threat' WHEN lower(trim(label)) IN ('0', 'ham', 'benign', 'legitimate', 'safe') THEN 'benign' ELSE 'invalid' END AS shown
FROM (SELECT {LABEL_SQL} AS label FROM documents d LEFT JOIN labels l USING (doc_id))) GROUP BY shown"""
)
def threat_label_eval(spark, sf_dir):
    threat = reg.is_threat(F.col("label"), reg.MESSAGE)
    shown = F.when(threat.isNull(), "invalid").when(threat, "threat").otherwise("benign")
    return messages(spark, sf_dir, raw=True).groupBy(shown.alias("shown")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, label FROM (SELECT doc_id, CASE WHEN lower(trim(' ' || lang || ' ')) IN ('en', 'english') THEN 'x' END AS k, 'ham' AS label FROM documents) WHERE k = 'x'")
def english_rows(spark, sf_dir):
    """The external source's filter: language after trimming, in either case."""
    from threatquery.sources.readers import english

    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")).alias("lang"), F.col("doc_id").cast("string").alias("text"), F.lit(" HAM").alias("label"))
    return english(rows).select(F.col("text").cast("bigint").alias("doc_id"), tx.strip(F.col("label")).alias("label"))
