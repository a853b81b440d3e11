"""URL and scan queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.functions import hashing, lexicons as lex, urls
from threatquery.functions.text import strip
from threatquery.operators import registry as reg, scan as ops
from threatquery.plans.catalogue import literal, query, table

#: Host words of the supplied pages that stand for confirmed threats.
LISTED = ["spam", "free", "pills"]

SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
DOMAIN = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH = "regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
HOST = f"regexp_replace(lower(regexp_replace(regexp_replace({DOMAIN}, '^.*@', ''), ':.*$', '')), '\\.+$', '')"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = f"regexp_full_match({DOMAIN}, '({OCTET}\\.){{3}}{OCTET}')"
QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
CANONICAL = f"""{SCHEME} || '://' || {HOST} || CASE WHEN regexp_extract({DOMAIN}, ':([0-9]+)$', 1) = ''
  OR ({SCHEME} = 'http' AND regexp_extract({DOMAIN}, ':([0-9]+)$', 1) = '80') OR ({SCHEME} = 'https' AND regexp_extract({DOMAIN}, ':([0-9]+)$', 1) = '443')
  THEN '' ELSE ':' || regexp_extract({DOMAIN}, ':([0-9]+)$', 1) END || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END
  || CASE WHEN {QUERY} = '' THEN '' ELSE '?' || array_to_string(list_sort([x for x in string_split({QUERY}, '&') if x <> '']), '&') END
  || CASE WHEN regexp_extract(url, '#(.*)$', 1) = '' THEN '' ELSE '#' || regexp_extract(url, '#(.*)$', 1) END"""
LISTED_SQL = f"regexp_matches({HOST}, '{lex.alternation(LISTED)}')"
_TESTS = [f"CASE WHEN {SCHEME} <> 'https' THEN {literal(urls.FINDING_HTTPS)} END", f"CASE WHEN {IP} THEN {literal(urls.FINDING_IP)} END"]
_TESTS += [f"CASE WHEN contains(url, {literal(c)}) THEN {literal(urls.FINDING_CHARACTER + c)} END" for c in lex.SCAN_CHARACTERS]
_TESTS += [f"CASE WHEN contains(lower(url), {literal(w)}) THEN {literal(urls.FINDING_KEYWORD + w)} END" for w in lex.SCAN_KEYWORDS]
BASE = f"[x for x in [{', '.join(_TESTS)}] if x IS NOT NULL]"
REGISTRY = f"SELECT DISTINCT md5('url:' || {CANONICAL}) AS threat_hash, 1 AS threat_type, 1 AS verdict, 100 AS confidence FROM pages WHERE {LISTED_SQL}"
SCANNED = f"""WITH registry AS ({REGISTRY}), parts AS (
  SELECT page_id, url, {SCHEME} AS protocol, {DOMAIN} AS domain, {PATH} AS path, {IP} AS uses_ip, {BASE} AS base, md5('url:' || {CANONICAL}) AS h FROM pages
), scanned AS (
  SELECT p.*, r.threat_hash IS NOT NULL AS hit,
    CASE WHEN r.verdict = 1 THEN list_append(base, {literal(urls.FINDING_REGISTRY)}) ELSE base END AS findings
  FROM parts p LEFT JOIN registry r ON p.h = r.threat_hash
), response AS (
  SELECT page_id, url, 'processed' AS status, 'URL processed successfully' AS message, protocol, domain, path, protocol = 'https' AS https, uses_ip,
    CASE WHEN len(findings) = 0 THEN 'SAFE' WHEN len(findings) <= 2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
    findings, true AS blockchain_available, hit AS blockchain_found
  FROM scanned
)"""


def pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages")


def listed(url: Column) -> Column:
    return urls.hostname(urls.components(url)["domain"]).rlike(lex.alternation(LISTED))


def simple_hash(url: Column | None = None) -> Column:
    """The SQL-expressible stand-in for the fingerprint."""
    return F.md5(F.concat(F.lit("url:"), urls.canonical_simple(F.col("url") if url is None else url)).cast("binary"))


def registry_of(rows: DataFrame) -> DataFrame:
    found = rows.where(listed(F.col("url"))).select(simple_hash().alias("threat_hash")).distinct()
    return found.select("threat_hash", F.lit(reg.URL).alias("threat_type"), F.lit(1).alias("verdict"), F.lit(100).alias("confidence"))


def scanned(spark, sf_dir) -> DataFrame:
    rows = pages(spark, sf_dir)
    return ops.scan(rows.select("page_id", "url"), registry_of(rows), simple_hash())


@query(f"{SCANNED} SELECT page_id, url, status, message, protocol, domain, path, https, uses_ip, risk_level, array_to_string(findings, '|') AS findings, blockchain_available, blockchain_found FROM response")
def scan_flagship(spark, sf_dir):
    return scanned(spark, sf_dir).withColumn("findings", F.array_join("findings", "|"))


@query(f"{SCANNED} SELECT risk_level, count(*) AS n, count_if(https) AS n_https, count_if(blockchain_found) AS n_listed FROM response GROUP BY risk_level")
def scan_risk_by_level(spark, sf_dir):
    return scanned(spark, sf_dir).groupBy("risk_level").agg(F.count("*").alias("n"), F.count_if("https").alias("n_https"), F.count_if("blockchain_found").alias("n_listed"))


@query(f"{SCANNED} SELECT finding, count(*) AS n FROM (SELECT unnest(findings) AS finding FROM response) GROUP BY finding")
def scan_findings_exploded(spark, sf_dir):
    return scanned(spark, sf_dir).select(F.explode("findings").alias("finding")).groupBy("finding").agg(F.count("*").alias("n"))


@query(f"WITH registry AS ({REGISTRY}) SELECT page_id, threat_type, verdict, confidence FROM pages JOIN registry ON threat_hash = md5('url:' || {CANONICAL})")
def scan_registry_hits(spark, sf_dir):
    rows = pages(spark, sf_dir)
    return reg.lookup(rows.select("page_id", simple_hash().alias("threat_hash")), registry_of(rows)).where("found").select("page_id", "threat_type", "verdict", "confidence")


@query(f"WITH registry AS ({REGISTRY}) SELECT page_id FROM pages WHERE md5('url:' || {CANONICAL}) IN (SELECT threat_hash FROM registry)")
def registry_exists(spark, sf_dir):
    rows = pages(spark, sf_dir)
    return rows.select("page_id", simple_hash().alias("threat_hash")).join(registry_of(rows), "threat_hash", "left_semi").select("page_id")


@query(f"{SCANNED} SELECT page_id AS id, url, risk_level, to_json(findings)::VARCHAR AS findings, (SELECT count(*) FROM response) AS history_size FROM response")
def scan_history_newest(spark, sf_dir):
    rows = ops.history(scanned(spark, sf_dir), "page_id")
    size = pages(spark, sf_dir).agg(F.count("*").alias("history_size"))  # one row; a scan gives a row for each URL
    return rows.select("id", "url", "risk_level", "findings").crossJoin(F.broadcast(size))


@query(f"{SCANNED} SELECT page_id, len(findings)::INT AS n_findings, findings[1] AS first_finding FROM response")
def scan_history_decoded(spark, sf_dir):
    stored = ops.history(scanned(spark, sf_dir), "page_id")
    return ops.read_history(stored).select(F.col("id").alias("page_id"), F.size("findings").alias("n_findings"), F.try_element_at("findings", F.lit(1)).alias("first_finding"))


@query(
    f"""{SCANNED}, flags AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id % 4 <> 1 END AS available, blockchain_found AS found FROM response)
SELECT page_id, CASE WHEN available IS NULL THEN NULL WHEN NOT available THEN 'unavailable' WHEN found THEN 'found' ELSE 'clear' END AS status FROM flags"""
)
def registry_status(spark, sf_dir):
    k = F.col("page_id") % 4
    available = F.when(k == 0, None).otherwise(k != 1)
    return scanned(spark, sf_dir).select("page_id", reg.status(available, F.col("blockchain_found")).alias("status"))


@query(
    f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, '://', ':/') ELSE url END AS url FROM pages)
SELECT page_id, CASE WHEN {DOMAIN} = '' THEN 'error' ELSE 'processed' END AS status,
  CASE WHEN {DOMAIN} = '' THEN 'UNKNOWN' WHEN len({BASE}) = 0 THEN 'SAFE' WHEN len({BASE}) <= 2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
  CASE WHEN {DOMAIN} = '' THEN 0 ELSE len({BASE}) END::INT AS n_findings, false AS blockchain_available, false AS blockchain_found FROM p"""
)
def scan_fail_open(spark, sf_dir):
    broken = F.when(F.col("page_id") % 5 == 0, F.replace("url", F.lit("://"), F.lit(":/"))).otherwise(F.col("url"))
    out = ops.scan(pages(spark, sf_dir).select("page_id", broken.alias("url")), None)
    return out.select("page_id", "status", "risk_level", F.size("findings").alias("n_findings"), "blockchain_available", "blockchain_found")


@query(f"SELECT page_id, {SCHEME} AS protocol, {DOMAIN} AS domain, {PATH} AS path FROM pages")
def url_components(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", *[c.alias(n) for n, c in urls.components(F.col("url")).items()])


@query("SELECT page_id, url AS stripped, length(url) AS size FROM pages")
def url_strip(spark, sf_dir):
    padded = F.concat(F.lit("  \t"), F.col("url"), F.lit("\n  "))
    return pages(spark, sf_dir).select("page_id", strip(padded).alias("stripped")).withColumn("size", F.length("stripped").cast("bigint"))


@query(f"SELECT page_id, len([s for s in string_split({PATH}, '/') if s <> ''])::INT AS depth FROM pages")
def url_depth(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.depth(urls.components(F.col("url"), prefix=True)["path"]).alias("depth"))


_ALT = lambda words: lex.alternation(words).replace("\\", "\\")
_DATA_HOSTS = ["example.org", "example.net"]


@query(f"SELECT page_id, regexp_matches({HOST}, '(^|\\.)({_ALT(lex.URL_SHORTENERS)})$')::INT AS listed, regexp_matches({HOST}, '(^|\\.)({_ALT(_DATA_HOSTS)})$')::INT AS by_data_list FROM pages")
def url_shortener(spark, sf_dir):
    host = urls.hostname(urls.components(F.col("url"), prefix=True)["domain"])
    return pages(spark, sf_dir).select("page_id", urls.is_shortener(host).alias("listed"), urls.is_shortener(host, _DATA_HOSTS).alias("by_data_list"))


def _keyword_sql(words):
    return f"regexp_matches(lower(url), '(^|[^a-z])({_ALT(words)})([^a-z]|$)')::INT"


@query(f"SELECT page_id, {_keyword_sql(lex.URL_KEYWORDS)} AS listed, {_keyword_sql(['blog', 'free', 'spam'])} AS by_data_list FROM pages")
def url_suspicious_keyword(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.has_keyword(F.col("url")).alias("listed"), urls.has_keyword(F.col("url"), ["blog", "free", "spam"]).alias("by_data_list"))


@query(
    f"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '10.0.' || page_id % 300 || '.1' WHEN 1 THEN '10.0.0.1:8080' ELSE 'a.example.org' END AS d FROM pages)
SELECT page_id, regexp_full_match(d, '({OCTET}\\.){{3}}{OCTET}') AS uses_ip FROM p"""
)
def url_ip_host(spark, sf_dir):
    k = F.col("page_id") % 3
    made = F.when(k == 0, F.concat(F.lit("http://10.0."), (F.col("page_id") % 300).cast("string"), F.lit(".1/x"))).when(k == 1, "http://10.0.0.1:8080/x").otherwise("http://a.example.org/x")
    return pages(spark, sf_dir).select("page_id", urls.is_ip(urls.components(made)["domain"]).alias("uses_ip"))


def _lexical_sql():
    count = lambda p: f"len(regexp_extract_all(url, '{p}'))"
    share = lambda n: f"round({n} / length(url), 6)"
    hidden, letters, digits, other = count("%[0-9A-Fa-f]{2}"), count("[A-Za-z]"), count("[0-9]"), count("[^A-Za-z0-9=?&]")
    labels = f"string_split({HOST}, '.')"
    exprs = {
        "URLLength": "length(url)", "DomainLength": f"length({HOST})", "IsDomainIP": f"{IP}::INT", "TLDLength": f"length({labels}[-1])",
        "NoOfSubDomain": f"greatest(len({labels}) - 2, 0)", "HasObfuscation": f"({hidden} > 0)::INT", "NoOfObfuscatedChar": hidden, "ObfuscationRatio": share(hidden),
        "NoOfLettersInURL": letters, "LetterRatioInURL": share(letters), "NoOfDegitsInURL": digits, "DegitRatioInURL": share(digits),
        "NoOfEqualsInURL": count("="), "NoOfQMarkInURL": count("\\?"), "NoOfAmpersandInURL": count("&"), "NoOfOtherSpecialCharsInURL": other, "SpacialCharRatioInURL": share(other),
        "IsHTTPS": f"({SCHEME} = 'https')::INT", "IsURLShortener": f"regexp_matches({HOST}, '(^|\\.)({_ALT(lex.URL_SHORTENERS)})$')::INT",
        "URLDepth": f"len([s for s in string_split({PATH}, '/') if s <> ''])", "HasSuspiciousKeyword": _keyword_sql(lex.URL_KEYWORDS),
    }
    return "SELECT page_id, " + ", ".join(f'{e} AS "{n}"' for n, e in exprs.items()) + " FROM pages"


@query(_lexical_sql())
def url_lexical_features(spark, sf_dir):
    made = urls.lexical(F.col("url"))
    return pages(spark, sf_dir).select("page_id", *[(F.round(c, 6) if "Ratio" in n else c).alias(n) for n, c in made.items()])


@query(f"SELECT page_id, {CANONICAL} AS canonical FROM pages")
def url_canonical_simple(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.canonical_simple(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {CANONICAL} AS canonical FROM pages")
def url_canonical(spark, sf_dir):
    """The full form agrees with the simple one on URLs without escapes."""
    return pages(spark, sf_dir).select("page_id", hashing.canonical_url_column(F.col("url")).alias("canonical"))


@query()
def url_fingerprint(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", hashing.url_fingerprint(F.col("url")).alias("threat_hash"))


@query(f"SELECT page_id, {SCHEME} IN ('http', 'https') AND {HOST} <> '' AS admissible FROM (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'ftp' || url ELSE url END AS url FROM pages)")
def url_admissible(spark, sf_dir):
    made = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("ftp"), F.col("url"))).otherwise(F.col("url"))
    return pages(spark, sf_dir).select("page_id", urls.admissible(made).alias("admissible"))


@query(f"{SCANNED} SELECT CASE WHEN page_id % 7 = 0 THEN 'UNKNOWN' ELSE risk_level END AS shown, count(*) AS n FROM response GROUP BY 1")
def risk_display(spark, sf_dir):
    raw = F.when(F.col("page_id") % 7 == 0, "odd").otherwise(F.lower("risk_level"))
    return scanned(spark, sf_dir).groupBy(ops.display_risk(raw).alias("shown")).agg(F.count("*").alias("n"))
