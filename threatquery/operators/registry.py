"""The insert-only threat registry: seeding, guarded inserts, lookups, counters.

A registry is a DataFrame with threat_hash, threat_type (0 message, 1 URL),
verdict (0 benign, 1 threat) and confidence (0 to 100). Lookups are equi-joins
on the hash; the engine broadcasts the registry while it is small and sorts it
when it isn't. Seeds never carry raw content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.functions.text import strip
from threatquery.sources.sinks import materialise

MESSAGE, URL = 0, 1
#: Rows of the first range that seeding with a limit reads, for each record that it allows.
FIRST_RANGE = 16
ZERO_HASH = "0x" + "0" * 64
# Label spellings by modality. The polarity of 0 and 1 differs on purpose.
THREAT_LABELS = {MESSAGE: ["1", "spam", "malicious", "smishing", "phishing"], URL: ["0", "phishing", "malicious", "threat"]}
BENIGN_LABELS = {MESSAGE: ["0", "ham", "benign", "legitimate", "safe"], URL: ["1", "legitimate", "benign", "safe"]}
#: Reasons for which an insert is refused, in the order in which they are tried.
REASONS = ["NotOwner", "ZeroHash", "DuplicateHash", "InvalidVerdict", "ConfidenceOutOfRange"]


def is_threat(label: Column, threat_type: int, explicit: str | None = None) -> Column:
    """True, false, or null where the label is unknown."""
    key = F.lower(strip(label))
    if explicit is not None:
        return key == explicit.strip().lower()
    return F.when(key.isin(*THREAT_LABELS[threat_type]), True).when(key.isin(*BENIGN_LABELS[threat_type]), False)


def _states(rows: DataFrame, content: str, label: str, order: str, hashed: Callable[[Column], Column], threat_type: int, explicit: str | None) -> DataFrame:
    """source_row, state, threat_hash and a digest of the content of every row."""
    raw, key = strip(F.col(content)), strip(F.col(label))
    out = rows.select(F.col(order).alias("source_row"), raw.alias("raw"), key.alias("key"))
    blank = (F.coalesce(F.col("raw"), F.lit("")) == "") | (F.coalesce(F.col("key"), F.lit("")) == "")
    threat = is_threat(F.col("key"), threat_type, explicit)
    out = out.withColumn("state", F.when(blank | threat.isNull(), "invalid").when(threat, "threat").otherwise("benign"))
    out = out.withColumn("threat_hash", hashed(F.when(F.col("state") == "threat", F.col("raw"))))
    return out.select("source_row", "state", "threat_hash", F.sha2(F.col("raw").cast("binary"), 256).alias("raw_digest"))


def _firsts(out: DataFrame) -> DataFrame:
    threats = out.where("state = 'threat'")
    # The least row of a key comes from a partial aggregate and meets its row by the row's number: no key is one task.
    for flag, column in (("raw_first", "raw_digest"), ("hash_first", "threat_hash")):
        first = threats.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("source_row").alias("source_row")).select("source_row", F.lit(True).alias(flag))
        out = out.join(first, "source_row", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out


def classified(rows: DataFrame, content: str, label: str, order: str, hashed: Callable[[Column], Column], threat_type: int, explicit: str | None = None, limit: int | None = None) -> DataFrame:
    """Every row with its state in seeding (invalid, benign, threat) and whether it is the first of its content and of its hash.

    ``hashed`` gives the fingerprint of the stripped content; null where there is none.
    With a ``limit``, only as many of the first rows as hold so many different
    fingerprints: rows are read and hashed by ranges of ``order``, a whole number
    then, each twice as wide as the one before, until there are enough. A range
    reaches the scan as a filter.
    """
    # Written once, as fingerprints cost; contents go on as digests only.
    states = lambda some: materialise(_states(some, content, label, order, hashed, threat_type, explicit), "classified")
    if limit is None:
        return _firsts(states(rows))
    first, last = rows.agg(F.min(order), F.max(order)).first()
    found = states(rows.limit(0)) if first is None else None
    width = FIRST_RANGE * max(limit, 1)
    while first is not None and first <= last:
        some = states(rows.where(F.col(order).between(first, first + width - 1)))
        found = some if found is None else found.unionByName(some)
        if found.where("state = 'threat' and threat_hash is not null").select("threat_hash").distinct().limit(max(limit, 1)).count() >= max(limit, 1):
            break
        first, width = first + width, 2 * width
    return _firsts(found)


def seeds(found: DataFrame, threat_type: int, limit: int | None = None) -> DataFrame:
    """The first row of each hash as a registry record. A limit counts these; one below 1 stops at the first of them."""
    out = found.where("state = 'threat' and hash_first")
    out = out.select("threat_hash", F.lit(threat_type).alias("threat_type"), F.lit(1).alias("verdict"), F.lit(100).alias("confidence"), "source_row")
    return out.orderBy("source_row").limit(max(limit, 1)) if limit is not None else out


def export(records: DataFrame) -> DataFrame:
    """What may be shared: no source row, no content."""
    name = F.when(F.col("threat_type") == URL, "URL").otherwise("MESSAGE")
    return records.select(F.col("threat_hash").alias("threatHash"), name.alias("threatType"), F.col("threat_type").alias("threatTypeInt"), "verdict", "confidence")


def statistics(found: DataFrame, threat_type: int, limit: int | None = None) -> DataFrame:
    """The counters of seeding. A threat that repeats a content counts as raw and as canonical duplicate.

    With a limit seeding stops at the row of the last record that it allows,
    and only rows up to that one count.
    """
    if limit is not None:
        last = seeds(found, threat_type, limit).agg(F.count("*").alias("n_seeds"), F.max("source_row").alias("last_row"))  # one row
        reached = (F.col("n_seeds") < max(limit, 1)) | (F.col("source_row") <= F.col("last_row"))
        found = found.crossJoin(F.broadcast(last)).where(reached)
    threat = F.col("state") == "threat"
    hashed = threat & F.col("threat_hash").isNotNull()
    unique = hashed & F.col("hash_first")
    return found.agg(
        F.count("*").alias("total_records"),
        F.count_if((F.col("state") == "invalid") | (threat & F.col("threat_hash").isNull())).alias("invalid_records"),
        F.count_if(F.col("state") == "benign").alias("benign_records"),
        F.count_if(threat).alias("threat_records"),
        F.count_if(threat & ~F.col("raw_first")).alias("raw_duplicate_records"),
        F.count_if(hashed & ~F.col("hash_first")).alias("canonical_duplicate_records"),
        F.count_if(unique).alias("unique_threat_hashes"),
        F.count_if(unique & F.lit(threat_type == URL)).alias("url_threats"),
        F.count_if(unique & F.lit(threat_type == MESSAGE)).alias("message_threats"),
    )


def _within(column: str, least: int, most: int) -> Column:
    return F.coalesce(F.col(column).between(least, most), F.lit(False))


def guarded_insert(registry: DataFrame, batch: DataFrame, owner: str | Column, order: str = "seq") -> DataFrame:
    """``batch`` with reason: null where accepted, else the first guard that refuses the row.

    ``owner``: an address, or a column of ``row``, the struct of the batch's
    columns. A null submitter is not the owner, a null hash counts as the zero hash, and
    a null verdict or confidence is out of its range. Columns of any name pass
    through; one called reason is replaced.
    """
    known = registry.select("threat_hash", F.lit(True).alias("known")).distinct()
    out = batch.select("threat_hash", F.struct(*[F.col(f"`{c}`") for c in batch.columns]).alias("row")).join(known, "threat_hash", "left")
    static = (
        F.when(~F.col("row.submitter").eqNullSafe(owner), "NotOwner")
        .when(F.col("threat_hash").isNull() | (F.col("threat_hash") == ZERO_HASH), "ZeroHash")
        .when(F.col("known"), "DuplicateHash")
        .when(~_within("row.verdict", 0, 1), "InvalidVerdict")
        .when(~_within("row.confidence", 0, 100), "ConfidenceOutOfRange")
    )
    out = out.select("threat_hash", "row", F.col(f"row.`{order}`").alias("place"), static.alias("static"))
    # Of the rows that pass, the first of a hash makes the later ones duplicates, even those that other guards would refuse.
    first = out.where(F.col("static").isNull()).groupBy("threat_hash").agg(F.min("place").alias("first"))
    out = out.join(first, "threat_hash", "left")
    late = F.coalesce(F.col("place") > F.col("first"), F.lit(False)) & (F.col("static").isNull() | F.col("static").isin("InvalidVerdict", "ConfidenceOutOfRange"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in batch.columns if c != "reason"]
    return out.select(*kept, F.when(late, "DuplicateHash").otherwise(F.col("static")).alias("reason"))


def lookup(rows: DataFrame, registry: DataFrame, on: str = "threat_hash") -> DataFrame:
    """Rows with found, and the record's fields where it is.

    A row stays one row: of a hash that the registry repeats, the least record
    by (threat_type, verdict, confidence) counts. A null hash is never found.
    """
    fields = ("threat_type", "verdict", "confidence")
    record = registry.groupBy("threat_hash").agg(F.min(F.struct(*fields)).alias("record"))
    record = record.select(F.col("threat_hash").alias(on), F.lit(True).alias("found"), *[f"record.{c}" for c in fields])
    return rows.join(record, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def get(rows: DataFrame, registry: DataFrame, on: str = "threat_hash") -> DataFrame:
    """Rows with the record of their hash; a hash that isn't registered fails the query."""
    found = lookup(rows, registry, on)
    unknown = F.raise_error(F.concat(F.lit("ThreatNotFound: "), F.coalesce(F.col(on), F.lit("null")))).cast("boolean")
    return found.where(F.when(F.col("found"), True).otherwise(unknown)).drop("found")


def events(decided: DataFrame, submitted_at: Column) -> DataFrame:
    """The log of accepted inserts, one ThreatSubmitted each. ``decided``: as of ``guarded_insert``, with the fields of the record."""
    accepted = decided.where(F.col("reason").isNull())
    return accepted.select(F.lit("ThreatSubmitted").alias("event"), "threat_hash", "threat_type", "verdict", "confidence", submitted_at.alias("submitted_at"), "submitter")


def missing(rows: DataFrame, registry: DataFrame, on: str = "threat_hash") -> DataFrame:
    """Rows whose hash isn't registered yet."""
    return rows.join(registry.select(F.col("threat_hash").alias(on)), on, "left_anti")


def counters(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("total"), F.count_if(F.col("threat_type") == MESSAGE).alias("messages"), F.count_if(F.col("threat_type") == URL).alias("urls"))


def status(available: Column, found: Column) -> Column:
    """What a page shows: null where the flag is absent."""
    return F.when(available.isNull(), None).when(~available, "unavailable").when(found, "found").otherwise("clear")
