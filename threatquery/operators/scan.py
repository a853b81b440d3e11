"""The URL risk scan: components, findings, registry lookup, risk, response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.functions import urls
from threatquery.operators import registry as reg

RESPONSE = ["url", "status", "message", "protocol", "domain", "path", "https", "uses_ip", "risk_level", "findings", "blockchain_available", "blockchain_found"]


def scan(rows: DataFrame, registry: DataFrame | None, hashed: Column | None = None, url: str = "url") -> DataFrame:
    """``rows`` with the twelve fields of the response; columns of these names are replaced, all others pass through.

    Without a registry the scan goes on and says that it isn't available. A URL
    that can't be scanned gives an error row of unknown risk, and no failure.
    """
    hashed = hashed if hashed is not None else urls_hash(url)
    others = [c for c in rows.columns if c not in RESPONSE]
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row") if others else F.lit(None).alias("row"), F.col(url).alias("_url"), hashed.alias("_hash"))
    out = rows.withColumns({"_ok": urls.admissible(F.col("_url")), **urls.components(F.col("_url"))})
    if registry is None:
        out = out.withColumns({"_available": F.lit(False), "found": F.lit(False), "verdict": F.lit(None).cast("int")})
    else:
        out = reg.lookup(out, registry, "_hash").withColumn("_available", F.lit(True))
    listed = F.coalesce(F.col("_available") & F.col("found") & (F.col("verdict") == 1), F.lit(False))
    base = urls.findings(F.col("_url"), F.col("protocol"), F.col("domain"))
    found = F.when(listed, F.concat(base, F.array(F.lit(urls.FINDING_REGISTRY)))).otherwise(base)
    out = out.withColumn("_findings", F.when(F.col("_ok"), found).otherwise(F.array().cast("array<string>")))
    ok = F.col("_ok")
    response = {
        "url": F.col("_url"),
        "status": F.when(ok, "processed").otherwise("error"),
        "message": F.when(ok, "URL processed successfully").otherwise("An error occurred while processing the URL"),
        "protocol": F.when(ok, F.col("protocol")).otherwise(""),
        "domain": F.when(ok, F.col("domain")).otherwise(""),
        "path": F.when(ok, F.col("path")).otherwise(""),
        "https": ok & (F.col("protocol") == "https"),
        "uses_ip": ok & urls.is_ip(F.col("domain")),
        "risk_level": F.when(ok, urls.risk(F.col("_findings"))).otherwise("UNKNOWN"),
        "findings": F.col("_findings"),
        "blockchain_available": ok & F.col("_available"),
        "blockchain_found": ok & F.col("_available") & F.col("found"),
    }
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in others], *[c.alias(n) for n, c in response.items()])


def urls_hash(url: str) -> Column:
    from threatquery.functions.hashing import url_fingerprint

    return url_fingerprint(F.col(url))


def history(rows: DataFrame, order: str) -> DataFrame:
    """Scans as they are kept: findings as JSON text, without the registry's flags; newest first."""
    kept = rows.select(F.col(order).alias("id"), *[c for c in RESPONSE[:9]], F.to_json("findings").alias("findings"))
    return kept.orderBy(F.col("id").desc())


def read_history(stored: DataFrame) -> DataFrame:
    return stored.withColumn("findings", F.from_json("findings", "array<string>"))


def display_risk(level: Column) -> Column:
    name = F.upper(level)
    return F.when(name.isin("SAFE", "MEDIUM", "HIGH"), name).otherwise("UNKNOWN")
