from pyspark.sql import functions as F

from threatquery.operators import registry as reg
from threatquery.streaming import scan_stream as stream


def test_scan_stream(spark, tmp_path):
    rows = [("http://a.example/login", "2024-01-01 00:00:00"), ("http://a.example/login", "2024-01-01 00:01:00"), ("https://b.example/", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "url string, t string").select("url", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    urls = spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in"))
    scanned = stream.scan_stream(urls, None)
    stream.append_to(scanned, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    got = {r.url: r.risk_level for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"http://a.example/login": "MEDIUM", "https://b.example/": "SAFE"}


def test_registry_inserts_are_idempotent(spark, tmp_path):
    schema = "seq int, threat_hash string, threat_type int, verdict int, confidence int, submitter string"
    spark.createDataFrame([(1, "a", 1, 1, 5, "me"), (2, "a", 1, 1, 5, "me"), (3, reg.ZERO_HASH, 1, 1, 5, "me"), (4, "b", 1, 1, 5, "me")], schema).write.parquet(str(tmp_path / "in"))
    for k in range(2):  # a second run from scratch sees the same rows again
        batches = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.registry_inserts(batches, str(tmp_path / "reg"), str(tmp_path / f"c{k}"), "me").awaitTermination()
    assert sorted(r.threat_hash for r in spark.read.parquet(str(tmp_path / "reg")).collect()) == ["a", "b"]


def test_risk_windows(spark):
    rows = [("2024-01-01 00:01:00", "HIGH"), ("2024-01-01 00:04:59", "HIGH"), ("2024-01-01 00:05:00", "HIGH"), ("2024-01-01 00:02:00", "SAFE")]
    df = spark.createDataFrame(rows, "t string, risk_level string").select(F.to_timestamp("t").alias("ts"), "risk_level")
    assert sorted((r.window.start.minute, r.risk_level, r.n) for r in stream.risk_windows(df).collect()) == [(0, "HIGH", 2), (0, "SAFE", 1), (5, "HIGH", 1)]
