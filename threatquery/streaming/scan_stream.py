"""The scan as a stream: URLs arrive, are scanned against a static registry, and append once each.

Also a windowed count of risks with a watermark, and idempotent registry
inserts by micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatquery.operators import ownership, registry as reg, scan as ops
from threatquery.sources.sinks import exists, numbered, remove


def scan_stream(urls: DataFrame, registry: DataFrame | None, hashed: Column | None = None, event_time: str = "ts", delay: str = "10 minutes", key: str = "url") -> DataFrame:
    """Scanned rows; an equal URL within the delay is scanned once."""
    unique = urls.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return ops.scan(unique, registry, hashed, url=key)


def risk_windows(scanned: DataFrame, event_time: str = "ts", width: str = "5 minutes") -> DataFrame:
    """Scans by window and risk; late rows beyond the watermark are left out."""
    return scanned.groupBy(F.window(event_time, width), "risk_level").agg(F.count("*").alias("n"))


def append_to(scanned: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly once into a table: the sink's log names the files of each batch."""
    return scanned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def registry_inserts(batches: DataFrame, path: str, checkpoint: str, owner: str) -> StreamingQuery:
    """Accepted rows join the registry. A batch that runs again adds nothing, as its hashes are then known."""

    def insert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(path) if exists(spark, path) else batch.limit(0).select("threat_hash", "threat_type", "verdict", "confidence")
        accepted = reg.guarded_insert(known, batch, owner).where("reason is null")
        accepted.select("threat_hash", "threat_type", "verdict", "confidence").write.mode("append").parquet(path)

    return batches.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RECORD = "batch bigint, nonce bigint, seq bigint, threat_hash string, threat_type int, verdict int, confidence int, submitter string"


def numbered_inserts(batches: DataFrame, path: str, checkpoint: str, owner: str) -> StreamingQuery:
    """Accepted rows get consecutive numbers from 0, across micro-batches, in the order of ``seq`` within a batch.

    A batch writes to a folder of its own, ``batch=<id>``, and counts on from the
    folders of earlier batches, in which it also looks for known hashes. One that
    runs again, because it broke after its write or before, writes the same rows
    with the same numbers over its folder, so there is no gap and no repeat.
    """

    def insert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = _before(spark, path, number)
        accepted = reg.guarded_insert(earlier, batch, owner).where("reason is null").drop("reason")
        next_one = earlier.agg(F.coalesce(F.max("nonce") + 1, F.lit(0))).first()[0]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        in_order = accepted.repartitionByRange(parts, "seq").sortWithinPartitions("seq")
        out = numbered(in_order, "own").select((F.col("own") + (next_one - 1)).alias("nonce"), "seq", "threat_hash", "threat_type", "verdict", "confidence", "submitter")
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return batches.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _before(spark, path: str, number: int) -> DataFrame:
    """The records of earlier batches; folders of later ones, left by a run that a checkpoint has forgotten, go."""
    if not exists(spark, path):
        return spark.createDataFrame([], RECORD)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    for x in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place):
        name = x.getPath().getName()
        if name.startswith("batch=") and int(name.removeprefix("batch=")) >= number:
            remove(spark, f"{path}/{name}")
    return spark.read.schema(RECORD).parquet(path)


def owned_inserts(calls: DataFrame, path: str, checkpoint: str, first_owner: str) -> StreamingQuery:
    """Inserts and transfers of ownership in one stream: each batch begins with the owner that the one before it left.

    Every batch writes its decisions to ``batch=<id>`` and, last, the owner at its
    end to ``owner/batch=<id>``; one that runs again begins with the owner of the
    batch before it, and so decides the same.
    """

    def decide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = f"{path}/owner"
        owner = first_owner
        if exists(spark, known):
            last = spark.read.parquet(known).where(F.col("batch") < number).orderBy(F.col("batch").desc()).first()
            owner = last.owner if last else first_owner
        decided = ownership.owners(batch, owner)
        out = batch.join(decided, "seq")
        out.write.mode("overwrite").parquet(f"{path}/decided/batch={number}")
        moved = spark.read.parquet(f"{path}/decided/batch={number}").where((F.col("kind") == ownership.TRANSFER) & F.col("reason").isNull())
        last = moved.orderBy(F.col("seq").desc()).select("new_owner").first()
        end = spark.range(1).select(F.lit(last.new_owner if last else owner).alias("owner"))
        end.write.mode("overwrite").parquet(f"{path}/owner/batch={number}")

    return calls.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
