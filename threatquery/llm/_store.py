"""Written tables in the folder that all executors share, and bounded samples of labelled rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; one of our own only where it is unset and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            folder = chosen.get()
        else:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="threatquery-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Bytes of a batch between the engine and Python, in each of the two and for each running task.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Batches by bytes rather than by 10,000 rows, so that memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Intermediate tables of one run. ``write`` cuts the lineage, ``drop`` frees the disk."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        """The table takes the place of ``df``, so the shuffles that made it go at once."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").options(**(options or {})).parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(tables: Tables, df: DataFrame, column: str, name: str) -> DataFrame:
    """``df``, written as ``name``, with ``column`` from 1 in the order of its partitions and of the rows within them.

    A partition's rows are numbered by themselves and shifted by the counts of
    the partitions before: a table of one row a partition, which is broadcast.
    """
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = tables.write(df.select("*", F.spark_partition_id().alias("_part"), own.alias("_own")), name)
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    number = (F.col("_before") + F.col("_own") + 1).cast("bigint").alias(column)
    return placed.join(F.broadcast(shift), "_part").select(*df.columns, number)


def remainder(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str, inputs: list[str], modulus: int, held_out: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label and ``inputs`` of at most ``per_class`` documents of each class, labelled documents of each class).

    None is of a held-out remainder. Labels of ids that no document has are
    dropped before any is counted or taken. Ids are taken in the order of a
    hash; an id with several labels counts by the largest, and one with several
    rows by the least text, so that neither multiplies the sample.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    some = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select("doc_id", F.struct(*inputs).alias("inputs")).join(some, "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("inputs").alias("inputs")).select("doc_id", "label", "inputs.*"), counts
