"""Writers, and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; one of our own only where it is unset and the session is local."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="threatquery-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Tables of ``materialise`` that are still there, by application.
_WRITTEN: dict[str, list[str]] = {}


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a written table: its lineage ends there, and it stays the same however often it is read.

    The result of an operator may read it later, so it stays until ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in the shared folder, all of which go at its end: for work whose result doesn't read them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(spark: SparkSession) -> int:
    """Delete all tables that ``materialise`` has written in this application; results that read them must be done with. Says how many."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name`` from 1, in the order of its partitions and of the rows within them.

    A partition's rows are numbered by themselves and shifted by the counts of
    the partitions before, a table of one row each that is broadcast, so that
    the rows aren't shuffled for it. The rows are written first, as a second run could cut partitions elsewhere. Columns of
    any name pass through; one called ``name`` is replaced.
    """
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.spark_partition_id().alias("part"), own.alias("own")), "numbered")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c != name]
    return placed.join(F.broadcast(shift), "part").select(*kept, (F.col("before") + F.col("own") + 1).cast("bigint").alias(name))


def cumulated(rows: DataFrame, keys: list[str], order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """``rows`` with ``<c>_to`` for each of ``sums``: its total over the rows of the same keys up to this one.

    Rows are cut into ranges of about equal size by (keys, order), whatever the
    values are; sums run within a range and are shifted by the totals of the
    ranges before, of which there is one row a range. ``order`` is distinct
    within the keys.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col(order).desc() if descending else F.col(order)
    placed = materialise(rows.repartitionByRange(parts, *keys, by).withColumn("part", F.spark_partition_id()), "cumulated")
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "part").agg(*[F.sum(c).alias(f"{c}_in") for c in sums])
    totals = totals.select(*[F.col(k).alias(f"{k}_key") for k in keys], F.col("part").alias("part_key"), *[F.coalesce(F.sum(f"{c}_in").over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums])
    own = Window.partitionBy(*keys, "part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("part") == F.col("part_key")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_key"))
    out = placed.withColumns({f"{c}_own": F.sum(c).over(own) for c in sums}).join(totals, same)
    return out.select(*rows.columns, *[(F.col(f"{c}_own") + F.col(f"{c}_before")).alias(f"{c}_to") for c in sums])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_or_replace(df: DataFrame, path: str) -> str:
    """Append where names and types of the columns agree with those on disk, else overwrite; says which."""
    spark = df.sparkSession
    mode = "overwrite"
    if exists(spark, path) and spark.read.parquet(path).dtypes == df.dtypes:
        mode = "append"
    df.write.mode(mode).parquet(path)
    return mode


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_scans(df: DataFrame, path: str) -> None:
    """Scans with an id that no other writer gives."""
    df.withColumn("id", F.expr("uuid()")).write.mode("append").parquet(path)


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows replace stored ones of the same key."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True).orderBy(key)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a path that ``df`` may read from: the rows are written aside first."""
    materialise(df, "upsert").write.mode("overwrite").parquet(path)


def markdown(df: DataFrame) -> str:
    """A small result as a table."""
    rows = [df.columns, ["---"] * len(df.columns), *[[str(x) for x in r] for r in df.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
