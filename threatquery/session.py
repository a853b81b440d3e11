"""Session construction.

A cluster supplies its own session; ``local_session`` is for tests and the
benchmark. Only settings that the library relies on are listed here.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def _with_root(paths: str | None) -> str:
    return os.pathsep.join([ROOT, *[p for p in (paths or "").split(os.pathsep) if p and p != ROOT]])


def reach_workers(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package wherever it was started.

    A cluster gets the package as any other, by --py-files or its image.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.environment["PYTHONPATH"] = _with_root(sc.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH"))


def local_session(name: str = "threatquery", cpus: int | None = None, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    reach_workers(spark)
    return spark
