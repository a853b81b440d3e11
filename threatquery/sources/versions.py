"""Tables whose contents are replaced as a whole: versions, and a log that says which of them holds.

``<path>/_log/<n>`` names the folder of version n. A version is written first,
and its log entry is created last, in one step that fails if another writer has
created it, so a reader finds the old rows or the new ones, whatever breaks in
between. The version before the last stays for those who still read it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from threatquery.sources.sinks import remove, upsert


class Versioned:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        log = self._path(f"{self.path}/_log")
        if not self._fs.exists(log):
            return []
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(log) if x.getPath().getName().isdigit())

    def _folder(self, version: int) -> str:
        held = self._fs.open(self._path(f"{self.path}/_log/{version:020d}"))
        try:
            return f"{self.path}/{held.readUTF()}"
        finally:
            held.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of the last version, or of one before it; None where there is none."""
        found = self.versions()
        if not found:
            return None
        return self.spark.read.parquet(self._folder(found[-1] if version is None else version))

    def _write(self, df: DataFrame) -> str:
        name = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, name: str, version: int) -> int:
        """Fails, and leaves the table as it is, where another writer was first."""
        entry = self._fs.create(self._path(f"{self.path}/_log/{version:020d}"), False)
        try:
            entry.writeUTF(name)
        finally:
            entry.close()
        return version

    def replace(self, df: DataFrame) -> int:
        """``df``, which may read the table, becomes the next version; its number."""
        found = self.versions()
        version = self._commit(self._write(df), found[-1] + 1 if found else 0)
        for old in found[:-1]:
            remove(self.spark, self._folder(old))
            remove(self.spark, f"{self.path}/_log/{old:020d}")
        return version

    def append_or_replace(self, df: DataFrame) -> str:
        """Old and new rows where names and types of the columns agree, else the new ones alone; says which."""
        old = self.read()
        if old is not None and old.dtypes == df.dtypes:
            self.replace(old.unionByName(df))
            return "append"
        self.replace(df)
        return "overwrite"

    def upsert(self, fresh: DataFrame, key: str) -> int:
        """Fresh rows replace stored ones of the same key."""
        old = self.read()
        return self.replace(fresh.orderBy(key) if old is None else upsert(old, fresh, key))
