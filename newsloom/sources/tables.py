"""Tables at rest: Parquet snapshots with versions.

A snapshot is written to a new folder, rows added to it to a folder of their own beside it.
A folder counts once its `_SUCCESS` file is there, so a reader never sees half a table or half
an append, and a lost job leaves the old state in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.schemas import TABLES


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _finished(self, pattern: str) -> list[str]:
        """Names of the folders that fit the pattern and are complete."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}/_SUCCESS")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getParent().getName() for s in fs.globStatus(path) or []]

    def _versions(self, name: str) -> list[int]:
        return sorted(int(v[2:]) for v in self._finished(f"{name}/v=*"))

    def _added(self, name: str, version: int) -> list[int]:
        """Numbers of what was appended to a version."""
        return sorted(int(v.rpartition("-")[2]) for v in self._finished(f"{name}/add={version}-*"))

    def read(self, name: str) -> DataFrame:
        """Current snapshot and what was added to it; an empty table when nothing was written yet."""
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], TABLES[name])
        now = versions[-1]
        base = self.spark.read.parquet(f"{self.root}/{name}/v={now}")
        added = [f"{self.root}/{name}/add={now}-{n}" for n in self._added(name, now)]
        return base.unionByName(self.spark.read.schema(base.schema).parquet(*added)) if added else base

    def replace(self, name: str, df: DataFrame) -> int:
        """Write a new snapshot; the old one stays readable."""
        version = (self._versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")
        return version

    def append(self, name: str, rows: DataFrame) -> int:
        """Add rows to the current snapshot without rewriting it."""
        versions = self._versions(name)
        if not versions:
            return self.replace(name, rows)
        now = versions[-1]
        number = (self._added(name, now) or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/add={now}-{number}")
        return now
