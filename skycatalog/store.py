"""Snapshots of catalog tables: each commit writes a new version and then moves one pointer file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current.json"


class SnapshotStore:
    """Tables below `root` on any file system that Spark's Hadoop client knows.

    Readers see the version that the pointer names; a commit that fails leaves it as it was.  One writer at a time.  (K19)
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read_text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def current(self) -> dict[str, str]:
        """Folder of the current version of each table."""
        text = self._read_text(f"{self.root}/{POINTER}")
        return json.loads(text) if text else {}

    def read(self, table: str) -> DataFrame:
        at = self.current()
        if table not in at:
            raise KeyError(table)
        return self.spark.read.parquet(at[table])

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Writes all tables, then moves the pointer once: all of them become visible together or none."""
        version = uuid.uuid4().hex
        at = self.current()
        for name, df in tables.items():
            path = f"{self.root}/{name}/v={version}"
            df.write.mode("errorifexists").parquet(path)
            at[name] = path
        fs, tmp = self._fs(f"{self.root}/_next-{version}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(at).encode()))
        out.close()
        _, pointer = self._fs(f"{self.root}/{POINTER}")
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(tmp, pointer, overwrite)
