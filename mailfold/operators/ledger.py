"""What has been written: a ledger of committed outputs, and tables published by version.

An entry is one small row under ``folder/batch=B/name=N``, written after the output that
it names; an output without its entry was never written, as far as any reader is
concerned.  Running a job again writes what has no entry and leaves the rest as it is.

``Versions`` is a table replaced as a whole: each version goes to a folder of its own and
the entry written last is the pointer.  A reader holds the folder that the newest entry
names, so it sees the old version or the new one, never a mixture, also when the writer is
lost half way.  One writer at a time; older versions stay for readers that hold them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

ENTRY = "n long, path string"


class Ledger:
    """Entries (batch, name) -> (n, path).  Names are letters, digits, ``-`` and ``_``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        # an entry of no batch, so that the folder can be read before the first one
        self._write(-1, "none", 0, "", "ignore")

    def _write(self, batch: int, name: str, n: int, path: str, mode: str) -> None:
        (self.spark.createDataFrame([(n, path)], ENTRY).coalesce(1)
         .write.mode(mode).parquet(f"{self.folder}/batch={batch}/name={name}"))

    def record(self, batch: int, name: str, n: int, path: str) -> None:
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a name for a ledger: {name!r}")
        self._write(batch, name, n, path, "overwrite")

    def entries(self) -> DataFrame:
        """(batch, name, n, path) of everything committed."""
        rows = self.spark.read.schema(f"{ENTRY}, batch long, name string").parquet(self.folder)
        return rows.where(F.col("batch") >= 0).select("batch", "name", "n", "path")

    def of(self, batch: int) -> dict[str, Row]:
        """The entries of one batch, by name."""
        return {r.name: r for r in self.entries().where(F.col("batch") == batch).collect()}     # one row per sink

    def newest(self, name: str) -> Row | None:
        rows = self.entries().where(F.col("name") == name)
        return rows.orderBy(F.col("batch").desc()).first()


class Versions:
    """A table that is published whole, version 0, 1, 2 ..."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, partition: str | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema, self.partition = schema, partition
        self.pointers = Ledger(spark, f"{self.folder}-pointers")

    def publish(self, rows: DataFrame) -> int:
        """Write ``rows`` and switch the readers to them; returns the version."""
        before = self.pointers.newest("table")
        version = before.batch + 1 if before else 0
        path = f"{self.folder}/run-{uuid.uuid4().hex[:12]}"
        writer = rows.select(*self.schema.fieldNames()).write
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(path)
        self.pointers.record(version, "table", self._read(path).count(), path)
        return version

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path).select(*self.schema.fieldNames())

    def current(self) -> DataFrame:
        """The newest version; empty before the first one."""
        newest = self.pointers.newest("table")
        return self._read(newest.path) if newest else self.spark.createDataFrame([], self.schema)

    def version(self) -> int | None:
        newest = self.pointers.newest("table")
        return newest.batch if newest else None
