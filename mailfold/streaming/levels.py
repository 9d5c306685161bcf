"""A table that grows by one run per micro-batch and is merged by levels.

Batch N writes its rows as the run ``<folder>/batch=N``.  When a level holds
``fanout`` runs they are merged into one run of the next level, so after N batches a
reader opens at most ``fanout`` runs for each of about ``log N`` levels.  What to read
is said by a *manifest*, written last: version N lists the runs after batch N.

Nothing is changed in place: a crash before the manifest is written leaves the earlier
version, whose runs are all still there, and the batch is replayed against that version
with the same result.  The manifest keeps its last ``SLOTS`` versions, each one small
file, so a replayed batch finds the version before its own and listing stays short.

``partition`` names a column of few values by which the runs are laid out; a reader that
filters on it opens only the matching files.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FANOUT = 8
SLOTS = 4
MANIFEST = "version long, level int, lo long, hi long, path string, note long"


class Levels:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType,
                 merge: Callable[[DataFrame], DataFrame] | None = None, partition: str | None = None,
                 fanout: int = FANOUT):
        """``merge`` maps the rows of several runs to those of one (default: as they are)."""
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.merge, self.partition, self.fanout = merge or (lambda rows: rows), partition, fanout

    # -- manifest -------------------------------------------------------------
    def _slot(self, version: int) -> str:
        return f"{self.folder}_manifest/slot={version % SLOTS}"

    def _commit(self, version: int, runs, note: int, mode: str = "overwrite") -> None:
        rows = [(version, -1, 0, 0, "", note), *((version, *run, note) for run in runs)]
        (self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode(mode).parquet(self._slot(version)))

    def create(self, first: DataFrame | None = None, note: int = 0) -> None:
        """Begin the table with the run of batch -1, unless it is there; ``note`` is kept with it."""
        if first is not None:
            self._write(first, self._run(-1), "ignore")
        self._commit(-1, [(0, -1, -1, self._run(-1))] if first is not None else [], note, "ignore")

    def _versions(self, before: int | None):
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}_manifest").drop("slot")
        rows = rows.collect()                       # SLOTS versions of a few runs a level
        versions = {r.version for r in rows if before is None or r.version < before}
        if not versions:
            raise ValueError(f"{self.folder}: no manifest before batch {before}")
        return [r for r in rows if r.version == max(versions)]

    def note(self) -> int:
        return self._versions(None)[0].note

    def runs(self, before: int | None = None) -> list[tuple[int, int, int, str]]:
        """(level, first batch, last batch, path) of the runs to read, as of the batch before ``before``."""
        return [(r.level, r.lo, r.hi, r.path) for r in self._versions(before) if r.level >= 0]

    # -- rows -----------------------------------------------------------------
    def _run(self, batch: int) -> str:
        return f"{self.folder}/batch={batch}"

    def _write(self, rows: DataFrame, path: str, mode: str = "overwrite") -> None:
        writer = rows.write.mode(mode)
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(path)

    def _rows(self, runs) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(self.schema)
        out = None
        for run in runs:
            rows = read.parquet(run[3]).select(*self.schema.fieldNames())
            out = rows if out is None else out.unionByName(rows)
        return out

    def read(self, before: int | None = None) -> DataFrame:
        return self._rows(self.runs(before))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Write a batch's run, merge full levels, and commit the manifest of the batch."""
        earlier = self._versions(batch)
        runs = [(r.level, r.lo, r.hi, r.path) for r in earlier if r.level >= 0]
        self._write(rows, self._run(batch))
        runs.append((0, batch, batch, self._run(batch)))
        level = 0
        while len(full := [r for r in runs if r[0] == level]) >= self.fanout:
            lo, hi = min(r[1] for r in full), max(r[2] for r in full)
            path = f"{self.folder}_merged/level={level + 1}/run={lo}_{hi}"
            merged = self.merge(self._rows(full))
            self._write(merged.repartition(self.partition) if self.partition else merged, path)
            runs = [r for r in runs if r[0] != level] + [(level + 1, lo, hi, path)]
            level += 1
        self._commit(batch, runs, earlier[0].note)


def bucket_of(column: str, n: int):
    """The bucket of a value: the same for equal values, whatever their batch."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(n)).cast("int")
