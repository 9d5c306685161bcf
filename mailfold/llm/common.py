"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

#: ASCII white space as the operators understand it: space, tab, LF, VT, FF, CR.
ASCII_WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"input lacks columns {missing}; it has {df.columns}")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet under the shared folder and read it back.

    The files outlive any executor, so a lost one costs a re-read and not the
    whole upstream plan.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*cols: str) -> list[Column]:
    """A 128-bit key of a row's content, as two longs ``_k1`` and ``_k2``.

    It depends on the values alone (no position, no counter), so a task run
    again after an executor loss yields the same key.  Rows with equal values
    share it; the operators then give them equal results.
    """
    values = [F.col(c) for c in cols]
    marks = [F.col(c).isNull() for c in cols]
    return [F.xxhash64(*values, *marks).alias("_k1"),
            F.xxhash64(F.lit("second"), *values, *marks).alias("_k2")]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body(value)``.

    A lambda variable is bound to the computed value, where a plain reference
    could be inlined by the optimiser and evaluated per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def worker_state(key, build):
    """One object per Python worker process, built on first use and kept between tasks.

    Code of this package travels to executors by value, so its module globals
    are new in every task; the holder module is registered in ``sys.modules``
    and outlives them.
    """
    holder = sys.modules.get("_mailfold_worker_state")
    if holder is None:
        holder = sys.modules["_mailfold_worker_state"] = types.ModuleType("_mailfold_worker_state")
        holder.values = {}
    if key not in holder.values:
        holder.values[key] = build()
    return holder.values[key]


def text_slices(batch, column: str, max_bytes: int = 4 << 20):
    """Cut an Arrow record batch into runs of rows of at most ``max_bytes`` of text.

    A single longer text forms a run of its own, so texts stay whole.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        part = batch.slice(at, stop - at)
        yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns)],
                                         names=part.schema.names)
        at = stop
