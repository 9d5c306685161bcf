"""Parquet table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; Catalyst prunes columns and pushes filters into the scan."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Cores the cluster offers (falls back to the shuffle width when the
    session exposes no SparkContext, as under Spark Connect)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, key: str | None = None, factor: int = 2) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has cores.

    A single large file with one row group is read by one task; CPU-heavy
    per-row work after it (tokenising, hashing) would then run on one core.
    Only narrow scans are repartitioned: a scan over many files already has
    at least ``defaultParallelism`` partitions and is returned unchanged, so no
    shuffle is added at scale.  Select the needed columns before calling.

    With ``key`` the rows are hash-partitioned on it, so later aggregates and
    windows keyed by (a superset of) ``key`` need no further exchange.
    """
    target = parallelism(df.sparkSession) * factor
    try:
        current = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001  no RDD view (Spark Connect): leave the scan as is
        return df
    if current >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)
