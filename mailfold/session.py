"""Session construction and shared-storage locations.

Library functions never build a session themselves; they take the caller's.
``build_session`` exists for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that the plans in this package are written against.  AQE lets the
# planner turn a sort-merge join into a broadcast join when a side turns out to
# be small at run time, coalesce tiny shuffle partitions and split skewed ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "mailfold", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    A scratch folder of our own is chosen only where none is set *and* the
    session runs in one process (``local[n]``, as in tests); on a cluster an
    unset folder is an error, since workers do not share local disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all workers share")
        base = tempfile.mkdtemp(prefix="mailfold-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    except Exception:  # noqa: BLE001  no SparkContext (Spark Connect)
        pass
    return base


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh directory under the cluster's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names shared storage that survives
    executor loss (see ``ensure_checkpoint_dir``).
    """
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex[:12]}")
