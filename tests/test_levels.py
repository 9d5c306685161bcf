"""Levelled tables: bounded reads, crashes, replays; the seen table reads touched buckets only."""

import datetime as dt
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import make_log
from mailfold.streaming import ingest
from mailfold.streaming.levels import Levels, bucket_of


def table(spark, fanout=2, merge=None, partition=None):
    schema = spark.createDataFrame([], "id long, bucket int").schema
    return Levels(spark, os.path.join(tempfile.mkdtemp(prefix="levels-"), "t"), schema, merge, partition, fanout)


def rows(spark, *ids):
    return spark.createDataFrame([(i, i % 4) for i in ids], "id long, bucket int")


def held(levels, before=None):
    return sorted(r.id for r in levels.read(before).collect())


def test_reads_follow_the_levels_not_the_batches(spark):
    t = table(spark)
    t.create()
    for n in range(9):
        t.add(rows(spark, n, 100 + n), n)
        assert len(t.runs()) <= 4                                  # one a level for fanout 2
        assert held(t) == sorted([*range(n + 1), *range(100, 101 + n)])
    assert [(r[0], r[1], r[2]) for r in sorted(t.runs(), reverse=True)] == [(3, 0, 7), (0, 8, 8)]


def test_a_replayed_batch_and_a_crash_before_the_manifest_change_nothing(spark, monkeypatch):
    t = table(spark)
    t.create(rows(spark, 50))
    for n in range(4):
        t.add(rows(spark, n), n)
    for n in (2, 3):                                               # both again
        t.add(rows(spark, n), n)
    assert held(t) == [0, 1, 2, 3, 50] and held(t, 2) == [0, 1, 50]

    def crash(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(Levels, "_commit", crash)                        # run and merge are written, the manifest is not
        with pytest.raises(RuntimeError):
            t.add(rows(spark, 4), 4)
    assert held(t) == [0, 1, 2, 3, 50]
    t.add(rows(spark, 4), 4)
    assert held(t) == [0, 1, 2, 3, 4, 50]


def test_merging_and_an_empty_table(spark):
    t = table(spark, merge=lambda r: r.distinct(), partition="bucket")
    t.create()
    assert held(t) == []
    for n in range(4):
        t.add(rows(spark, 1, 2), n)
    assert held(t) == [1, 2]
    t.create(rows(spark, 9))                                       # it is there: left as it is
    assert held(t) == [1, 2]


def test_a_batch_reads_only_the_buckets_of_its_ids(spark):
    log = make_log(spark, [{"id": i, "processed_at": dt.datetime(2026, 1, 1)} for i in range(40)])
    out = tempfile.mkdtemp(prefix="buckets-")
    ingest.write_seed(spark, out, log.schema, spark.createDataFrame([(i,) for i in range(1000, 1400)], "id long"))
    handle = ingest._batch_handler(spark, out)
    handle(log, 0)
    seen = ingest.seen_table(spark, out, log.schema["id"].dataType)
    mine = spark.range(7, 8).select(bucket_of("id", seen.note()).alias("b")).first().b
    # every other bucket's files are made unreadable: the batch does not open them
    for path in glob.glob(f"{out}/seen/batch=*/bucket=*/*.parquet"):
        if f"/bucket={mine}/" not in path:
            with open(path, "wb") as f:
                f.write(b"broken")
    handle(log.where("id = 7"), 1)
    assert spark.read.parquet(f"{out}/processed").where("batch = 1").count() == 0
    plan = seen.read(1).where(F.col("bucket").isin([mine]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or f"PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters: ")[1][:40]


def test_the_seed_keeps_its_buckets_on_restart(spark, monkeypatch):
    log = make_log(spark, [{"id": i, "processed_at": dt.datetime(2026, 1, 1)} for i in range(6)])
    out = tempfile.mkdtemp(prefix="rebucket-")
    ingest.write_seed(spark, out, log.schema, spark.createDataFrame([(1,)], "id long"))
    monkeypatch.setattr(ingest, "SEEN_BUCKETS", 7)
    ingest.write_seed(spark, out, log.schema)
    ingest._batch_handler(spark, out)(log, 0)
    assert sorted(r.id for r in spark.read.parquet(f"{out}/processed").collect()) == [0, 2, 3, 4, 5]


def test_many_batches_through_the_stream(spark):
    log = make_log(spark, [{"id": i % 50, "processed_at": dt.datetime(2026, 1, 1) + dt.timedelta(hours=i)}
                           for i in range(80)])
    out = tempfile.mkdtemp(prefix="many-")
    ingest.write_seed(spark, out, log.schema)
    handle = ingest._batch_handler(spark, out)
    for n in range(10):
        handle(log.where(F.col("seq").between(8 * n, 8 * n + 7)), n)
    seen = ingest.seen_table(spark, out, log.schema["id"].dataType)
    assert sorted(r.id for r in seen.read().collect()) == list(range(50))
    assert len(seen.runs()) <= 8 and max(r[0] for r in seen.runs()) == 1
    assert spark.read.parquet(f"{out}/processed").count() == 50
