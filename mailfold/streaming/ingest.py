"""Structured Streaming: the poll loop as a file stream of log batches.

W1 ingest   - ``readStream`` over a directory of log files; ``maxFilesPerTrigger``
              plays the role of the per-poll cap, ``trigger(processingTime=...)``
              of the poll interval (``availableNow`` drains for tests/backfills).
W2 dedup    - each mail id is processed once, across batches and restarts.
              Exact form: in ``foreachBatch`` the batch's ids are semi-joined with
              the ids seen in earlier batches, in the buckets that they fall into.  Bounded-state form:
              ``dropDuplicatesWithinWatermark``.
W3 seed     - ids present before the stream starts are seeded as seen, once.
W4 failures - a processor error is routed to a dead-letter table; the mail is
              still marked seen (``per_message`` isolates errors of one message).
W5 state    - every batch writes the partial fold of the ids it touched; the
              state is the merge of the partials (``operators.fold.merge_partials``).

Seen ids and partials are kept in levels (``streaming.levels``): earlier batches are
merged as they add up, so what a batch or a reader opens follows the levels and not the
number of batches.

Every batch writes under ``batch=<id>`` with overwrite, so a batch replayed
after a failure replaces its own output: the sink is idempotent and the
checkpoint resumes without loss.
"""

from __future__ import annotations

import os
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators import fold
from ..session import shared_dir
from .levels import Levels, bucket_of

CHUNK_DAYS = 5


#: Rows of a source file, where a chunk is written as several.
FILE_ROWS = 200_000

#: Codec of the source's files and of the ingest sink, which hold every write with its texts.
CODEC = "zstd"

#: Chunks that a staging task writes side by side; rows of further chunks are sorted by chunk first.
OPEN_CHUNKS = 32

#: While staging: rows go to the files of their chunks unsorted, and shuffle files go as soon as a write ends.
STAGING_CONF = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_CHUNKS),
                "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: The log is staged a share of its ids at a time: a pass for each so many rows, and so many passes at most.
PASS_ROWS, PASSES = 1_000_000, 2

#: Small row groups, as a task holds one for each chunk.
STAGING_OPTIONS = {"compression": CODEC, "parquet.block.size": str(8 << 20)}


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    """The session's settings with ``conf`` among them, put back afterwards."""
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _day() -> Column:
    return F.unix_date(F.to_date("processed_at"))


def count_chunks(log: DataFrame, chunk_days: int = CHUNK_DAYS) -> tuple[int | None, dict[int, int]]:
    """(first day, rows by chunk): one small row per day reaches the driver.

    Writes without a time count to the last chunk."""
    with _settings(log.sparkSession, STAGING_CONF):
        days = {r.day: r.n for r in log.groupBy(_day().alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()}
    timeless = days.pop(None, 0)
    lo, counts = min(days, default=None), {}
    for day, n in days.items():
        chunk = (day - lo) // chunk_days
        counts[chunk] = counts.get(chunk, 0) + n
    if timeless:
        last = max(counts, default=0)
        counts[last] = counts.get(last, 0) + timeless
    return lo, counts


def files_per_chunk(log: DataFrame, chunk_days: int = CHUNK_DAYS, file_rows: int = FILE_ROWS, chunks=None) -> int:
    """Files that the largest chunk needs: what ``write_log_source`` is given as ``files``."""
    return max(1, -(-max((chunks or count_chunks(log, chunk_days))[1].values(), default=0) // file_rows))


def write_log_source(log: DataFrame, out_dir: str, chunk_days: int = CHUNK_DAYS, files: int = 1, chunks=None) -> int:
    """Fixture: write the log as files in arrival order, ``chunk_days`` days per chunk.

    The log is computed into a staging table partitioned by chunk, without a sort of its
    rows; a large log in passes over shares of the ids, so that shuffle files hold one
    share.  A chunk is copied whole before the next one begins, as exactly ``files`` files,
    so file times follow arrival order, which is the order a file stream consumes them in,
    and a stream that takes a multiple of ``files`` files at a time never sees a part of a
    chunk.  Files of one chunk are written by parallel tasks; a chunk with fewer of them
    gets empty ones.  A staged chunk is emptied when it is copied: the log is on disk once.
    ``chunks`` is what ``count_chunks`` gave, if it was asked.  Returns the number of chunks.
    """
    spark = log.sparkSession
    lo, counts = chunks or count_chunks(log, chunk_days)
    if not counts:
        return 0
    last = max(counts)
    staging = out_dir.rstrip("/") + "_staging"
    chunk = F.coalesce(F.floor((_day() - F.lit(lo)) / chunk_days), F.lit(last)).cast("int")
    passes = min(PASSES, -(-sum(counts.values()) // PASS_ROWS))
    with _settings(spark, STAGING_CONF):
        for share in range(passes):
            rows = log.where(bucket_of("id", passes) == share) if passes > 1 else log
            (rows.withColumn("_chunk", chunk).write.mode("append" if share else "overwrite")
             .options(**STAGING_OPTIONS).partitionBy("_chunk").parquet(staging))
    there = spark.read.schema(log.schema)
    empty = spark.createDataFrame([], log.schema).coalesce(1)
    for c in range(last + 1):
        if c in counts:
            staged = f"{staging}/_chunk={c}"
            there.parquet(staged).coalesce(files).write.mode("append").option("compression", CODEC).parquet(out_dir)
            empty.write.mode("overwrite").parquet(staged)
        for _ in range(len(there.parquet(out_dir).inputFiles()), files * (c + 1)):
            empty.write.mode("append").parquet(out_dir)
    return last + 1


def log_stream(spark: SparkSession, src_dir: str, schema, max_files: int = 1, consume: bool = False) -> DataFrame:
    """The log as a stream; at most ``max_files`` new files per micro-batch.

    With ``consume`` the files of a micro-batch are deleted once it is committed."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("cleanSource", "delete" if consume else "off")
            .parquet(src_dir))


def _drain(stream_writer, checkpoint: str):
    q = (stream_writer.option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def start_poller(spark: SparkSession, src_dir: str, schema, out_dir: str, checkpoint: str,
                 process=None, interval: str = "60 seconds", max_files: int = 50,
                 seed_ids: DataFrame | None = None):
    """W1 live: the poll loop as a running query - a micro-batch every
    ``interval`` with at most ``max_files`` new files, exact once-per-id
    processing (``run_dedup``'s batch logic).  Returns the StreamingQuery;
    stopping and restarting it resumes from ``checkpoint``."""
    write_seed(spark, out_dir, schema, seed_ids)
    handle = _batch_handler(spark, out_dir, process)
    return (log_stream(spark, src_dir, schema, max_files).writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(processingTime=interval).start())


def run_ingest(spark: SparkSession, src_dir: str, schema, sink_dir: str, checkpoint: str,
               max_files: int = 1, consume: bool = False) -> DataFrame:
    """W1 drained: every log row appended once to the sink; ``consume`` as in ``log_stream``."""
    stream = log_stream(spark, src_dir, schema, max_files, consume)

    def write(batch: DataFrame, batch_id: int):
        (batch.write.mode("overwrite").option("compression", CODEC)
         .parquet(os.path.join(sink_dir, f"batch={batch_id}")))

    _drain(stream.writeStream.foreachBatch(write), checkpoint)
    return spark.read.parquet(sink_dir).drop("batch")


SEEN_BUCKETS = 64


def seen_table(spark: SparkSession, out_dir: str, id_type) -> Levels:
    """The ids seen so far, laid out by bucket of the id."""
    schema = T.StructType([T.StructField("id", id_type), T.StructField("bucket", T.IntegerType())])
    return Levels(spark, os.path.join(out_dir, "seen"), schema, partition="bucket")


def first_sight(batch: DataFrame, seen: Levels, batch_id: int,
                spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Rows of ids not seen in an earlier batch, one per id (the earliest in the batch).

    Only batches before ``batch_id`` count as seen: a batch that is replayed
    after a crash finds its own ids new again, whatever it had written.  The
    batch's fold is cached (one micro-batch, bounded by the trigger), so the
    planner knows its size and picks the join; of the seen table only the
    buckets of the batch's ids are read.  Returns the new rows and the cached
    fold, which the caller unpersists after its writes.
    """
    # no exchange before the fold: repeated writes of an id are combined by the tasks that
    # read them, so their texts are not shuffled
    firsts = fold.first_writes(batch, [c for c in batch.columns if c not in ("id", "seq")])
    firsts = firsts.cache()
    bucket = bucket_of("id", seen.note()).alias("bucket")
    touched = [r.bucket for r in firsts.select(bucket).distinct().collect()]     # at most the number of buckets
    known = seen.read(batch_id).where(F.col("bucket").isin(touched)).select("id")
    already = known.join(firsts.select("id"), "id", "left_semi")
    return firsts.join(already, "id", "left_anti"), firsts


def per_message(process, out_schema: str):
    """A ``process`` that runs ``process(row dict) -> dict`` for one message at a time.

    A message that raises goes to the failures with its error and the others
    go on; ``out_schema`` describes the returned dict.
    """
    def run(new: DataFrame):
        from pyspark.sql import types as T
        names = T._parse_datatype_string(out_schema).fieldNames()
        ids = new.schema["id"].dataType.simpleString()
        schema = f"_id {ids}, _seq long, _error string, {out_schema}"

        def each(batches):
            for pdf in batches:
                rows = []
                for message in pdf.to_dict("records"):
                    try:
                        made, error = process(message), None
                    except Exception as exc:  # noqa: BLE001  a message's failure is its result
                        made, error = {}, f"{type(exc).__name__}: {exc}"
                    rows.append((message["id"], message["seq"], error, *(made.get(n) for n in names)))
                yield pd.DataFrame(rows, columns=["_id", "_seq", "_error", *names], dtype=object)

        done = new.mapInPandas(each, schema).cache()
        return (done.where("_error is null").select(*names),
                done.where("_error is not null").select(
                    F.col("_id").alias("id"), F.col("_seq").alias("seq"), F.col("_error").alias("reason")))
    return run


def _batch_handler(spark: SparkSession, out_dir: str, process=None):
    """foreachBatch body of W2-W4: first sight, process, dead-letter, mark seen.

    Every output of a batch is written under ``batch=<id>`` with overwrite and
    the seen ids come last, so a batch that is cut off anywhere and replayed
    replaces its own output and loses nothing."""
    done_dir = os.path.join(out_dir, "processed")
    dead_dir = os.path.join(out_dir, "failures")

    def handle(batch: DataFrame, batch_id: int):
        seen = seen_table(spark, out_dir, batch.schema["id"].dataType)
        new, folded = first_sight(batch, seen, batch_id, spark)
        new = new.cache()                                  # one micro-batch, bounded
        ok, bad = process(new) if process else (new, new.where(F.lit(False)).select("id"))
        tag = f"batch={batch_id}"
        ok.write.mode("overwrite").parquet(os.path.join(done_dir, tag))
        bad.write.mode("overwrite").parquet(os.path.join(dead_dir, tag))
        seen.add(new.select("id", bucket_of("id", seen.note()).alias("bucket")), batch_id)
        new.unpersist()
        folded.unpersist()
    return handle


def write_seed(spark: SparkSession, out_dir: str, schema, seed_ids: DataFrame | None = None) -> None:
    """The ids stored before the stream starts are batch -1 of the seen table.

    Written by the first start only; a restart keeps what is there, with or
    without a seed of its own.
    """
    id_type = schema["id"].dataType
    seed = (seed_ids.select(F.col("id").cast(id_type).alias("id")).distinct()
            if seed_ids is not None else spark.createDataFrame([], T.StructType([T.StructField("id", id_type)])))
    seen_table(spark, out_dir, id_type).create(
        seed.withColumn("bucket", bucket_of("id", SEEN_BUCKETS)), note=SEEN_BUCKETS)


def run_dedup(spark: SparkSession, src_dir: str, schema, out_dir: str, checkpoint: str,
              seed_ids: DataFrame | None = None, max_files: int = 1,
              process=None) -> tuple[DataFrame, DataFrame]:
    """W2-W4 drained: each id processed exactly once; failures dead-lettered.

    ``process`` maps the batch's new rows to ``(ok_rows, failed_rows)``; the
    default accepts everything.  Failed mail is still marked seen.  Returns
    (processed, failures) as DataFrames over the sink tables.
    """
    done_dir = os.path.join(out_dir, "processed")
    dead_dir = os.path.join(out_dir, "failures")
    write_seed(spark, out_dir, schema, seed_ids)
    stream = log_stream(spark, src_dir, schema, max_files)
    _drain(stream.writeStream.foreachBatch(_batch_handler(spark, out_dir, process)), checkpoint)
    processed = spark.read.parquet(done_dir).drop("batch")
    failures = spark.read.parquet(dead_dir).drop("batch")
    return processed, failures


STATE_FIRST = ["requires_reply", "deadline", "follow_up_status", "deadline_status"]


def run_state(spark: SparkSession, src_dir: str, schema, state_dir: str, checkpoint: str,
              max_files: int = 1) -> DataFrame:
    """W5 incremental: each micro-batch writes the partial folds of what it touched.

    Two partials per batch, each under ``batch=<id>``: one row per mail id (first
    and last write) and one row per sender (writes and last date), so all four
    state tables are merges of partials (``current_tables``).  Returns the
    emails table.
    """
    stream = log_stream(spark, src_dir, schema, max_files)
    extra = [c for c in STATE_FIRST if c in schema.fieldNames()]
    empty = spark.createDataFrame([], schema)
    parts = {"mails": lambda batch: fold.first_last(batch, extra_first=extra),
             "senders": fold.sender_partial}
    for name, partial in parts.items():
        partial(empty).write.mode("ignore").parquet(os.path.join(state_dir, f"{name}_schema"))
        _partial_levels(spark, state_dir, name).create()

    def handle(batch: DataFrame, batch_id: int):
        for name, partial in parts.items():
            _partial_levels(spark, state_dir, name).add(partial(batch), batch_id)

    _drain(stream.writeStream.foreachBatch(handle), checkpoint)
    return current_state(spark, state_dir)


def _partial_levels(spark: SparkSession, state_dir: str, name: str) -> Levels:
    schema = spark.read.parquet(os.path.join(state_dir, f"{name}_schema")).schema
    merge = {"mails": fold.merge_partials, "senders": fold.merge_senders}[name]
    return Levels(spark, os.path.join(state_dir, name), schema, merge)


def _partials(spark: SparkSession, state_dir: str, name: str) -> DataFrame:
    return _partial_levels(spark, state_dir, name).read()


def current_tables(spark: SparkSession, state_dir: str) -> dict[str, DataFrame]:
    """D1-D4 from the base and every batch partial."""
    mails = fold.merge_partials(_partials(spark, state_dir, "mails"))
    names = mails.schema["first"].dataType.fieldNames()
    status = lambda c: c if c in names else None
    return {"emails": fold.emails_from_partial(mails),
            "contacts": fold.contacts_from_partial(_partials(spark, state_dir, "senders")),
            "follow_ups": fold.follow_ups_from_partial(mails, status("follow_up_status")),
            "deadlines": fold.deadlines_from_partial(mails, status("deadline_status"))}


def current_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The emails table: merge of the base and every batch partial."""
    return current_tables(spark, state_dir)["emails"]


def compact(spark: SparkSession, state_dir: str, out_dir: str) -> str:
    """Merge all partials into one base, as a state folder of its own in ``out_dir``."""
    for name in ("mails", "senders"):
        old = _partial_levels(spark, state_dir, name)
        spark.createDataFrame([], old.schema).write.mode("ignore").parquet(os.path.join(out_dir, f"{name}_schema"))
        _partial_levels(spark, out_dir, name).create(old.merge(old.read()))
    return out_dir


def watermark_dedup(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """W2 bounded-state form: duplicates of an id within ``delay`` are dropped.

    State is bounded by the watermark; a redelivery later than ``delay`` is
    processed again, so this form is exact only when redeliveries are timely.
    """
    # watermarks need a zoned timestamp; the log's processing time is zone-less
    timed = stream.withColumn("event_time", F.col("processed_at").cast("timestamp"))
    return (timed.withWatermark("event_time", delay)
            .dropDuplicatesWithinWatermark(["id"]).drop("event_time"))


def scratch(spark: SparkSession, purpose: str) -> str:
    return shared_dir(spark, purpose)
