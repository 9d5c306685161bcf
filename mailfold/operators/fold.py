"""Event-sourced state: the four mail tables as folds of one append-only log.

The original writes each analysed mail with an upsert per table.  Every one of
those upserts is order-dependent but associative, so each table is a single
``groupBy`` over the log:

* emails     - per id: raw columns of the first write, analysis of the last;
* contacts   - per sender: number of writes and the date of the last write;
* follow_ups - the first write of an id, when it asked for a reply;
* deadlines  - the first write of an id, when it named a non-empty deadline.

``min_by``/``max_by`` are partial aggregates, so a hot id or a sender holding
a large share of the log is combined map-side before the shuffle; no window
over the whole log is needed.  All tables are projections of one ``first_last``
fold; partial folds of log slices merge with the same aggregate
(``merge_partials``), which is how streaming keeps state incrementally.  The
functions here take any log; ``sources.fixture`` builds the same fold from
fixed-width values (hash aggregation) for the driver's tables, and a test
checks the two agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import ANALYSIS_COLUMNS, RAW_COLUMNS
from ..sources.tables import parallelism


FIRST_META = ["seq", "mailbox_id", "thread_id", "sender", "subject", "date", "processed_at"]
FIRST_TEXT = ["seq", "snippet", "body"]
LAST = ["seq"] + ANALYSIS_COLUMNS


def first_last(log: DataFrame, extra_first=(), extra_last=()) -> DataFrame:
    """N1 + N2: one row per id with the first and the last write as structs.

    The first write's text (snippet, body) is its own aggregate, so a
    query that prints no text prunes it away and never shuffles message bodies;
    ``extra_first`` / ``extra_last`` add columns other projections need, so
    every table below is a projection of this one fold (one exchange, reused).
    """
    return log.groupBy("id").agg(
        F.min_by(F.struct(*FIRST_META, *extra_first), "seq").alias("first"),
        F.min_by(F.struct(*FIRST_TEXT), "seq").alias("first_text"),
        F.max_by(F.struct(*LAST, *extra_last), "seq").alias("last"),
        F.count(F.lit(1)).alias("n_writes"),
    )


def merge_partials(*partials: DataFrame) -> DataFrame:
    """Combine ``first_last`` results of disjoint log slices into one.

    The fold is associative: the earliest ``first*`` and the latest ``last``
    win, write counts add.  This is what makes incremental maintenance and
    compaction plain aggregates (log-structured merge of partial folds).
    """
    u = partials[0]
    for p in partials[1:]:
        u = u.unionByName(p)
    aggs = []
    for c in u.columns:
        if c.startswith("first"):
            aggs.append(F.min_by(c, f"{c}.seq").alias(c))
        elif c.startswith("last"):
            aggs.append(F.max_by(c, f"{c}.seq").alias(c))
        elif c == "n_writes":
            aggs.append(F.sum(c).alias(c))
    return u.groupBy("id").agg(*aggs)


def emails_from_partial(folded: DataFrame) -> DataFrame:
    """D1 from a (possibly merged) ``first_last`` fold."""
    return folded.select(
        "id",
        F.col("first.mailbox_id").alias("mailbox_id"),
        F.col("first.thread_id").alias("thread_id"),
        F.col("first.sender").alias("sender"),
        F.col("first.subject").alias("subject"),
        F.col("first_text.snippet").alias("snippet"),
        F.col("first_text.body").alias("body"),
        F.col("first.date").alias("date"),
        *[F.col(f"last.{c}").alias(c) for c in ANALYSIS_COLUMNS],
        F.col("first.processed_at").alias("processed_at"),
    )


def emails_state(log: DataFrame) -> DataFrame:
    """The emails table (upsert keeps raw columns, updates analysis)."""
    return emails_from_partial(first_last(log))


def follow_ups_from_partial(folded: DataFrame, status_col: str | None = None) -> DataFrame:
    """D3 from a fold whose ``first`` struct carries ``requires_reply`` (and the status)."""
    status = F.col(f"first.{status_col}") if status_col else F.lit("pending")
    return folded.where(F.col("first.requires_reply")).select(
        F.col("first.seq").alias("id"),
        F.col("id").alias("email_id"),
        status.alias("status"),
        F.lit(None).cast("string").alias("notes"),
        F.col("first.processed_at").alias("created_at"),
    )


def deadlines_from_partial(folded: DataFrame, status_col: str | None = None) -> DataFrame:
    """D4 from a fold whose ``first`` struct carries ``deadline`` (and the status)."""
    status = F.col(f"first.{status_col}") if status_col else F.lit("open")
    d = F.col("first.deadline")
    return folded.where(d.isNotNull() & (d != "")).select(
        F.col("first.seq").alias("id"),
        F.col("id").alias("email_id"),
        d.alias("description"),
        status.alias("status"),
        F.col("first.processed_at").alias("created_at"),
    )


def contacts_state(log: DataFrame) -> DataFrame:
    """Writes per sender (reprocessing counts again) and last written date.

    The last write wins even when its date is NULL; ``max_by`` keeps NULL values.
    """
    return log.groupBy(F.col("sender").alias("email_address")).agg(
        F.count(F.lit(1)).alias("total_emails"),
        F.max_by("date", "seq").alias("last_contact"),
    )


def sender_partial(log: DataFrame) -> DataFrame:
    """D2 of a log slice, mergeable: writes per sender and the last one's date."""
    return log.groupBy("sender").agg(F.count(F.lit(1)).alias("n_writes"),
                                     F.max(F.struct("seq", "date")).alias("last"))


def merge_senders(partials: DataFrame) -> DataFrame:
    """Combine ``sender_partial`` results of disjoint log slices."""
    return partials.groupBy("sender").agg(F.sum("n_writes").alias("n_writes"), F.max("last").alias("last"))


def contacts_from_partial(partials: DataFrame) -> DataFrame:
    """D2 from sender partials."""
    return merge_senders(partials).select(F.col("sender").alias("email_address"),
                                          F.col("n_writes").alias("total_emails"),
                                          F.col("last.date").alias("last_contact"))


def first_writes(log: DataFrame, cols) -> DataFrame:
    """The first write of each id, as a flat row."""
    folded = log.groupBy("id").agg(F.min_by(F.struct("seq", *cols), "seq").alias("f"))
    return folded.select("id", "f.*")


def latest_analysis(log: DataFrame) -> DataFrame:
    """N1 on its own: the analysis columns of the last write per id."""
    return log.groupBy("id").agg(
        F.max_by(F.struct(*ANALYSIS_COLUMNS), "seq").alias("a")).select("id", "a.*")


def first_raw(log: DataFrame) -> DataFrame:
    """N2 on its own: the raw columns of the first write per id."""
    return log.groupBy("id").agg(
        F.min_by(F.struct(*RAW_COLUMNS), "seq").alias("r")).select("id", "r.*")


def follow_ups_state(log: DataFrame, status_col: str | None = "follow_up_status") -> DataFrame:
    """D3: a follow-up row when the first write of an id asked for a reply.

    N4: the surrogate key is the creating event's ``seq`` (unique and in
    insertion order, which is all the original's autoincrement promises).
    """
    extra = ["requires_reply"] + ([status_col] if status_col else [])
    return follow_ups_from_partial(_firsts(log, extra), status_col)


def deadlines_state(log: DataFrame, status_col: str | None = "deadline_status") -> DataFrame:
    """A deadline row when the first write of an id named a deadline ('' is none)."""
    extra = ["deadline"] + ([status_col] if status_col else [])
    return deadlines_from_partial(_firsts(log, extra), status_col)


def _firsts(log: DataFrame, extra) -> DataFrame:
    return log.groupBy("id").agg(
        F.min_by(F.struct("seq", "processed_at", *extra), "seq").alias("first"))


def dense_ordinals(df: DataFrame, order_col: str, out: str = "ordinal",
                   partitions: int | None = None) -> DataFrame:
    """N4 display form: 1..n in ``order_col`` order without a global window.

    The rows are range-partitioned and sorted within partitions; a row's
    position inside its partition comes from ``monotonically_increasing_id``
    and the partition's offset from a prefix sum over the per-partition counts
    (one row per partition, so the broadcast is bounded by the partition count).
    The partitioned rows are checkpointed once (reliably, under the cluster's
    checkpoint folder) so the counts and the numbering read the same
    partitions: a second evaluation would sample different range bounds.
    ``order_col`` must be unique for the numbering to be deterministic.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or parallelism(df.sparkSession)
    pid = F.spark_partition_id().cast("long")
    ordered = (df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
               .withColumn("_pid", pid)
               .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(pid, 33))
               .checkpoint(eager=True))
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ordered.join(F.broadcast(offsets), "_pid")
            .select(*df.columns, (F.col("_off") + F.col("_pos") + 1).alias(out)))
