"""The mail source: what the mailbox server would return for search and fetch.

``messages`` is the server-side view of every message: raw fields as first
received, plus the current unread flag (the latest write's).  The scans apply
the original's page caps per mailbox with a window limit, which Spark plans
as a partial top-k before the shuffle (WindowGroupLimit), so a mailbox holding
a third of all mail never sends more than ``cap`` rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import fold
from ..schema import POLL_BATCH, UNREAD_PAGE

MESSAGE_COLUMNS = ["id", "mailbox_id", "thread_id", "sender", "recipient", "subject",
                   "snippet", "body", "date", "processed_at"]


def messages(log: DataFrame) -> DataFrame:
    """One row per message id: first-write raw fields, latest unread flag."""
    return messages_from_partial(fold.first_last(log, extra_first=["recipient", "k"],
                                                 extra_last=["unread"]))


def messages_from_partial(folded: DataFrame) -> DataFrame:
    """The mail source from a fold whose structs carry recipient, k and unread."""
    return folded.select(
        "id", F.col("first.mailbox_id").alias("mailbox_id"),
        F.col("first.thread_id").alias("thread_id"), F.col("first.sender").alias("sender"),
        F.col("first.recipient").alias("recipient"),
        F.col("first.subject").alias("subject"),
        F.col("first_text.snippet").alias("snippet"), F.col("first_text.body").alias("body"),
        F.col("first.date").alias("date"), F.col("first.processed_at").alias("processed_at"),
        F.col("last.unread").alias("unread"), F.col("first.k").alias("k"))


def _newest_per_mailbox(df: DataFrame, cap: int) -> DataFrame:
    w = Window.partitionBy("mailbox_id").orderBy(F.col("processed_at").desc(), F.col("id"))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def scan_unread_ids(msgs: DataFrame, max_results: int = UNREAD_PAGE) -> DataFrame:
    """S1 + T4: ids of unread mail, newest first, capped per mailbox; ids only."""
    unread = msgs.where(F.col("unread")).select("mailbox_id", "id", "processed_at")
    return _newest_per_mailbox(unread, max_results).select("mailbox_id", "id")


def scan_unread_content(msgs: DataFrame, max_results: int = POLL_BATCH) -> DataFrame:
    """Id search first, then content for exactly those ids (semi join)."""
    ids = scan_unread_ids(msgs, max_results)
    return msgs.join(ids, ["mailbox_id", "id"], "left_semi").select(*MESSAGE_COLUMNS)


def scan_since_days(msgs: DataFrame, as_of: Column, days: int,
                    max_results: int | None = UNREAD_PAGE) -> DataFrame:
    """S3: mail received on or after the calendar day ``days`` before as_of.

    The source search works at day granularity (``after:YYYY/MM/DD``).
    """
    since = F.date_sub(as_of.cast("date"), days)
    recent = msgs.where(F.col("processed_at") >= since.cast("timestamp_ntz"))
    if max_results is not None:
        recent = _newest_per_mailbox(recent, max_results)
    return recent.select(*MESSAGE_COLUMNS)


def email_lookup(msgs: DataFrame, email_id) -> DataFrame:
    """Point read of one message; over a stored fold the predicate reaches the scan."""
    return msgs.where(F.col("id") == F.lit(email_id)).select(*MESSAGE_COLUMNS)
