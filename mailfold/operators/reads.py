"""Read queries over the folded state (what the tools and the CLI ask)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import EMAIL_COLUMNS


def _since(col: str, as_of: Column, hours: int = 0, days: int = 0) -> Column:
    window = F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))
    return F.col(col) >= as_of - window


def needs_reply(emails: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """F1 + T1: human mail asking for a reply, processed in the last N hours, newest first."""
    return (emails
            .where((F.col("email_type") == "human") & F.col("requires_reply")
                   & _since("processed_at", as_of, hours=hours))
            .orderBy(F.col("processed_at").desc(), F.col("id")))


def stored_ids_since(emails: DataFrame, as_of: Column, days: int) -> DataFrame:
    """F2 + U3: ids processed within the last N days."""
    return emails.where(_since("processed_at", as_of, days=days)).select("id").distinct()


def follow_ups_by_status(follow_ups: DataFrame, status: str = "pending") -> DataFrame:
    """F3."""
    return follow_ups.where(F.col("status") == status)


def open_deadlines_raw(deadlines: DataFrame) -> DataFrame:
    """F4 + T2: open deadlines, oldest first."""
    return deadlines.where(F.col("status") == "open").orderBy("created_at", "id")


def email_by_id(emails: DataFrame, email_id) -> DataFrame:
    """primary-key lookup, 0 or 1 row."""
    return emails.where(F.col("id") == F.lit(email_id))


def contact_by_address(contacts: DataFrame, address: str) -> DataFrame:
    """primary-key lookup, 0 or 1 row."""
    return contacts.where(F.col("email_address") == F.lit(address))


def all_emails(emails: DataFrame) -> DataFrame:
    """S5 + T2: every row, oldest processing time first."""
    return emails.orderBy("processed_at", "id")


def parse_entities(col: str = "entities") -> Column:
    """JSON text to array; malformed JSON becomes an empty list."""
    return F.coalesce(F.from_json(F.col(col), "array<string>"), F.array().cast("array<string>"))


def email_record(emails: DataFrame) -> DataFrame:
    """The record a caller sees, entities as a list."""
    return emails.select(*[parse_entities().alias(c) if c == "entities" else F.col(c)
                           for c in emails.columns])


def _email_struct(emails: DataFrame, alias: str = "email") -> DataFrame:
    cols = [c for c in EMAIL_COLUMNS if c in emails.columns]
    rec = F.struct(*[parse_entities().alias(c) if c == "entities" else F.col(c) for c in cols])
    return emails.select(F.col("id").alias("_eid"), rec.alias(alias))


def enrich(tracking: DataFrame, emails: DataFrame, name: str) -> DataFrame:
    """K5/K6: each tracking row with its mail, NULL when the mail is missing (left join)."""
    t = tracking.select(F.struct(*tracking.columns).alias(name), F.col("email_id").alias("_k"))
    e = _email_struct(emails)
    return (t.join(e, t["_k"] == e["_eid"], "left")
            .select(name, "email"))


def pending_followups(follow_ups: DataFrame, emails: DataFrame) -> DataFrame:
    """Q5."""
    return enrich(follow_ups_by_status(follow_ups, "pending"), emails, "follow_up")


def open_deadlines(deadlines: DataFrame, emails: DataFrame) -> DataFrame:
    """Q6, oldest first."""
    return (enrich(deadlines.where(F.col("status") == "open"), emails, "deadline")
            .orderBy("deadline.created_at", "deadline.id"))


def status_counts(emails: DataFrame, vectors: DataFrame, follow_ups: DataFrame,
                  deadlines: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """A4 / Q7: five counts in one row, each a scalar aggregate (no driver counting)."""
    reply = ((F.col("email_type") == "human") & F.col("requires_reply")
             & _since("processed_at", as_of, hours=hours))
    counts = emails.agg(F.count(F.lit(1)).alias("total_emails"),
                        F.count_if(reply).alias("needing_reply"))
    return counts.select(
        "total_emails",
        vectors.select(F.count(F.lit(1))).scalar().alias("vector_count"),
        "needing_reply",
        follow_ups.where(F.col("status") == "pending").select(F.count(F.lit(1))).scalar()
        .alias("pending_followups"),
        deadlines.where(F.col("status") == "open").select(F.count(F.lit(1))).scalar()
        .alias("open_deadlines"),
    )


def status_from_fold(folded: DataFrame, as_of: Column, hours: int = 24,
                     fu_status: str = "follow_up_status",
                     dl_status: str = "deadline_status") -> DataFrame:
    """A4 in one aggregate over the state fold: every id has one emails row and
    one vector (each write upserts both), its first write decides the follow-up
    and deadline rows, so all five counts are ``count_if`` of the same pass."""
    f, last = F.col("first"), F.col("last")
    reply = ((last["email_type"] == "human") & last["requires_reply"]
             & (f["processed_at"] >= as_of - F.make_dt_interval(hours=F.lit(hours))))
    d = f["deadline"]
    return folded.agg(
        F.count(F.lit(1)).alias("total_emails"),
        F.count(F.lit(1)).alias("vector_count"),
        F.count_if(reply).alias("needing_reply"),
        F.count_if(f["requires_reply"] & (f[fu_status] == "pending")).alias("pending_followups"),
        F.count_if(d.isNotNull() & (d != "") & (f[dl_status] == "open")).alias("open_deadlines"),
    )


def new_emails_antijoin(fetched: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """K1: fetched mail whose id is not stored yet."""
    return fetched.join(stored_ids.select("id"), "id", "left_anti")
