"""The append-only mail event log, derived from the driver's test tables.

Each row of ``events`` is one "save" of an analysed mail.  Events are dealt to
``documents`` in consecutive blocks; every third event redelivers an older
document, so ids are written many times and upserts are exercised.  The
mapping (FIXTURES.md section 2) is reproduced column by column:

* the document supplies the raw content (subject, snippet, body, thread) and
  the entity list;
* the event supplies who sent it, when it was processed and the analysis;
  ``k`` (the integer in ``events.props``) decides which optional fields are
  missing.

Two views of the same log:

* ``event_columns`` - one row per write, from ``events`` alone (no join);
* ``event_log``     - the same rows with the document content attached.

``folded_state`` builds the per-id state without ever shuffling content: it
folds fixed-width write values first (hash aggregation with a map-side
combine, so an id written millions of times collapses before the shuffle),
derives the string fields, then joins ``documents`` once per id.  The content expressions are shared by both paths
(``_content``), so a per-event row and a folded row derive content the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import read_table, spread

N_MAILBOXES = 8


def _k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


EVENT_TYPES = ["view", "signup", "error", "purchase", "click"]


def constants(spark: SparkSession, sf_dir: str) -> dict:
    """The log's three constants in one job: both row counts (answered from
    Parquet metadata) and the newest write time."""
    docs = read_table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("timestamp_ntz").alias("now"),
        F.lit("documents").alias("t"))
    events = read_table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("now"), F.lit("events").alias("t"))
    rows = {r["t"]: r for r in docs.unionByName(events).collect()}      # two rows
    return {"n_docs": rows["documents"]["n"], "n_events": rows["events"]["n"],
            "now": rows["events"]["now"]}


def _base(spark: SparkSession, sf_dir: str, consts: dict | None = None) -> DataFrame:
    """Per write, fixed-width only: (seq, id, ts, user_id, etype code, k)."""
    consts = consts or constants(spark, sf_dir)
    events = read_table(spark, sf_dir, "events")
    # The row counts are inlined as literals: a scalar subquery here would be
    # copied into every place Catalyst inlines the id expression.
    n_docs = F.lit(consts["n_docs"]).cast("long")
    n_events = F.lit(consts["n_events"]).cast("long")
    # block = floor(event_id * n_docs / n_events), halved for redeliveries,
    # as exact integer division in decimal(38,0): no overflow and no double
    # rounding however large the tables get.
    num = F.col("event_id").cast("decimal(38,0)") * n_docs.cast("decimal(38,0)")
    den = (F.when(F.col("event_id") % 3 == 0, n_events * 2).otherwise(n_events)
           .cast("decimal(38,0)"))
    codes = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return events.select(
        F.col("event_id").alias("seq"),
        ((num - num % den) / den).cast("bigint").alias("id"),
        "ts", "user_id",
        F.array_position(codes, F.col("event_type")).cast("int").alias("etype"),
        _k().alias("k"))


def _fields(seq: Column, id_: Column, ts: Column, user_id: Column, etype: Column,
            k: Column) -> dict[str, Column]:
    """Every column a write takes from ``events``, from its fixed-width values."""
    event_type = F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), etype)
    human = event_type.isin("view", "signup")
    return {
        "seq": seq, "id": id_,
        "mailbox_id": user_id % N_MAILBOXES,
        "sender": F.concat(F.lit("u"), user_id.cast("string"), F.lit("@example.com")),
        "recipient": F.when(k % 9 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("box"), (user_id % N_MAILBOXES).cast("string"),
                            F.lit("@example.com"))),
        "date": F.when(k % 13 == 0, F.lit(None).cast("string"))
        .otherwise(ts.cast("date").cast("string")),
        "unread": k % 3 == 0,
        "email_type": F.when(human, F.lit("human")).otherwise(F.lit("automated")),
        "domain": F.when(human, F.lit(None).cast("string"))
        .when(event_type == "error", F.lit("alerts"))
        .when(event_type == "purchase", F.lit("shopping"))
        .when(event_type == "click", F.lit("marketing")),
        "summary": F.when(k % 19 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("doc "), id_.cast("string"))),
        "requires_reply": k % 2 == 0,
        "deadline": F.when(k % 5 == 0, F.concat(F.lit("by day "), k.cast("string")))
        .when(k % 7 == 0, F.lit("")),
        "processed_at": ts,
        "follow_up_status": F.when(k % 3 == 1, F.lit("done")).otherwise(F.lit("pending")),
        "deadline_status": F.when(k % 3 == 1, F.lit("done")).otherwise(F.lit("open")),
        "k": k,
    }


EVENT_COLUMNS = ["seq", "id", "mailbox_id", "sender", "recipient", "date", "unread",
                 "email_type", "domain", "summary", "requires_reply", "deadline",
                 "processed_at", "follow_up_status", "deadline_status", "k"]


def event_columns(spark: SparkSession, sf_dir: str, consts: dict | None = None) -> DataFrame:
    """One row per write with every column that comes from ``events`` alone."""
    fields = _fields(*[F.col(c) for c in ("seq", "id", "ts", "user_id", "etype", "k")])
    return _base(spark, sf_dir, consts).select(*[fields[c].alias(c) for c in EVENT_COLUMNS])


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # A narrow scan (one large file) is spread by doc_id so the join runs on
    # every core; wide scans are left as they are.
    return spread(docs, key="doc_id")


def _content(k_raw: Column, k_analysis: Column) -> dict[str, Column]:
    """Document-derived columns; ``k_raw`` / ``k_analysis`` pick the write whose
    raw fields / analysis apply (the same write for a per-event row)."""
    return {
        "thread_id": F.concat(F.lit("t"), F.col("source")),
        "subject": F.substring("text", 1, 60),
        "snippet": F.substring("text", 1, 200),
        "body": F.when(k_raw % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("text")),
        "entities": F.when(k_analysis % 17 == 0, F.lit("bad["))
        .otherwise(F.concat(F.lit('["'), "source", F.lit('","'), "lang", F.lit('"]'))),
    }


LOG_COLUMNS = ["seq", "id", "mailbox_id", "thread_id", "sender", "recipient", "subject",
               "snippet", "body", "date", "unread", "email_type", "domain", "entities",
               "summary", "requires_reply", "deadline", "processed_at", "follow_up_status",
               "deadline_status", "k"]


def event_log(spark: SparkSession, sf_dir: str, consts: dict | None = None) -> DataFrame:
    """The full log: one row per write with its document content."""
    ev = event_columns(spark, sf_dir, consts)
    d = _documents(spark, sf_dir)
    joined = ev.join(d, ev["id"] == d["doc_id"], "inner")
    content = _content(F.col("k"), F.col("k"))
    return joined.select(*[content[c].alias(c) if c in content else F.col(c)
                           for c in LOG_COLUMNS])


def folded_state(spark: SparkSession, sf_dir: str, consts: dict | None = None) -> DataFrame:
    """The per-id fold (``operators.fold.first_last`` shape) built fold-first.

    The writes are folded by id on fixed-width values only - ``min``/``max`` of
    seq and ``min_by``/``max_by`` of ts, user, event type and payload key - so
    Spark hash-aggregates with a map-side combine (an id written millions of
    times collapses before the shuffle).  Strings are derived after the fold
    by the same expressions as ``event_columns``, and each id is then joined
    once to its document: content is never carried through the shuffle.
    ``last_raw`` holds what the latest write itself carried (the vector index
    is upserted with the latest write's raw fields).
    """
    base = _base(spark, sf_dir, consts)
    agg = base.groupBy("id").agg(
        F.min("seq").alias("f_seq"), F.min_by("ts", "seq").alias("f_ts"),
        F.min_by("user_id", "seq").alias("f_user"), F.min_by("k", "seq").alias("f_k"),
        F.min_by("etype", "seq").alias("f_etype"),
        F.max("seq").alias("l_seq"), F.max_by("ts", "seq").alias("l_ts"),
        F.max_by("user_id", "seq").alias("l_user"), F.max_by("k", "seq").alias("l_k"),
        F.max_by("etype", "seq").alias("l_etype"),
        F.count(F.lit(1)).alias("n_writes"))
    d = _documents(spark, sf_dir)
    j = agg.join(d, agg["id"] == d["doc_id"], "inner")
    idc = F.col("id")
    f = _fields(F.col("f_seq"), idc, F.col("f_ts"), F.col("f_user"), F.col("f_etype"),
                F.col("f_k"))
    l = _fields(F.col("l_seq"), idc, F.col("l_ts"), F.col("l_user"), F.col("l_etype"),
                F.col("l_k"))
    c = _content(F.col("f_k"), F.col("l_k"))
    first = F.struct(
        f["seq"].alias("seq"), f["mailbox_id"].alias("mailbox_id"),
        c["thread_id"].alias("thread_id"), f["sender"].alias("sender"),
        c["subject"].alias("subject"), f["date"].alias("date"),
        f["processed_at"].alias("processed_at"), f["recipient"].alias("recipient"),
        f["k"].alias("k"), f["requires_reply"].alias("requires_reply"),
        f["deadline"].alias("deadline"), f["follow_up_status"].alias("follow_up_status"),
        f["deadline_status"].alias("deadline_status"))
    first_text = F.struct(f["seq"].alias("seq"), c["snippet"].alias("snippet"),
                          c["body"].alias("body"))
    last = F.struct(
        l["seq"].alias("seq"), l["email_type"].alias("email_type"),
        l["domain"].alias("domain"), l["summary"].alias("summary"),
        l["requires_reply"].alias("requires_reply"), l["deadline"].alias("deadline"),
        c["entities"].alias("entities"), l["unread"].alias("unread"))
    last_raw = F.struct(
        l["seq"].alias("seq"), l["sender"].alias("sender"), c["subject"].alias("subject"),
        c["thread_id"].alias("thread_id"), l["date"].alias("date"),
        c["snippet"].alias("snippet"),
        _content(F.col("l_k"), F.col("l_k"))["body"].alias("body"))
    return j.select("id", first.alias("first"), first_text.alias("first_text"),
                    last.alias("last"), last_raw.alias("last_raw"), "n_writes")


def contacts_state(spark: SparkSession, sf_dir: str, consts: dict | None = None) -> DataFrame:
    """D2 on fixed-width values: writes per sender and the last write's date.

    The sender string is a function of the user id, so the fold groups by
    the id and keeps ``max_by`` of the write time and payload key (hash
    aggregation, map-side combine for a sender holding a third of the log);
    address and date are derived after.  Same rows as ``fold.contacts_state``.
    """
    agg = _base(spark, sf_dir, consts).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_emails"),
        F.max_by("ts", "seq").alias("l_ts"), F.max_by("k", "seq").alias("l_k"))
    f = _fields(F.lit(None), F.lit(None), F.col("l_ts"), F.col("user_id"), F.lit(None),
                F.col("l_k"))
    return agg.select(f["sender"].alias("email_address"), "total_emails",
                      f["date"].alias("last_contact"))


def as_of(spark: SparkSession, sf_dir: str, consts: dict | None = None) -> Column:
    """'now' for the look-back queries: the newest processing time in the log.

    Taken once and inlined as a zone-less literal, so look-back predicates
    constant-fold and reach Parquet filters and partition pruning.
    """
    now = (consts or constants(spark, sf_dir))["now"]
    if now is None:
        return F.lit(None).cast("timestamp_ntz")
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
