"""Daily briefing per mailbox: prompt (Q10), fallback text (Q11), file.

A briefing is produced as ordered *line rows* ``(mailbox_id, section, part,
k1, k2, line)`` rather than one string per mailbox: joining a mailbox's lines
with newlines in ``(section, part, k1, k2)`` order gives the text, and the
file sink writes them range-partitioned and sorted, so a mailbox holding a
third of all mail is written by many tasks and never becomes one value.
Section sizes (A6) come from a grouped count, combined map-side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import briefing_time
from ..sources.tables import parallelism


# fixed values: briefing wording
PROMPT_TITLE = "Today is {today}. Generate a concise morning email briefing.\n"
PROMPT_SECTIONS = ["HUMAN EMAILS NEEDING REPLY (last 24h):", "\nPENDING FOLLOW-UPS:",
                   "\nOPEN DEADLINES:"]
PROMPT_TAIL = ("\nFormat the briefing with clear labelled sections. Be specific — reference "
               "actual names, dates, and action items from the data above. End with a "
               '"Recommended focus" of 1–3 items for today.')
EMPTY_SECTION = "  None"
FALLBACK_TITLE = "# Morning Briefing — {today}\n"
FALLBACK_NOTE = "*(model unavailable — raw data)*\n"
FALLBACK_SECTIONS = ["\n## Human emails needing reply ({n})", "\n## Pending follow-ups ({n})",
                     "\n## Open deadlines ({n})"]


def _micros(c: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (independent of the session zone)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def section_items(needs_reply: DataFrame, follow_ups: DataFrame, deadlines: DataFrame,
                  emails: DataFrame) -> DataFrame:
    """The three sections as one table: (mailbox_id, section, k1, k2, fields...).

    Follow-ups and deadlines are left-joined to their mail (it may be missing).
    """
    e = emails.select(F.col("id").alias("_eid"), F.col("mailbox_id").alias("_mb"),
                      F.col("subject").alias("_subject"), F.col("sender").alias("_sender"))
    reply = needs_reply.select(
        "mailbox_id", F.lit(1).alias("section"),
        (-_micros(F.col("processed_at"))).alias("k1"), F.col("id").alias("k2"),
        F.col("id").alias("email_id"), "subject", "sender", "summary",
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("created_day"))
    fu = follow_ups.join(e, follow_ups["email_id"] == e["_eid"], "left").select(
        F.col("_mb").alias("mailbox_id"), F.lit(2).alias("section"),
        F.col("id").alias("k1"), F.lit(0).cast("bigint").alias("k2"),
        "email_id", F.col("_subject").alias("subject"), F.col("_sender").alias("sender"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("description"),
        F.substring(F.col("created_at").cast("string"), 1, 10).alias("created_day"))
    dl = deadlines.join(e, deadlines["email_id"] == e["_eid"], "left").select(
        F.col("_mb").alias("mailbox_id"), F.lit(3).alias("section"),
        _micros(F.col("created_at")).alias("k1"), F.col("id").alias("k2"),
        "email_id", F.col("_subject").alias("subject"), F.col("_sender").alias("sender"),
        F.lit(None).cast("string").alias("summary"), "description",
        F.lit(None).cast("string").alias("created_day"))
    return reply.unionByName(fu).unionByName(dl)


def section_items_from_fold(folded: DataFrame, as_of: Column, hours: int = 24,
                            fu_status: str = "follow_up_status",
                            dl_status: str = "deadline_status") -> DataFrame:
    """The three sections in one pass over the state fold (no joins).

    Each id yields up to three items - a reply to write, a pending follow-up,
    an open deadline - through ``explode_outer`` of an array of optional
    structs (an id with none keeps one row with a NULL section); subject and
    sender come from the same row.  Without the NULL rows, the same rows as
    ``section_items`` over the projected tables.
    """
    f, last = F.col("first"), F.col("last")
    window = F.make_dt_interval(hours=F.lit(hours))
    reply = ((last["email_type"] == "human") & last["requires_reply"]
             & (f["processed_at"] >= as_of - window))
    follow = f["requires_reply"] & (f[fu_status] == "pending")
    deadline = (f["deadline"].isNotNull() & (f["deadline"] != "") & (f[dl_status] == "open"))
    none = F.lit(None).cast("string")

    def item(section, k1, k2, summary, description, created_day):
        return F.struct(F.lit(section).alias("section"), k1.cast("bigint").alias("k1"),
                        k2.cast("bigint").alias("k2"), summary.alias("summary"),
                        description.alias("description"), created_day.alias("created_day"))

    items = F.array_compact(F.array(
        F.when(reply, item(1, -_micros(f["processed_at"]), F.col("id"), last["summary"],
                           none, none)),
        F.when(follow, item(2, f["seq"], F.lit(0), none, none,
                            F.substring(f["processed_at"].cast("string"), 1, 10))),
        F.when(deadline, item(3, _micros(f["processed_at"]), f["seq"], none, f["deadline"],
                              none)),
    ))
    rows = folded.select(f["mailbox_id"].alias("mailbox_id"), F.col("id").alias("email_id"),
                         f["subject"].alias("subject"), f["sender"].alias("sender"),
                         F.explode_outer(items).alias("it"))
    return rows.select("mailbox_id", "it.section", "it.k1", "it.k2", "email_id", "subject",
                       "sender", "it.summary", "it.description", "it.created_day")


def briefing_inputs(folded: DataFrame, as_of: Column, hours: int = 24):
    """(items, mailboxes, counts) of every briefing from the state fold.

    ``explode_outer`` keeps ids with no item (section NULL), so the mailbox
    list comes from the same rows as the items.  Each part is a scan of the
    columns it needs: pass the stored fold (``store.StoredState.folded``), or
    the log is folded once per part.
    """
    rows = section_items_from_fold(folded, as_of, hours)
    items = rows.where(F.col("section").isNotNull())
    mailboxes = rows.select("mailbox_id").distinct()
    return items, mailboxes, section_counts(items, mailboxes)


def section_counts(items: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """Size of every section of every mailbox, zeros included (no join to a
    generated grid: each mailbox row explodes its three section numbers)."""
    grid = mailboxes.select("mailbox_id",
                            F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("section"))
    counts = items.groupBy("mailbox_id", "section").agg(F.count(F.lit(1)).alias("n"))
    return (grid.join(counts, ["mailbox_id", "section"], "left")
            .select("mailbox_id", "section", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def _lines(mailbox_id, section, part, k1, k2, line) -> list[Column]:
    return [mailbox_id.alias("mailbox_id"), F.lit(section).alias("section") if isinstance(section, int)
            else section.alias("section"), F.lit(part).alias("part"),
            k1.cast("bigint").alias("k1"), k2.cast("bigint").alias("k2"), line.alias("line")]


def prompt_lines(items: DataFrame, counts: DataFrame, mailboxes: DataFrame,
                 today: Column) -> DataFrame:
    """Q10: the synthesis prompt of each mailbox as ordered lines."""
    zero = F.lit(0)
    title = mailboxes.select(*_lines(F.col("mailbox_id"), 0, 0, zero, zero,
                                     F.replace(F.lit(PROMPT_TITLE), F.lit("{today}"), today)))
    tail = mailboxes.select(*_lines(F.col("mailbox_id"), 4, 0, zero, zero, F.lit(PROMPT_TAIL)))
    head_text = F.element_at(F.array(*[F.lit(s) for s in PROMPT_SECTIONS]), F.col("section"))
    heads = counts.select(*_lines(F.col("mailbox_id"), F.col("section"), 0, zero, zero, head_text))
    nones = counts.where(F.col("n") == 0).select(
        *_lines(F.col("mailbox_id"), F.col("section"), 1, zero, zero, F.lit(EMPTY_SECTION)))
    reply = F.concat(F.lit("  - "), F.col("subject"), F.lit(" (from "), F.col("sender"),
                     F.lit("): "), F.col("summary"))
    follow = F.concat(F.lit("  - "), F.coalesce(F.col("subject"), F.lit("(unknown)")),
                      F.lit(" (from "), F.coalesce(F.col("sender"), F.lit("?")),
                      F.lit(", waiting since "), F.col("created_day"), F.lit(")"))
    deadline = F.concat(F.lit("  - "), F.col("description"), F.lit(" (email: "),
                        F.coalesce(F.col("subject"), F.lit("(unknown)")), F.lit(")"))
    text = (F.when(F.col("section") == 1, reply).when(F.col("section") == 2, follow)
            .otherwise(deadline))
    body = items.select(*_lines(F.col("mailbox_id"), F.col("section"), 1, F.col("k1"),
                                F.col("k2"), text))
    return title.unionByName(heads).unionByName(nones).unionByName(body).unionByName(tail)


def fallback_lines(items: DataFrame, counts: DataFrame, mailboxes: DataFrame,
                   today: Column) -> DataFrame:
    """Q11: the deterministic markdown briefing of each mailbox as ordered lines."""
    zero = F.lit(0)
    title = mailboxes.select(*_lines(F.col("mailbox_id"), 0, 0, zero, zero,
                                     F.replace(F.lit(FALLBACK_TITLE), F.lit("{today}"), today)))
    note = mailboxes.select(*_lines(F.col("mailbox_id"), 0, 1, zero, zero, F.lit(FALLBACK_NOTE)))
    head_tpl = F.element_at(F.array(*[F.lit(s) for s in FALLBACK_SECTIONS]), F.col("section"))
    heads = counts.select(*_lines(F.col("mailbox_id"), F.col("section"), 0, zero, zero,
                                  F.replace(head_tpl, F.lit("{n}"), F.col("n").cast("string"))))
    text = (F.when(F.col("section") == 1,
                   F.concat(F.lit("- "), F.col("subject"), F.lit(" — "), F.col("sender")))
            .when(F.col("section") == 2,
                  F.concat(F.lit("- "), F.coalesce(F.col("subject"),
                                                   F.col("email_id").cast("string"))))
            .otherwise(F.concat(F.lit("- "), F.col("description"))))
    body = items.select(*_lines(F.col("mailbox_id"), F.col("section"), 1, F.col("k1"),
                                F.col("k2"), text))
    return title.unionByName(note).unionByName(heads).unionByName(body)


def with_front_matter(lines: DataFrame, mailboxes: DataFrame, today: Column,
                      generated_at: Column) -> DataFrame:
    """YAML front matter ahead of each mailbox's briefing."""
    fm = F.concat(F.lit("---\ndate: "), today, F.lit("\ngenerated_at: "),
                  F.replace(F.substring(generated_at.cast("string"), 1, 19), F.lit(" "), F.lit("T")),
                  F.lit("+00:00\n---\n"))
    zero = F.lit(0)
    head = mailboxes.select(*_lines(F.col("mailbox_id"), -1, 0, zero, zero, fm))
    return head.unionByName(lines)


def write_briefings(lines: DataFrame, out_dir: str, day: str, partitions: int | None = None) -> str:
    """D7 sink: one text file set per (day, mailbox), lines in order.

    A day's folder is replaced as a whole and other days stay, so a rerun is
    idempotent and yesterday's briefing survives today's.

    Range partitioning on the full sort key splits a large mailbox over
    several tasks; each task writes its slice in order, and the part files of
    a mailbox directory concatenate in name order.
    """
    keys = ["mailbox_id", "section", "part", "k1", "k2"]
    n = partitions or parallelism(lines.sparkSession)
    (lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
     .select("mailbox_id", "line")
     .write.mode("overwrite").partitionBy("mailbox_id").text(f"{out_dir}/date={day}"))
    return f"{out_dir}/date={day}"


def daily_job(folded: DataFrame, as_of: Column, day: str, out_dir: str, hours: int = 24) -> DataFrame:
    """The briefings of one day over the current state, written with front matter.

    ``day`` and ``as_of`` are the run's parameters, so a missed day can be run
    later.  Returns the briefing lines that were written.
    """
    items, mailboxes, counts = briefing_inputs(folded, as_of, hours)
    lines = fallback_lines(items, counts, mailboxes, F.lit(day))
    write_briefings(with_front_matter(lines, mailboxes, F.lit(day), as_of), out_dir, day)
    return lines


def due_mailboxes(prefs: DataFrame, runs: DataFrame, now: dt.datetime) -> DataFrame:
    """The mailboxes whose briefing time has come today and that have none for today yet.

    ``prefs``: (mailbox_id, briefing_time as ``HH:MM``; anything else is 07:00); ``runs``:
    (mailbox_id, date) of the briefings written.  A late run finds every mailbox that an
    earlier one should have served.
    """
    at = briefing_time("briefing_time")
    minutes = at["hour"] * 60 + at["minute"]
    done = runs.where(F.col("date") == now.date().isoformat()).select("mailbox_id")
    return (prefs.where(minutes <= now.hour * 60 + now.minute).select("mailbox_id").distinct()
            .join(done, "mailbox_id", "left_anti"))


def briefing_runs(spark, out_dir: str) -> DataFrame:
    """(mailbox_id, date, run) of the briefings that are whole."""
    (spark.createDataFrame([(-1,)], "mailbox_id long").coalesce(1)
     .write.mode("ignore").parquet(f"{out_dir}-runs/date=none/run=none"))
    return (spark.read.schema("mailbox_id long, date string, run string").parquet(f"{out_dir}-runs")
            .where(F.col("date") != "none"))


def scheduled_job(folded: DataFrame, prefs: DataFrame, now: dt.datetime, out_dir: str, hours: int = 24) -> DataFrame:
    """W6 by preference: write the briefings that are due at ``now``; returns their mailboxes.

    Each run has a folder of its own (``run=HHMM/date=D``).  The list of mailboxes served is
    written after the briefings, so a run that is cut off is done again, by itself or by the
    next one, and a mailbox gets one briefing a day.
    """
    spark = folded.sparkSession
    day, run = now.date().isoformat(), now.strftime("%H%M")
    due_path = f"{out_dir}-due/date={day}/run={run}"
    due_mailboxes(prefs, briefing_runs(spark, out_dir), now).write.mode("overwrite").parquet(due_path)
    due = spark.read.schema("mailbox_id long").parquet(due_path)
    as_of = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    mine = folded.join(due.withColumnRenamed("mailbox_id", "_due"), F.col("first.mailbox_id") == F.col("_due"), "left_semi")
    items, mailboxes, counts = briefing_inputs(mine, as_of, hours)
    lines = with_front_matter(fallback_lines(items, counts, mailboxes, F.lit(day)), mailboxes, F.lit(day), as_of)
    write_briefings(lines, f"{out_dir}/run={run}", day)
    due.write.mode("overwrite").parquet(f"{out_dir}-runs/date={day}/run={run}")
    return due


def mailboxes_of(emails: DataFrame) -> DataFrame:
    return emails.select("mailbox_id").distinct()
