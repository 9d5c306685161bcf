"""Read rules: look-back boundary and order (rule 6), page caps per mailbox (T4)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import make_log
from mailfold.operators import fold, reads
from mailfold.sources import mailbox


def test_needs_reply_boundary_inclusive_and_newest_first(spark):
    now = dt.datetime(2026, 3, 2, 12, 0)
    log = make_log(spark, [
        {"id": 1, "requires_reply": True, "processed_at": now - dt.timedelta(hours=24)},
        {"id": 2, "requires_reply": True, "processed_at": now - dt.timedelta(hours=24, seconds=1)},
        {"id": 3, "requires_reply": True, "processed_at": now - dt.timedelta(hours=1)},
        {"id": 4, "requires_reply": False, "processed_at": now},
        {"id": 5, "requires_reply": True, "email_type": "automated", "processed_at": now},
    ])
    as_of = F.lit(now).cast("timestamp_ntz")
    got = [r["id"] for r in reads.needs_reply(fold.emails_state(log), as_of, 24).collect()]
    assert got == [3, 1]


def test_page_caps_per_mailbox(spark):
    base = dt.datetime(2026, 1, 1)
    rows = [{"id": i, "mailbox_id": i % 2, "processed_at": base + dt.timedelta(minutes=i)}
            for i in range(30)]
    log = make_log(spark, rows).withColumn("recipient", F.lit(None).cast("string")) \
        .withColumn("k", F.lit(0)).withColumn("unread", F.lit(True))
    msgs = mailbox.messages(log)
    ids = mailbox.scan_unread_ids(msgs, 4).collect()
    by_box = {}
    for r in ids:
        by_box.setdefault(r["mailbox_id"], []).append(r["id"])
    assert sorted(by_box[0]) == [22, 24, 26, 28] and sorted(by_box[1]) == [23, 25, 27, 29]
    content = mailbox.scan_unread_content(msgs, 2).collect()
    assert sorted(r["id"] for r in content) == [26, 27, 28, 29]
    assert "body" in content[0].asDict()


def test_status_counts_on_empty_store(spark):
    empty = make_log(spark, [{"id": 1}]).where(F.lit(False))
    st = reads.status_counts(fold.emails_state(empty), empty.select("id"),
                             fold.follow_ups_state(empty, None),
                             fold.deadlines_state(empty, None),
                             F.lit(dt.datetime(2026, 1, 1)).cast("timestamp_ntz")).first()
    assert st.asDict() == {"total_emails": 0, "vector_count": 0, "needing_reply": 0,
                           "pending_followups": 0, "open_deadlines": 0}


def test_snapshot_prunes_partitions(spark, tmp_path):
    from mailfold.operators import snapshot
    from mailfold.plans.context import Store
    s = Store(spark, "/root/testdata/sf0.001")
    out = str(tmp_path / "emails")
    snapshot.write_emails_snapshot(s.emails, out)
    as_of = F.lit(s.table("events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    fast = snapshot.needs_reply_from_snapshot(spark, out, as_of, 240)
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(processed_day" in plan
    want = reads.needs_reply(s.emails, as_of, 240)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, want.collect()))
