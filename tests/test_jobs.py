"""Jobs that write: versions behind a pointer, the sink ledger, backfill batches, due briefings."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import make_log
from mailfold.operators import analysis, briefing, fold, store
from mailfold.operators.ledger import Ledger, Versions
from mailfold.plans.context import Store

SF = "/root/testdata/sf0.001"


def values(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_a_reader_sees_the_old_version_or_the_new_one(spark, tmp_path):
    rows = spark.range(3)
    table = Versions(spark, str(tmp_path / "t"), rows.schema)
    assert table.current().count() == 0 and table.version() is None
    assert table.publish(rows) == 0
    held = table.current()
    crashing = spark.range(100).select(F.when(F.col("id") < 90, F.col("id"))
                                       .otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        table.publish(crashing)
    assert values(table.current()) == [0, 1, 2] and table.version() == 0
    assert table.publish(spark.range(10, 12)) == 1
    assert values(Versions(spark, str(tmp_path / "t"), rows.schema).current()) == [10, 11]    # found again
    assert values(held) == [0, 1, 2]                               # who held the old one can finish
    assert table.publish(rows.limit(0)) == 2 and table.current().count() == 0


def test_reindex_writes_vectors_and_drops_mail_that_is_gone(spark, tmp_path):
    table = store.vector_table(spark, str(tmp_path / "v"))
    mails = fold.emails_state(make_log(spark, [{"id": 1, "body": "red car"}, {"id": 2, "body": None, "snippet": ""},
                                               {"id": 3, "subject": None, "body": "x" * 50_000, "summary": None}]))
    store.reindex(mails, table)
    got = {r.id: r for r in table.current().collect()}
    assert sorted(got) == [1, 2, 3] and got[1].document == "s\n\nred car\n\nsum" and len(got[1].vec) == 384
    assert abs(sum(x * x for x in got[3].vec) - 1) < 1e-9
    store.reindex(mails.where("id <> 2"), table)
    assert values(table.current()) == [1, 3] and table.version() == 1


def test_a_failed_sink_is_written_by_the_second_run_alone(spark, tmp_path):
    base = str(tmp_path / "sinks")
    down = spark.range(3).select(F.raise_error(F.lit("sink is down")).cast("long").alias("id"))
    first = {r.sink: r for r in store.fan_out(spark, {"a": spark.range(5), "b": down}, base, 7).collect()}
    assert first["a"].written and first["a"].n == 5 and not first["b"].written and "down" in first["b"].error
    # other rows for the sink that is done: it is not touched
    second = {r.sink: r for r in store.fan_out(spark, {"a": spark.range(9), "b": spark.range(2)}, base, 7).collect()}
    assert not second["a"].written and second["a"].n == 5 and second["b"].written and second["b"].n == 2
    assert values(spark.read.parquet(second["a"].path)) == list(range(5))
    third = {r.sink: r for r in store.fan_out(spark, {"a": spark.range(9)}, base, 8).collect()}
    assert third["a"].written and third["a"].n == 9 and third["a"].path != first["a"].path


def test_ledger_names(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    assert ledger.of(0) == {} and ledger.newest("a") is None
    with pytest.raises(ValueError):
        ledger.record(0, "a/b", 1, "p")
    ledger.record(0, "a", 1, "p")
    ledger.record(2, "a", 3, "q")
    assert ledger.newest("a").path == "q" and ledger.of(0)["a"].n == 1


def result_line(i, kind="human"):
    return json.dumps({"custom_id": str(i), "result": {"type": "succeeded", "message": {
        "stop_reason": "tool_use", "content": [{"type": "tool_use", "name": analysis.ANALYSIS_TOOL_NAME, "input": {
            "email_type": kind, "domain": None, "entities": [], "summary": "s", "requires_reply": True,
            "deadline": None}}]}}})


def test_broken_lines_keep_their_text(spark, tmp_path):
    broken = ["{\"custom_id\":\"4\",\"resul", "no json", "[1, 2]", "{}", "{\"custom_id\":\"5\"}", "null", "7"]
    lines = [result_line(1), *broken, "", "  ", result_line(1)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "r"))
    got = analysis.read_result_file(spark, str(tmp_path / "r")).collect()
    assert sorted(r.bad_line for r in got if r.bad_line is not None) == sorted(broken)
    assert [(r.custom_id, r.result_type, len(r.content)) for r in got if r.bad_line is None] == [("1", "succeeded", 1)] * 2
    pending = spark.createDataFrame([(1,)], "id long")
    dead = analysis.analysis_failures(analysis.apply_results(spark.read.text(str(tmp_path / "r")), pending)).collect()
    assert sorted(r.bad_line for r in dead) == sorted(broken) and {r.reason for r in dead} == {"malformed_result"}


def test_a_committed_backfill_batch_stays_and_a_lost_one_is_unseen(spark, tmp_path):
    base, stamp = str(tmp_path / "b"), F.lit("2024-02-01 07:00:00").cast("timestamp_ntz")
    pending = make_log(spark, [{"id": 1}, {"id": 2}, {"id": 3}]).withColumn("recipient", F.lit(None).cast("string"))
    asked = []

    def service(answers):
        def run(requests, results):
            asked.append(spark.read.text(requests).count())
            spark.createDataFrame([(x,) for x in answers], "value string").write.mode("overwrite").text(results)
        return run

    assert analysis.read_backfill_log(spark, f"{base}/log").count() == 0
    # a batch whose rows were written but not committed
    spark.createDataFrame([(9,)], "id long").write.parquet(f"{base}/log/batch=1")
    assert analysis.read_backfill_log(spark, f"{base}/log").count() == 0
    first = analysis.run_backfill(spark, pending, service([result_line(1), result_line(2), "cut"]), base, 1, stamp).first()
    assert (first.processed, first.failed, first.other) == (2, 1, 1)
    again = analysis.run_backfill(spark, pending, service([result_line(3)]), base, 1, stamp).first()
    assert again == first and asked == [3]                         # not asked for again
    assert values(analysis.read_backfill_log(spark, f"{base}/log")) == [1, 2]
    second = analysis.run_backfill(spark, pending, service([result_line(3), result_line(1, "automated")]), base, 2, stamp)
    assert second.first().processed == 2
    state = {r.id: r.email_type for r in fold.emails_state(analysis.read_backfill_log(spark, f"{base}/log")).collect()}
    assert state == {1: "automated", 2: "human", 3: "human"}


def test_due_mailboxes(spark):
    prefs = spark.createDataFrame([(0, "06:15"), (1, "9:30"), (2, "noon"), (3, None), (4, " 21 : 5 "), (0, "06:15")],
                                  "mailbox_id long, briefing_time string")
    runs = spark.createDataFrame([(0, "2024-02-01"), (2, "2024-01-31")], "mailbox_id long, date string")
    due = lambda h, m: values(briefing.due_mailboxes(prefs, runs, dt.datetime(2024, 2, 1, h, m)), "mailbox_id")
    assert due(6, 59) == [] and due(7, 0) == [2, 3] and due(9, 30) == [1, 2, 3] and due(21, 5) == [1, 2, 3, 4]
    assert briefing.due_mailboxes(prefs.limit(0), runs, dt.datetime(2024, 2, 1, 9)).count() == 0


def test_a_late_run_briefs_each_mailbox_once(spark, tmp_path):
    s, out = Store(spark, SF), str(tmp_path / "out")
    prefs = s.mailboxes.withColumn("briefing_time", F.when(F.col("mailbox_id") < 4, "08:00").otherwise("10:00"))
    now = s.consts["now"].replace(hour=9, minute=0, second=0, microsecond=0)
    early = briefing.scheduled_job(s.stored.folded, prefs, now, out)
    assert values(early, "mailbox_id") == [0, 1, 2, 3]
    late = briefing.scheduled_job(s.stored.folded, prefs, now.replace(hour=23), out)
    assert values(late, "mailbox_id") == [4, 5, 6, 7]
    assert briefing.scheduled_job(s.stored.folded, prefs, now.replace(hour=23, minute=30), out).count() == 0
    assert values(briefing.briefing_runs(spark, out), "mailbox_id") == list(range(8))
    text = spark.read.text(f"{out}/run=0900/date={now.date().isoformat()}")
    assert values(text.select("mailbox_id").distinct(), "mailbox_id") == [0, 1, 2, 3]
    next_day = briefing.scheduled_job(s.stored.folded, prefs, now + dt.timedelta(days=1), out)
    assert values(next_day, "mailbox_id") == [0, 1, 2, 3]
