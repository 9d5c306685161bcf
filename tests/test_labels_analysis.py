"""Label rules, label state and batch-result parsing."""

import json

from pyspark.sql import functions as F

from mailfold.operators import analysis, labels


def test_label_rules(spark):
    df = spark.createDataFrame([
        (1, 0, "human", None, True), (2, 0, "human", None, False),
        (3, 0, "automated", "finance", True), (4, 0, "automated", None, False),
        (5, 0, "automated", "bogus", False),
    ], "id long, mailbox_id long, email_type string, domain string, requires_reply boolean")
    got = sorted((r["email_id"], r["label"]) for r in labels.labels_for(df).collect())
    assert got == [(1, "AI/Human"), (1, "AI/Human/FollowUp"), (2, "AI/Human"),
                   (3, "AI/Automated/Finance"), (4, "AI/Automated/Other"),
                   (5, "AI/Automated/Other")]


def test_label_state_last_action_wins(spark):
    ev = spark.createDataFrame([
        (1, 0, 0, "AI/Human", "add"), (1, 1, 0, "AI/Human", "remove"),
        (1, 2, 0, "STARRED", "add"), (2, 3, 0, "AI/Human", "add"),
    ], "email_id long, seq long, mailbox_id long, label string, action string")
    got = sorted((r["email_id"], r["label"]) for r in labels.current_labels(ev).collect())
    assert got == [(1, "STARRED"), (2, "AI/Human")]


def test_missing_labels_parents_first(spark):
    mb = spark.createDataFrame([(0,)], "mailbox_id long")
    have = spark.createDataFrame([(0, "AI"), (0, "AI/Human")], "mailbox_id long, label string")
    got = [r["label"] for r in labels.missing_labels(mb, have).collect()]
    assert got[:2] == ["AI/Automated", "AI/Human/FollowUp"]
    assert len(got) == 14 and "AI" not in got


def _line(cid, typ, blocks):
    msg = {"stop_reason": "tool_use", "content": blocks} if typ == "succeeded" else None
    return json.dumps({"custom_id": cid, "result": {"type": typ, "message": msg}})


def test_apply_results(spark):
    tool = {"type": "tool_use", "name": "record_email_analysis"}
    lines = [
        _line("1", "succeeded", [{"type": "text"}, dict(tool, input={
            "email_type": "human", "domain": None, "entities": ["A"], "summary": "s",
            "requires_reply": True, "deadline": ""})]),
        _line("2", "succeeded", [dict(tool, input={"email_type": "automated", "domain": "nope"})]),
        _line("3", "succeeded", [{"type": "tool_use", "name": "other", "input": {}}]),
        _line("4", "errored", []),
        _line("9", "succeeded", [dict(tool, input={"email_type": "human"})]),
        '{"custom_id": "5", "result": ',            # truncated line: not JSON
    ]
    results = spark.createDataFrame([(x,) for x in lines], "value string")
    pending = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    out = {r["custom_id"]: r for r in analysis.apply_results(results, pending).collect()}
    assert out["1"]["outcome"] == "processed"
    a = out["1"]["analysis"]
    assert a["deadline"] is None and a["entities"] == ["A"] and a["requires_reply"] is True
    assert out["2"]["reason"] == "invalid_analysis"
    assert out["3"]["reason"] == "no_tool_call"
    assert out["4"]["reason"] == "not_succeeded"
    assert out["9"]["reason"] == "unknown_id"
    assert out[None]["reason"] == "malformed_result"
    counts = analysis.batch_outcomes(analysis.apply_results(results, pending)).first()
    assert (counts["succeeded"], counts["errored"], counts["other"], counts["processed"],
            counts["failed"]) == (4, 1, 1, 1, 5)


def test_parse_defaults(spark):
    df = spark.createDataFrame([('{"email_type": "human"}',)], "j string")
    a = df.select(analysis.parse_analysis(
        F.from_json("j", "email_type string, domain string, entities array<string>, "
                         "summary string, requires_reply boolean, deadline string")).alias("a")
                  ).first()["a"]
    assert (a["summary"], a["requires_reply"], a["entities"], a["deadline"], a["valid"]) == \
           ("", False, [], None, True)


def test_batch_requests_are_json(spark):
    mail = spark.createDataFrame([(7, "a@b", "Hi", "x" * 5000, None, None, "snip")],
                                 "id long, sender string, subject string, body string, "
                                 "recipient string, date string, snippet string")
    req = json.loads(analysis.build_requests(mail).first()["request"])
    assert req["custom_id"] == "7"
    assert req["params"]["tools"][0]["name"] == "record_email_analysis"
    content = req["params"]["messages"][0]["content"]
    assert content.endswith("\n[… email truncated …]")
    assert "x" * 4000 in content and "x" * 4001 not in content


def test_backfill_jobs_roundtrip(spark, tmp_path):
    from mailfold.operators import fold
    from mailfold.plans.context import Store
    s = Store(spark, "/root/testdata/sf0.001")
    pending = s.messages.where(F.col("id") % 10 != 3)      # the new mail of a backfill
    req = str(tmp_path / "requests")
    analysis.prepare_backfill(pending, req)
    first = json.loads(spark.read.text(req).first()["value"])
    assert first["params"]["tool_choice"]["name"] == "record_email_analysis"
    res = str(tmp_path / "results")
    s.result_lines.write.mode("overwrite").text(res)
    parsed = analysis.read_result_file(spark, res)
    assert parsed.count() == s.table("labels").count()
    log, dead = str(tmp_path / "log"), str(tmp_path / "dead")
    stamp = F.lit("2024-02-01 07:00:00").cast("timestamp_ntz")
    counts = analysis.apply_backfill(spark, res, pending, 1, log, dead, stamp).first()
    written = spark.read.parquet(log)
    assert written.count() == counts["processed"]
    assert {r[0] for r in written.select("processed_at").distinct().collect()} == \
           {__import__("datetime").datetime(2024, 2, 1, 7, 0)}
    assert spark.read.parquet(dead).count() == counts["failed"]
    # the appended writes fold like any other log
    state = fold.emails_state(written.drop("batch"))
    assert state.count() == counts["processed"]
    assert set(r["email_type"] for r in state.collect()) <= {"human", "automated"}


def test_backfill_seq_over_many_partitions(spark, tmp_path):
    import json as js
    n = 300
    pending = spark.createDataFrame(
        [(i, 0, "t", "a@x", "s", "p", "b", "2026-01-01") for i in range(n)],
        "id long, mailbox_id long, thread_id string, sender string, subject string, snippet string, "
        "body string, date string")

    def line(i, summary):
        return js.dumps({"custom_id": str(i), "result": {"type": "succeeded", "message": {
            "stop_reason": "tool_use", "content": [{"type": "tool_use", "name": analysis.ANALYSIS_TOOL_NAME, "input": {
                "email_type": "human", "domain": None, "entities": [], "summary": summary,
                "requires_reply": True, "deadline": None}}]}}})
    logs = []
    for run in range(2):
        for batch in (1, 2):
            res = str(tmp_path / f"res{run}{batch}")
            lines = [(line(i, f"batch {batch}"),) for i in range(n)]
            spark.createDataFrame(lines, "value string").repartition(200).write.text(res)
            counts = analysis.apply_backfill(spark, res, pending, batch, str(tmp_path / f"log{run}"),
                                             str(tmp_path / f"dead{run}")).first()
            assert counts["processed"] == n
        logs.append(spark.read.parquet(str(tmp_path / f"log{run}")))
    seqs = [sorted((r["seq"], r["id"]) for r in log.select("seq", "id").collect()) for log in logs]
    assert seqs[0] == seqs[1] and len({s for s, _ in seqs[0]}) == 2 * n
    assert max(s for s, _ in seqs[0][:n]) < min(s for s, _ in seqs[0][n:])
    from mailfold.operators import fold
    state = fold.emails_state(logs[0].drop("batch"))
    assert {r["summary"] for r in state.collect()} == {"batch 2"}
