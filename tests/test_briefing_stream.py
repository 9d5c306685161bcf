"""Briefing text assembly, the file sink, and streaming drain / restart."""

import datetime as dt
import glob
import os
import tempfile

from pyspark.sql import functions as F

from conftest import make_log
from mailfold.operators import briefing, fold, reads
from mailfold.streaming import ingest


def _text(lines, mailbox=0):
    rows = (lines.where(F.col("mailbox_id") == mailbox)
            .orderBy("section", "part", "k1", "k2").collect())
    return "\n".join(r["line"] for r in rows)


def _store(spark):
    log = make_log(spark, [
        {"id": 1, "subject": "Budget", "sender": "alice@x", "summary": "needs answer",
         "requires_reply": True, "deadline": "Submit by Friday"},
        {"id": 2, "subject": "News", "sender": "news@x", "email_type": "automated",
         "domain": "newsletter"},
    ]).withColumn("mailbox_id", F.lit(0).cast("long"))
    emails = fold.emails_state(log)
    return log, emails, fold.follow_ups_state(log, None), fold.deadlines_state(log, None)


def test_fallback_and_prompt_text(spark):
    log, emails, fu, dl = _store(spark)
    as_of = F.lit(dt.datetime(2026, 2, 27, 12, 0)).cast("timestamp_ntz")
    items = briefing.section_items(reads.needs_reply(emails, as_of, 24), fu, dl, emails)
    mbs = briefing.mailboxes_of(emails)
    counts = briefing.section_counts(items, mbs)
    today = F.lit("2026-02-27")
    text = _text(briefing.fallback_lines(items, counts, mbs, today))
    assert text == ("# Morning Briefing — 2026-02-27\n\n*(model unavailable — raw data)*\n\n"
                    "\n## Human emails needing reply (1)\n- Budget — alice@x"
                    "\n\n## Pending follow-ups (1)\n- Budget"
                    "\n\n## Open deadlines (1)\n- Submit by Friday")
    prompt = _text(briefing.prompt_lines(items, counts, mbs, today))
    assert "  - Budget (from alice@x): needs answer" in prompt
    assert "  - Budget (from alice@x, waiting since 2026-02-27)" in prompt
    assert "  - Submit by Friday (email: Budget)" in prompt
    empty = items.where(F.lit(False))
    none_prompt = _text(briefing.prompt_lines(empty, briefing.section_counts(empty, mbs), mbs,
                                              today))
    assert none_prompt.count("  None") == 3


def test_briefing_file_sink(spark):
    log, emails, fu, dl = _store(spark)
    as_of = F.lit(dt.datetime(2026, 2, 27, 12, 0)).cast("timestamp_ntz")
    items = briefing.section_items(reads.needs_reply(emails, as_of, 24), fu, dl, emails)
    mbs = briefing.mailboxes_of(emails)
    lines = briefing.with_front_matter(
        briefing.fallback_lines(items, briefing.section_counts(items, mbs), mbs, F.lit("2026-02-27")),
        mbs, F.lit("2026-02-27"), as_of)
    out = tempfile.mkdtemp(prefix="briefing-")
    for day in ("2026-02-26", "2026-02-27", "2026-02-27"):        # a rerun replaces its own day only
        briefing.write_briefings(lines, os.path.join(out, "b"), day, partitions=3)
    assert sorted(os.listdir(os.path.join(out, "b"))) == ["date=2026-02-26", "date=2026-02-27"]
    parts = sorted(glob.glob(os.path.join(out, "b", "date=2026-02-27", "mailbox_id=0", "part-*")))
    text = "".join(open(p).read() for p in parts)
    assert text.startswith("---\ndate: 2026-02-27\ngenerated_at: 2026-02-27T12:00:00+00:00\n---\n")
    assert text.rstrip("\n").endswith("- Submit by Friday")


def test_stream_dedup_drain_and_restart(spark):
    rows = []
    for i in range(40):
        rows.append({"id": i % 13, "processed_at": dt.datetime(2026, 1, 1) + dt.timedelta(days=i // 4)})
    log = make_log(spark, rows)
    base = tempfile.mkdtemp(prefix="stream-")
    src = os.path.join(base, "src")
    n = ingest.write_log_source(log, src, chunk_days=2)
    assert n == 5
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    processed, _ = ingest.run_dedup(spark, src, log.schema, out, ckpt, max_files=1)
    got = sorted((r["id"], r["seq"]) for r in processed.collect())
    want = sorted((r["id"], r["seq"]) for r in fold.first_writes(log, []).collect())
    assert got == want
    # restart from the same checkpoint: nothing new, nothing duplicated
    processed2, _ = ingest.run_dedup(spark, src, log.schema, out, ckpt, max_files=1)
    assert sorted((r["id"], r["seq"]) for r in processed2.collect()) == got


def test_incremental_state_and_compaction(spark):
    rows = [{"id": i % 7, "summary": f"s{i}", "sender": f"u{i % 3}@x", "requires_reply": i % 2 == 0,
             "deadline": [None, "", "friday"][i % 3], "date": None if i % 5 == 0 else f"2026-01-{i + 1:02d}",
             "processed_at": dt.datetime(2026, 1, 1) +
             dt.timedelta(days=i // 3)} for i in range(30)]
    log = make_log(spark, rows)
    base = tempfile.mkdtemp(prefix="state-")
    src = os.path.join(base, "src")
    ingest.write_log_source(log, src, chunk_days=3)
    state = ingest.run_state(spark, src, log.schema, os.path.join(base, "st"),
                             os.path.join(base, "ck"), max_files=1)
    want = sorted(tuple(r) for r in fold.emails_state(log).collect())
    assert sorted(tuple(r) for r in state.collect()) == want
    ingest.compact(spark, os.path.join(base, "st"), os.path.join(base, "st2"))
    for folder in ("st", "st2"):
        tables = ingest.current_tables(spark, os.path.join(base, folder))
        batch = {"emails": fold.emails_state(log), "contacts": fold.contacts_state(log),
                 "follow_ups": fold.follow_ups_state(log, None), "deadlines": fold.deadlines_state(log, None)}
        for name, table in tables.items():
            assert sorted(map(tuple, table.collect()), key=repr) == sorted(map(tuple, batch[name].collect()), key=repr)


def test_single_pass_equals_table_forms(spark):
    from mailfold.plans.context import Store
    s = Store(spark, "/root/testdata/sf0.001")
    generic = briefing.section_items(reads.needs_reply(s.emails, s.as_of, 24),
                                     reads.follow_ups_by_status(s.follow_ups, "pending"),
                                     s.deadlines.where(F.col("status") == "open"), s.emails)
    fast = briefing.briefing_inputs(s.folded, s.as_of, 24)[0]
    assert sorted(map(tuple, generic.collect())) == sorted(map(tuple, fast.collect()))
    st = reads.status_counts(s.emails, s.vector_index, s.follow_ups, s.deadlines, s.as_of)
    assert st.first().asDict() == reads.status_from_fold(s.folded, s.as_of).first().asDict()


def test_watermark_dedup_and_live_poller(spark):
    rows = [{"id": i % 5, "processed_at": dt.datetime(2026, 1, 1) + dt.timedelta(hours=i)}
            for i in range(20)]
    log = make_log(spark, rows)
    base = tempfile.mkdtemp(prefix="wm-")
    src = os.path.join(base, "src")
    ingest.write_log_source(log, src, chunk_days=1)
    # bounded-state form: all duplicates arrive within the delay -> exact here
    q = (ingest.watermark_dedup(ingest.log_stream(spark, src, log.schema, 1), "7 days")
         .writeStream.format("memory").queryName("wm_dedup").outputMode("append")
         .option("checkpointLocation", os.path.join(base, "ck1"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.sql("SELECT id FROM wm_dedup").collect()) == [0, 1, 2, 3, 4]
    # live poller: a processing-time trigger, stopped once the files are consumed
    q = ingest.start_poller(spark, src, log.schema, os.path.join(base, "out"),
                            os.path.join(base, "ck2"), interval="1 second", max_files=50)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(os.path.join(base, "out", "processed")).select("id", "seq")
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(5)]


def test_rule_analyzer(spark):
    from mailfold.operators import analysis
    mail = spark.createDataFrame([
        (1, "noreply@shop.example", "Your order shipped", "delivery soon", ""),
        (2, "bob@example.com", "Lunch?", "Can we meet by friday?", ""),
    ], "id long, sender string, subject string, body string, snippet string")
    out = {r["id"]: r for r in analysis.rule_analyzer(mail).collect()}
    assert out[1]["email_type"] == "automated" and out[1]["domain"] == "shopping"
    assert out[2]["email_type"] == "human" and out[2]["requires_reply"]
    assert out[2]["deadline"] == "by friday" and out[2]["domain"] is None


def _stream_log(spark, n=12, ids=6):
    return make_log(spark, [{"id": i % ids, "processed_at": dt.datetime(2026, 1, 1) + dt.timedelta(hours=i)}
                            for i in range(n)])


def test_replayed_batch_keeps_its_mail(spark):
    log = _stream_log(spark)
    out = tempfile.mkdtemp(prefix="replay-")
    ingest.write_seed(spark, out, log.schema)
    handle = ingest._batch_handler(spark, out)
    count = lambda t: spark.read.parquet(os.path.join(out, t)).count()
    handle(log.where("seq < 6"), 0)
    handle(log.where("seq >= 3"), 1)
    first = (count("processed"), count("seen"))
    for batch_id, rows in ((0, "seq < 6"), (1, "seq >= 3")):      # each batch again, as after a crash
        handle(log.where(rows), batch_id)
        assert (count("processed"), count("seen")) == first == (6, 6)


def test_crash_between_seen_and_commit(spark):
    log = _stream_log(spark)
    out = tempfile.mkdtemp(prefix="crash-")
    ingest.write_seed(spark, out, log.schema)

    def fail(new):
        raise RuntimeError("process is down")
    try:
        ingest._batch_handler(spark, out, fail)(log, 0)
    except RuntimeError:
        pass
    ingest._batch_handler(spark, out)(log, 0)
    assert spark.read.parquet(os.path.join(out, "processed")).count() == 6


def test_restart_keeps_the_seed(spark):
    log = _stream_log(spark)
    base = tempfile.mkdtemp(prefix="seed-")
    src, out, ckpt = (os.path.join(base, x) for x in ("src", "out", "ckpt"))
    log.where("seq < 3").write.parquet(src)
    seed = spark.createDataFrame([(5,)], "id long")
    ingest.run_dedup(spark, src, log.schema, out, ckpt, seed_ids=seed)
    log.where("seq >= 3").write.mode("append").parquet(src)
    processed, _ = ingest.run_dedup(spark, src, log.schema, out, ckpt)       # no seed this time
    assert sorted(r["id"] for r in processed.select("id").collect()) == [0, 1, 2, 3, 4]


def test_one_failing_message_does_not_stop_the_others(spark):
    log = _stream_log(spark)
    base = tempfile.mkdtemp(prefix="fail-")
    src, out, ckpt = (os.path.join(base, x) for x in ("src", "out", "ckpt"))
    log.write.parquet(src)

    def work(message):
        if message["id"] == 3:
            raise ValueError("bad mail")
        return {"id": message["id"], "size": len(message["body"])}
    ok, bad = ingest.run_dedup(spark, src, log.schema, out, ckpt,
                               process=ingest.per_message(work, "id long, size long"), max_files=50)
    assert sorted(r["id"] for r in ok.collect()) == [0, 1, 2, 4, 5]
    assert [(r["id"], r["reason"]) for r in bad.collect()] == [(3, "ValueError: bad mail")]


def test_a_chunk_of_several_files_arrives_whole(spark):
    """Each chunk has exactly the files asked for, by parallel tasks; batches of whole chunks keep the order."""
    rows = [{"id": i % 11, "processed_at": dt.datetime(2026, 1, 1) + dt.timedelta(days=0 if i < 90 else 6, minutes=i)}
            for i in range(93)]
    log = make_log(spark, rows).repartition(5)
    base = tempfile.mkdtemp(prefix="chunks-")
    src = os.path.join(base, "src")
    assert ingest.files_per_chunk(log, chunk_days=2, file_rows=30) == 3
    assert ingest.write_log_source(log, src, chunk_days=2, files=3) == 4           # two chunks have no rows
    files = sorted(glob.glob(os.path.join(src, "part-*.parquet")), key=os.path.getmtime)
    sizes = [spark.read.parquet(f).count() for f in files]
    assert len(files) == 12 and sum(sizes) == 93 and sum(n > 0 for n in sizes[:3]) > 1
    assert sum(sizes[:3]) == 90 and sum(sizes[3:9]) == 0
    processed, _ = ingest.run_dedup(spark, src, log.schema, os.path.join(base, "out"), os.path.join(base, "ck"), max_files=3)
    assert sorted((r.id, r.seq) for r in processed.collect()) == [(i, i) for i in range(11)]


def test_stream_ingest_keeps_the_log_on_disk_once(spark):
    from mailfold.plans.queries import QUERIES
    top = spark.conf.get("spark.checkpoint.dir")
    there = set(os.listdir(top))
    before = {key: spark.conf.get(key, None) for key in ingest.STAGING_CONF}
    out = QUERIES["stream_ingest"](spark, "/root/testdata/sf0.001")
    assert {key: spark.conf.get(key, None) for key in ingest.STAGING_CONF} == before
    base = next(os.path.join(top, d) for d in set(os.listdir(top)) - there if d.startswith("stream-"))
    rows = lambda path: spark.read.schema(out.schema).parquet(path).count()
    last = max(os.listdir(os.path.join(base, "sink")), key=lambda d: int(d.split("=")[1]))
    assert last != "batch=0"
    assert rows(os.path.join(base, "source_staging")) == 0                          # copied chunks are gone,
    assert rows(os.path.join(base, "source")) <= rows(os.path.join(base, "sink", last)) < out.count()  # consumed ones too


def test_source_staged_in_passes_and_writes_without_a_time(spark, monkeypatch):
    monkeypatch.setattr(ingest, "PASS_ROWS", 10)
    days = [0, 0, 3, 3, 9, None]
    log = make_log(spark, [{"id": i % 7, "processed_at": None if days[i % 6] is None else
                            dt.datetime(2026, 1, 1) + dt.timedelta(days=days[i % 6])} for i in range(60)])
    assert ingest.count_chunks(log, 2) == (20454, {0: 20, 1: 20, 4: 20})
    for name, part, chunks in (("all", log, 5), ("timeless", log.where("processed_at is null"), 1)):
        base = tempfile.mkdtemp(prefix="passes-")
        src = os.path.join(base, "src")
        assert ingest.write_log_source(part, src, chunk_days=2, files=2) == chunks
        assert len(glob.glob(os.path.join(src, "*.parquet"))) == 2 * chunks
        got = ingest.run_ingest(spark, src, log.schema, os.path.join(base, "sink"), os.path.join(base, "ck"), max_files=4)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, part.collect()), key=repr), name
