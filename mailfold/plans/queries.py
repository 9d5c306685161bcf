"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Spark derives from them) in full; the only limits are the operators' own
(top-n search, page caps of the mail source).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.agg import ordered_listagg
from ..functions.text import html_exact, html_native, nonempty, prompt_text, strip_recipient
from ..operators import analysis, briefing, codes, fold, labels, parse, reads, search, store
from ..session import shared_dir
from ..sources import mailbox
from ..sources.tables import spread
from .context import BACKFILL_DAYS, BRIEFING_TIMES, Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(*names: str):
    def wrap(fn):
        for name in names:
            QUERIES[name] = (lambda f: lambda spark, sf_dir: f(Store(spark, sf_dir)))(fn)
        return fn
    return wrap


def _flat_metadata(col: str = "metadata") -> list:
    return [F.col(f"{col}.{f}").alias(f) for f in search.METADATA_FIELDS]


# --------------------------------------------------------------------------
# 2.1 sources
# --------------------------------------------------------------------------

@query("scan_unread_ids")
def _s1(s: Store):
    return mailbox.scan_unread_ids(s.messages)


@query("scan_unread_content", "capped_fetch")
def _s2(s: Store):
    return mailbox.scan_unread_content(s.messages)


@query("scan_since_days")
def _s3(s: Store):
    return mailbox.scan_since_days(s.messages, s.as_of, BACKFILL_DAYS)


@query("email_lookup")
def _s4(s: Store):
    return mailbox.email_lookup(mailbox.messages_from_partial(s.stored.of_id(42)), 42)


@query("full_table_scan")
def _s5(s: Store):
    return reads.all_emails(s.emails)


@query("batch_results_source")
def _s6(s: Store):
    r = analysis.read_result_file(s.spark, s.result_file).where(F.col("bad_line").isNull())
    return r.select("custom_id", "result_type",
                    F.when(F.col("content").isNotNull(), F.size("content")).cast("bigint")
                    .alias("n_blocks"))


@query("batch_results_rejects")
def _s6r(s: Store):
    """The lines of the result file that are no records, with their text."""
    applied = analysis.apply_results(s.spark.read.text(s.result_file), s.emails_dangling)
    return analysis.analysis_failures(applied).where(F.col("reason") == "malformed_result")


# --------------------------------------------------------------------------
# 2.2 parsing
# --------------------------------------------------------------------------

@query("parse_text_messages")
def _p1(s: Store):
    return parse.parse_text_messages(parse.render_text_payloads(s.messages))


@query("parse_json_messages")
def _p2(s: Store):
    return parse.parse_json_messages(parse.render_json_messages(s.messages))


@query("parse_search_ids")
def _p3(s: Store):
    out = parse.parse_search_ids(parse.render_search_payloads(s.messages))
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("parse_label_list")
def _p4(s: Store):
    catalog = labels.label_catalog(s.label_events)
    return parse.parse_label_list(parse.render_label_listing(catalog))


@query("detect_payload_kind")
def _p5(s: Store):
    p = parse.render_search_payloads(s.messages)
    return p.select("mailbox_id", "page", parse.payload_kind(F.col("payload")).alias("kind"))


@query("strip_recipient")
def _p6(s: Store):
    wrapped = F.concat(F.lit("<"), F.col("recipient"), F.lit(">"))
    return s.messages.select("id", strip_recipient(wrapped).alias("recipient"))


@query("html_to_text")
def _p7(s: Store):
    return s.table("pages").select("page_id", html_native("html").alias("text"))


@query("html_to_text_exact")
def _p7x(s: Store):
    return s.table("pages").select("page_id", html_exact("html").alias("text"))


# --------------------------------------------------------------------------
# 2.3 projections
# --------------------------------------------------------------------------

@query("build_prompt")
def _j1(s: Store):
    return s.messages.select("id", prompt_text().alias("prompt"))


@query("build_batch_requests")
def _j2(s: Store):
    return analysis.build_requests(s.messages)


@query("batch_request_fields")
def _j2f(s: Store):
    """J2 read back: the fields of every request line."""
    field = lambda path: F.get_json_object("request", path)
    return analysis.build_requests(s.messages).select(
        "id", field("$.custom_id").alias("custom_id"), field("$.params.model").alias("model"),
        field("$.params.max_tokens").cast("int").alias("max_tokens"),
        field("$.params.tools[0].name").alias("tool"),
        field("$.params.tool_choice.name").alias("tool_choice"),
        field("$.params.messages[0].role").alias("role"),
        field("$.params.messages[0].content").alias("content"))


@query("parse_analysis")
def _j3(s: Store):
    r = analysis.parsed_results(s.result_lines).where(F.col("block").isNotNull())
    return r.select("custom_id", "analysis.*")


@query("select_tool_block")
def _j4(s: Store):
    r = analysis.select_tool_block(analysis.read_results(s.result_lines))
    return r.select("custom_id", "result_type", F.col("block.name").alias("block_name"))


@query("build_document")
def _j5(s: Store):
    return s.emails.select("id", search.document_text().alias("document"))


@query("build_metadata")
def _j6(s: Store):
    return s.emails.select("id", search.metadata().alias("m")).select("id", *_flat_metadata("m"))


@query("assign_labels")
def _j7(s: Store):
    return labels.labels_for(s.emails)


@query("email_record")
def _j8(s: Store):
    return reads.email_record(s.emails)


@query("reindex_projection")
def _j9(s: Store):
    return s.emails.select("id", "thread_id", "sender", "subject", "snippet", "body", "date",
                           "email_type", "domain", reads.parse_entities().alias("entities"),
                           "summary", "requires_reply", "deadline")


@query("search_display")
def _j10(s: Store):
    hits = search.vector_search(s.stored.vectors, s.query_text, 10)
    j = hits.join(s.stored.vectors, "id")
    m = F.col("metadata")
    return j.select(
        "rank", m["subject"].alias("subject"), m["sender"].alias("sender"),
        F.substring(m["date"], 1, 10).alias("date"), m["email_type"].alias("email_type"),
        m["domain"].alias("domain"),
        F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance")), 2).alias("score"))


# --------------------------------------------------------------------------
# 2.4 filters
# --------------------------------------------------------------------------

@query("needs_reply")
def _f1(s: Store):
    return reads.needs_reply(store.recent(s.stored.emails, s.as_of, hours=24), s.as_of, 24)


@query("needs_reply_240h", "order_newest")
def _f1b(s: Store):
    return reads.needs_reply(store.recent(s.stored.emails, s.as_of, hours=240), s.as_of, 240)


@query("needs_reply_snapshot")
def _f1s(s: Store):
    """F1 over a day-partitioned state snapshot (partition pruning on the look-back)."""
    import os
    from ..operators import snapshot
    from ..streaming.ingest import scratch
    out = os.path.join(scratch(s.spark, "snapshot"), "emails")
    snapshot.write_emails_snapshot(s.emails, out)
    return snapshot.needs_reply_from_snapshot(s.spark, out, s.as_of, 24)


@query("stored_ids_since", "distinct_ids")
def _f2(s: Store):
    emails = store.recent(s.stored.emails, s.as_of, days=BACKFILL_DAYS)
    return reads.stored_ids_since(emails, s.as_of, BACKFILL_DAYS)


@query("follow_ups_by_status")
def _f3(s: Store):
    return reads.follow_ups_by_status(s.stored.follow_ups, "pending")


@query("open_deadlines_raw", "order_oldest")
def _f4(s: Store):
    return reads.open_deadlines_raw(s.stored.deadlines)


@query("email_by_id", "email")
def _f5(s: Store):
    return reads.email_record(reads.email_by_id(fold.emails_from_partial(s.stored.of_id(42)), 42))


@query("contact_by_address", "contact")
def _f6(s: Store):
    return reads.contact_by_address(s.stored.contacts, "u7@example.com")


@query("metadata_where")
def _f7(s: Store):
    idx = s.stored.vectors.select("id", "metadata.*")
    cond = search.metadata_where({"email_type": "human", "requires_reply": True})
    return idx.where(cond).select("id", "sender", "subject")


@query("valid_analysis")
def _f8(s: Store):
    r = analysis.parsed_results(s.result_lines).where(F.col("block").isNotNull())
    return r.select("custom_id", F.col("analysis.valid").alias("valid"))


# --------------------------------------------------------------------------
# 2.5 joins
# --------------------------------------------------------------------------

@query("new_emails_antijoin")
def _k1(s: Store):
    return reads.new_emails_antijoin(s.fetched, s.stored_ids_before)


@query("poll_antijoin")
def _k2(s: Store):
    ids = mailbox.scan_unread_ids(s.messages, 50)
    new_ids = ids.join(s.stored_ids_before, "id", "left_anti")
    return s.messages.join(new_ids, ["mailbox_id", "id"], "left_semi").select(
        *mailbox.MESSAGE_COLUMNS)


@query("batch_result_join")
def _k3(s: Store):
    return s.applied.select("custom_id", "result_type", "outcome", "reason")


def _topic_hits(s: Store, n: int = 10):
    return search.vector_search(s.stored.vectors, s.query_text, n)


@query("topic_emails", "emails_for_topic")
def _k4(s: Store):
    hits = _topic_hits(s)
    emails = _stored_dangling(s)
    return (hits.join(emails, "id", "inner")
            .orderBy("rank").select("rank", "distance", *emails.columns))


def _stored_dangling(s: Store) -> DataFrame:
    return s.stored.emails.drop("processed_day").where(F.col("id") % 10 != 3)


def _flat_enriched(df: DataFrame, name: str) -> DataFrame:
    first = [F.col(f"{name}.{c}").alias(c) for c in df.schema[name].dataType.fieldNames()]
    email = [F.col(f"email.{c}").alias(f"mail_{c}") for c in
             ("id", "subject", "sender", "entities", "processed_at")]
    return df.select(*first, *email)


@query("pending_followups")
def _k5(s: Store):
    return _flat_enriched(reads.pending_followups(s.stored.follow_ups, _stored_dangling(s)), "follow_up")


@query("open_deadlines")
def _k6(s: Store):
    return _flat_enriched(reads.open_deadlines(s.stored.deadlines, _stored_dangling(s)), "deadline")


@query("missing_labels")
def _k7(s: Store):
    return labels.missing_labels(s.mailboxes, s.current_labels)


@query("resolve_label_ids")
def _k8(s: Store):
    catalog = labels.label_catalog(labels.label_events(s.log_before))
    wanted = labels.labels_for(s.log_after).select("mailbox_id", "label").distinct()
    return labels.resolve_label_ids(wanted, catalog)


# --------------------------------------------------------------------------
# 2.6 aggregations
# --------------------------------------------------------------------------

@query("email_count")
def _a1(s: Store):
    return s.stored.emails.agg(F.count(F.lit(1)).alias("email_count"))


@query("vector_count")
def _a2(s: Store):
    return s.stored.vectors.agg(F.count(F.lit(1)).alias("vector_count"))


@query("contact_stats", "contacts_state")
def _a3(s: Store):
    return s.contacts


@query("status_counts", "status")
def _a4(s: Store):
    t = s.stored
    return reads.status_counts(t.emails, t.vectors, t.follow_ups, t.deadlines, s.as_of)


@query("batch_outcomes", "backfill_apply_counts")
def _a5(s: Store):
    return analysis.batch_outcomes(s.applied)


def _briefing_parts(s: Store):
    return briefing.briefing_inputs(s.stored.folded, s.as_of, 24)


@query("briefing_sections")
def _a6(s: Store):
    return _briefing_parts(s)[2]


def _mail_hits(s: Store, n: int = 10) -> DataFrame:
    """Every benchmark passage against the stored mail vectors."""
    queries = search.corpus_tokens(s.table("benchmark"), "item_id", "text")
    return search.tiled_search(s.stored.vectors.select("id", "vec"), search.query_vectors(queries), n)


@query("briefing_items")
def _a6i(s: Store):
    """The mails, follow-ups and deadlines that the sections list."""
    return _briefing_parts(s)[0]


@query("rule_analysis")
def _x5(s: Store):
    """The offline analyser over every mail."""
    return analysis.rule_analyzer(s.messages)


@query("topic_context", "topic_status_context")
def _a7(s: Store):
    """Q9 for every benchmark passage: its ten nearest mails, joined in rank order."""
    hits = _mail_hits(s)
    e = _stored_dangling(s)
    body = F.coalesce(nonempty("body"), F.col("snippet"))
    block = F.concat(F.lit("From: "), F.col("sender"), F.lit("\nDate: "),
                     F.coalesce(F.col("date"), F.lit("unknown")), F.lit("\nSubject: "),
                     F.col("subject"), F.lit("\n\n"), body)
    rows = hits.join(e, "id").select("qid", "rank", block.alias("block"))
    return rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n_emails"),
                                   ordered_listagg("block", "\n\n---\n\n", "rank").alias("context"))


@query("thread_context")
def _a7t(s: Store):
    """A7 on conversation threads (FIXTURES: conversations ordered by turn)."""
    return search.thread_context(s.table("conversations"))


# --------------------------------------------------------------------------
# 2.7 window-style
# --------------------------------------------------------------------------

@query("latest_analysis")
def _n1(s: Store):
    """N1 from the shared fold (``fold.latest_analysis`` is the same over any log)."""
    return s.folded.select("id", *[F.col(f"last.{c}").alias(c) for c in
                                   ("email_type", "domain", "summary", "requires_reply",
                                    "deadline", "entities")])


@query("first_raw")
def _n2(s: Store):
    """N2 from the shared fold (``fold.first_raw`` is the same over any log)."""
    e = s.emails
    return e.select("id", "mailbox_id", "thread_id", "sender", "subject", "snippet", "body",
                    "date", "processed_at")


@query("first_seen_rows")
def _n3(s: Store):
    """N3 from the shared fold (``fold.first_writes`` is the same over any log)."""
    f = F.col("first")
    return s.folded.select("id", f["seq"].alias("seq"),
                           f["requires_reply"].alias("requires_reply"),
                           f["deadline"].alias("deadline"),
                           f["processed_at"].alias("processed_at"))


@query("surrogate_ids")
def _n4(s: Store):
    return fold.dense_ordinals(s.follow_ups.select("id", "email_id"), "id")


@query("hit_rank", "batch_search_mail")
def _n5(s: Store):
    return _mail_hits(s)


# --------------------------------------------------------------------------
# 2.8 top-k
# --------------------------------------------------------------------------

@query("cosine_topk", "topk_search")
def _v3(s: Store):
    return search.vector_search(s.document_vectors, s.query_text, 10)


# --------------------------------------------------------------------------
# 2.9 set operations
# --------------------------------------------------------------------------

@query("id_difference")
def _u1(s: Store):
    return s.fetched.select("id").exceptAll(s.stored_ids_before)


@query("seen_union")
def _u2(s: Store):
    return s.stored_ids_before.union(s.fetched.select("id")).distinct()


# --------------------------------------------------------------------------
# 2.10 vectors
# --------------------------------------------------------------------------

@query("hash_embed")
def _v1(s: Store):
    cells = search.hash_embed_cells(s.table("documents"), "doc_id", "text")
    return cells.select("id", "idx", "cnt", F.round("weight", 6).alias("weight"))


@query("embed_udf")
def _v2(s: Store):
    emb = search.embed_udf()
    docs = spread(s.table("documents").select("doc_id", "text"))
    return docs.select("doc_id", emb(F.lower("text")).alias("embedding"))


@query("embed_udf_cells")
def _v2c(s: Store):
    """V2: the non-zero coordinates of the pluggable embedding, run per document."""
    emb = search.embed_udf(element="double")
    docs = spread(s.table("documents").select(F.col("doc_id").alias("id"), "text"))
    vectors = docs.select("id", emb(F.lower("text")).alias("vec"))
    cells = vectors.select("id", F.posexplode("vec").alias("idx", "weight"))
    return cells.where("weight <> 0").select("id", "idx", F.round("weight", 6).alias("weight"))


@query("cosine_topk_dense")
def _v3d(s: Store):
    return search.dense_search(s.table("embeddings"), s.query_vector, 10)


@query("cosine_topk_filtered")
def _v4(s: Store):
    return search.dense_search(s.table("embeddings"), s.query_vector, 10, where={"label": 3})


@query("lsh_search")
def _v9(s: Store):
    index = s._once("lsh", lambda: search.lsh_index(s.table("embeddings")))
    return search.lsh_search(index, s.query_vector, 10)


@query("code_search")
def _v9c(s: Store):
    """V9 over compact codes: what is scanned is a sixteenth of the vectors."""
    index = s._once("codes", lambda: codes.code_index(s.table("embeddings")))
    return codes.code_search(index, s.query_vector, 10)


@query("batch_search")
def _v5(s: Store):
    queries = search.corpus_tokens(s.table("benchmark"), "item_id", "text")
    return search.tiled_search(s.document_vectors, search.query_vectors(queries), 10)


@query("vector_upsert")
def _v6(s: Store):
    return s.vector_index.select("id", "document", *_flat_metadata())


@query("reindex")
def _v7(s: Store):
    return search.reindex(s.emails).select("id", "document", *_flat_metadata())


@query("search_tool", "search")
def _v8(s: Store):
    hits = _topic_hits(s)
    return (hits.join(s.stored.vectors, "id")
            .select(F.col("id").alias("email_id"), "distance", *_flat_metadata()))


@query("search_filtered")
def _v4t(s: Store):
    """V4 on text: the search of one mailbox's human mail (filter first, then rank)."""
    where = s.stored.of_mailbox(3) & search.metadata_where({"metadata.email_type": "human"})
    hits = search.vector_search(s.stored.vectors, s.query_text, 10, where)
    return (hits.join(s.stored.vectors.where(where), "id")
            .select(F.col("id").alias("email_id"), "distance", "rank", "mailbox_id", *_flat_metadata()))


@query("stored_vectors")
def _v6s(s: Store):
    """V6 / V7 as stored: the non-zero coordinates of every mail's vector."""
    cells = s.stored.vectors.select("id", F.posexplode("vec").alias("idx", "weight"))
    return cells.where("weight <> 0").select("id", "idx", F.round("weight", 6).alias("weight"))


# --------------------------------------------------------------------------
# 2.11 sinks / derived state
# --------------------------------------------------------------------------

@query("emails_state")
def _d1(s: Store):
    return s.emails


@query("follow_ups_state")
def _d3(s: Store):
    return s.follow_ups


@query("deadlines_state")
def _d4(s: Store):
    return s.deadlines


@query("emails_state_log")
def _d1g(s: Store):
    """D1 by the general fold, over a log that carries its content."""
    return fold.emails_state(s.log)


@query("contacts_state_log")
def _d2g(s: Store):
    return fold.contacts_state(s.log)


@query("follow_ups_state_log")
def _d3g(s: Store):
    return fold.follow_ups_state(s.log)


@query("deadlines_state_log")
def _d4g(s: Store):
    return fold.deadlines_state(s.log)


@query("latest_analysis_log")
def _n1g(s: Store):
    return fold.latest_analysis(s.log).select(
        "id", "email_type", "domain", "summary", "requires_reply", "deadline", "entities")


@query("first_raw_log")
def _n2g(s: Store):
    return fold.first_raw(s.log).select("id", "mailbox_id", "thread_id", "sender", "subject", "snippet", "body",
                                        "date", "processed_at")


@query("first_seen_rows_log")
def _n3g(s: Store):
    return fold.first_writes(s.log, ["requires_reply", "deadline", "processed_at"])


@query("reindex_vectors")
def _v7w(s: Store):
    """V7 / Q13 as a job: embed every stored mail, publish the version, read what is current."""
    def run():
        table = store.vector_table(s.spark, shared_dir(s.spark, "reindex"))
        store.reindex(s.emails, table)
        return table
    cells = s._once("reindex", run).current().select("id", F.posexplode("vec").alias("idx", "weight"))
    return cells.where("weight <> 0").select("id", "idx", F.round("weight", 6).alias("weight"))


@query("fanout_retry")
def _d5r(s: Store):
    """D5 run twice on one batch: the sink that failed at first is the one that the second run writes."""
    base = shared_dir(s.spark, "sinks")
    sinks = {"labels": s.label_events, "contacts": s.contacts, "follow_ups": s.follow_ups, "deadlines": s.deadlines}
    down = s.contacts.withColumn("total_emails", F.raise_error(F.lit("sink is down")).cast("bigint"))
    store.fan_out(s.spark, {**sinks, "contacts": down}, base)
    return store.fan_out(s.spark, sinks, base).select("sink", "n", "written")


@query("fanout")
def _d5(s: Store):
    """Every sink written from the log, a failing one on its own (rows per sink)."""
    sinks = {"labels": s.label_events, "vectors": s.vector_index, "emails": s.emails,
             "contacts": s.contacts, "follow_ups": s.follow_ups, "deadlines": s.deadlines}
    return store.fan_out(s.spark, sinks).select("sink", "n")


@query("label_events")
def _d6(s: Store):
    return s.current_labels


@query("briefing_file")
def _d7(s: Store):
    items, mailboxes, counts = _briefing_parts(s)
    lines = briefing.fallback_lines(items, counts, mailboxes, s.today)
    return briefing.with_front_matter(lines, mailboxes, s.today, s.as_of)


@query("briefing_written")
def _d7w(s: Store):
    """D7 as written: the lines of every mailbox's file, read back."""
    items, mailboxes, counts = _briefing_parts(s)
    day = s.consts["now"].date().isoformat() if s.consts["now"] else "none"
    lines = briefing.with_front_matter(briefing.fallback_lines(items, counts, mailboxes, s.today),
                                       mailboxes, s.today, s.as_of)
    path = briefing.write_briefings(lines, shared_dir(s.spark, "briefing-files"), day)
    return s.spark.read.schema("value string, mailbox_id long").text(path).select("mailbox_id", F.col("value").alias("line"))


@query("analysis_failures")
def _d8(s: Store):
    return analysis.analysis_failures(s.applied)


# --------------------------------------------------------------------------
# 2.14 read API
# --------------------------------------------------------------------------

@query("briefing_prompt")
def _q10(s: Store):
    items, mailboxes, counts = _briefing_parts(s)
    return briefing.prompt_lines(items, counts, mailboxes, s.today)


@query("daily_briefing_job")
def _w6(s: Store):
    day = s.consts["now"].date().isoformat() if s.consts["now"] else "none"
    return briefing.daily_job(s.stored.folded, s.as_of, day, shared_dir(s.spark, "briefings"))


@query("briefing_schedule")
def _w6s(s: Store):
    """W6 by preference: three runs of a day over the current state, and who got a briefing when."""
    now = s.consts["now"]
    out = shared_dir(s.spark, "scheduled")
    wanted = F.element_at(F.array(*(F.lit(t) for t in BRIEFING_TIMES)), (F.col("mailbox_id") % 4 + 1).cast("int"))
    prefs = s.mailboxes.select("mailbox_id", wanted.alias("briefing_time"))
    for hour, minute in ((7, 30), (12, 0), (23, 59)) if now else ():
        briefing.scheduled_job(s.stored.folded, prefs, now.replace(hour=hour, minute=minute, second=0, microsecond=0), out)
    return briefing.briefing_runs(s.spark, out)


@query("briefing_text")
def _q11(s: Store):
    items, mailboxes, counts = _briefing_parts(s)
    return briefing.fallback_lines(items, counts, mailboxes, s.today)


@query("backfill_prepare")
def _q12a(s: Store):
    new = reads.new_emails_antijoin(s.fetched, s.stored_ids_before)
    return new.select("id", prompt_text().alias("prompt"))


@query("backfill_apply")
def _q12b(s: Store):
    done = s.applied.where(F.col("outcome") == "processed")
    return done.select("custom_id", "analysis.email_type", "analysis.domain",
                       "analysis.summary", "analysis.requires_reply", "analysis.deadline")


@query("backfill_state")
def _q12(s: Store):
    """Q12 whole: new mail -> requests -> result file -> log append -> fold with the earlier log."""
    base = shared_dir(s.spark, "backfill")
    new = reads.new_emails_antijoin(s.fetched, s.stored_ids_before)

    def service(requests: str, results: str) -> None:
        s.with_broken_lines.write.mode("overwrite").text(results)

    analysis.run_backfill(s.spark, new, service, base, 1, s.as_of)
    writes = analysis.read_backfill_log(s.spark, f"{base}/log")
    before = s.log.where(F.col("processed_at") < s.cutoff).select(*writes.columns)
    return fold.emails_state(before.unionByName(writes))


# --------------------------------------------------------------------------
# 2.13 streaming (drained with availableNow, then read back)
# --------------------------------------------------------------------------

STREAM_FILES = 4   # chunks per micro-batch (the per-poll cap of the stream, in files of a small log)


def _stream_source(s: Store):
    import os
    from ..streaming import ingest
    base = ingest.scratch(s.spark, "stream")
    src = os.path.join(base, "source")
    log = s.log.drop("k")
    chunks = ingest.count_chunks(log)
    files = ingest.files_per_chunk(log, chunks=chunks)
    ingest.write_log_source(log, src, files=files, chunks=chunks)
    return base, src, log.schema, STREAM_FILES * files


@query("stream_ingest")
def _w1(s: Store):
    import os
    from ..streaming import ingest
    base, src, schema, max_files = _stream_source(s)
    return ingest.run_ingest(s.spark, src, schema, os.path.join(base, "sink"),
                             os.path.join(base, "ckpt"), max_files=max_files, consume=True)


def stream_dedup_drain(s: Store, base: str, src: str, schema, max_files: int = STREAM_FILES):
    """W2 on a prepared source: drain the stream, each id processed once."""
    import os
    from ..streaming import ingest
    processed, _ = ingest.run_dedup(s.spark, src, schema, os.path.join(base, "out"),
                                    os.path.join(base, "ckpt"), max_files=max_files)
    return processed.select("id", "seq", "sender", "processed_at")


@query("stream_dedup")
def _w2(s: Store):
    return stream_dedup_drain(s, *_stream_source(s))


@query("stream_seed")
def _w3(s: Store):
    import os
    from ..streaming import ingest
    base, src, schema, max_files = _stream_source(s)
    processed, _ = ingest.run_dedup(s.spark, src, schema, os.path.join(base, "out"),
                                    os.path.join(base, "ckpt"), seed_ids=s.stored_ids_before,
                                    max_files=max_files)
    return processed.select("id", "seq", "processed_at")


def _needs_body(new):
    ok = new.where(F.col("body").isNotNull())
    bad = new.where(F.col("body").isNull()).select("id", "seq", F.lit("no body").alias("reason"))
    return ok, bad


@query("stream_failures")
def _w4(s: Store):
    import os
    from ..streaming import ingest
    base, src, schema, max_files = _stream_source(s)
    _, failures = ingest.run_dedup(s.spark, src, schema, os.path.join(base, "out"),
                                   os.path.join(base, "ckpt"), process=_needs_body,
                                   max_files=max_files)
    return failures


def _drained_state(s: Store) -> str:
    """The state folder of a stream drained once per session and data directory."""
    import os
    from ..streaming import ingest

    def drain():
        base, src, schema, max_files = _stream_source(s)
        folder = os.path.join(base, "state")
        ingest.run_state(s.spark, src, schema, folder, os.path.join(base, "ckpt"), max_files=max_files)
        return folder
    return s._once("stream-state", drain)


def _streamed(name: str):
    def read(s: Store):
        from ..streaming import ingest
        return ingest.current_tables(s.spark, _drained_state(s))[name]
    return read


query("stream_state")(_streamed("emails"))
query("stream_contacts")(_streamed("contacts"))
query("stream_follow_ups")(_streamed("follow_ups"))
query("stream_deadlines")(_streamed("deadlines"))
