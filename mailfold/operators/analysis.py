"""Batch analysis: request preparation, result parsing and joining (backfill path).

prepare:  new mail -> prompt (J1) -> one JSON request line per mail (J2)
apply:    result lines (S6) -> tool block (J4) -> typed analysis (J3)
          -> validity split (F8) -> join to the pending mail (K3) -> counts (A5)
          and a dead-letter table of failures (D8)

The model call itself is outside Spark's concern; ``analyze_fn`` (X5) is any
``DataFrame -> DataFrame`` so a model client can be plugged in with
``mapInPandas`` on executors.  The default offline analyser is a few keyword
rules in native expressions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import (ANALYSIS_INPUT, ANALYSIS_TOOL_DESCRIPTION, ANALYSIS_TOOL_NAME,
                      BATCH_RESULT, DOMAINS, EMAIL_TYPES)
from ..functions.text import nonempty, prompt_text
from .fold import dense_ordinals

# fixed values: the tool definition sent with every analysis request
ANALYSIS_TOOL = {
    "name": ANALYSIS_TOOL_NAME,
    "description": ANALYSIS_TOOL_DESCRIPTION,
    "input_schema": {
        "type": "object",
        "properties": {
            "email_type": {"type": "string", "enum": ["human", "automated"],
                           "description": "'human' if written by a real person; "
                                          "'automated' if system-generated."},
            "domain": {"type": ["string", "null"],
                       "enum": ["finance", "shopping", "travel", "health", "government",
                                "work", "education", "newsletter", "marketing", "social",
                                "alerts", "other", None],
                       "description": "Category for automated emails only; null for human emails."},
            "entities": {"type": "array", "items": {"type": "string"},
                         "description": "Named people, organisations, products, or key topics."},
            "summary": {"type": "string", "description": "One sentence summary of the email."},
            "requires_reply": {"type": "boolean",
                               "description": "True if the sender expects a reply."},
            "deadline": {"type": ["string", "null"],
                         "description": "Any deadline or time constraint mentioned; null if none."},
        },
        "required": ["email_type", "domain", "entities", "summary", "requires_reply",
                     "deadline"],
    },
}
MAX_TOKENS = 1024
CORRUPT = "_corrupt_record"


def build_requests(mail: DataFrame, model: str = "analysis-model") -> DataFrame:
    """One JSON line per mail; ``custom_id`` is the mail id.

    The request is one ``to_json`` of a struct; the fixed tool definition is
    spliced in as text where a placeholder string stands.
    """
    tool = json.dumps(ANALYSIS_TOOL, ensure_ascii=False)
    req = F.struct(
        F.col("id").cast("string").alias("custom_id"),
        F.struct(
            F.lit(model).alias("model"),
            F.lit(MAX_TOKENS).alias("max_tokens"),
            F.array(F.lit("__TOOL__")).alias("tools"),
            F.struct(F.lit("tool").alias("type"), F.lit(ANALYSIS_TOOL_NAME).alias("name"))
            .alias("tool_choice"),
            F.array(F.struct(F.lit("user").alias("role"), prompt_text().alias("content")))
            .alias("messages"),
        ).alias("params"))
    line = F.replace(F.to_json(req), F.lit('"__TOOL__"'), F.lit(tool))
    return mail.select("id", line.alias("request"))


def render_results(labels: DataFrame, emails: DataFrame) -> DataFrame:
    """Fixture: the result file the batch service would return, as JSON lines.

    Derived from the ``labels`` table: quality 1 -> succeeded, else errored;
    toxic 1 -> the model answered without the analysis tool.  The analysis
    is the stored one; every tenth mail carries an unknown domain and another
    tenth has no summary key, so validation and defaults are exercised.
    """
    e = emails.select("id", "email_type", "domain", "entities", "summary",
                      "requires_reply", "deadline")
    j = labels.join(e, labels["doc_id"] == e["id"], "left")
    doc = F.col("doc_id")
    inp = F.struct(
        F.col("email_type"),
        F.when(doc % 10 == 7, F.lit("unknown")).otherwise(F.col("domain")).alias("domain"),
        F.from_json("entities", "array<string>").alias("entities"),
        F.when(doc % 10 == 8, F.lit(None).cast("string")).otherwise(F.col("summary"))
        .alias("summary"),
        F.col("requires_reply"),
        F.col("deadline"),
    )
    text_block = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"),
                          F.lit(None).cast(ANALYSIS_INPUT).alias("input"))
    tool_block = F.struct(
        F.lit("tool_use").alias("type"),
        F.when(F.col("toxic") == 1, F.lit("other_tool")).otherwise(F.lit(ANALYSIS_TOOL_NAME))
        .alias("name"),
        inp.alias("input"))
    ok = F.col("quality") == 1
    message = F.struct(F.lit("tool_use").alias("stop_reason"),
                       F.array(text_block, tool_block).alias("content"))
    result = F.struct(F.when(ok, F.lit("succeeded")).otherwise(F.lit("errored")).alias("type"),
                      F.when(ok, message).alias("message"))
    line = F.to_json(F.struct(doc.cast("string").alias("custom_id"), result.alias("result")))
    return j.select(line.alias("value"))


def read_results(lines: DataFrame) -> DataFrame:
    """Parse result lines with a fixed schema (no inference).

    ``bad_line`` is the text of a line that is no result record (not JSON, cut off, or
    without id or outcome), null for the others; what such a line holds is not used.
    Blank lines are no lines.
    """
    schema = T.StructType([*BATCH_RESULT, T.StructField(CORRUPT, T.StringType())])
    r = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = lines.where(F.trim("value") != "").select("value", r.alias("r"))
    whole = F.coalesce(F.col(f"r.{CORRUPT}").isNull() & F.col("r.custom_id").isNotNull()
                       & F.col("r.result.type").isNotNull(), F.lit(False))
    return parsed.withColumn("ok", whole).select(
        F.when(F.col("ok"), F.col("r.custom_id")).alias("custom_id"),
        F.when(F.col("ok"), F.col("r.result.type")).alias("result_type"),
        F.when(F.col("ok"), F.col("r.result.message.content")).alias("content"),
        F.when(~F.col("ok"), F.col("value")).alias("bad_line"))


def select_tool_block(results: DataFrame) -> DataFrame:
    """The first analysis tool block of each response; NULL when there is none."""
    block = F.try_element_at(
        F.filter("content", lambda b: b["name"] == ANALYSIS_TOOL_NAME), F.lit(1))
    return results.withColumn("block", block).drop("content")


def parse_analysis(block_input: Column) -> Column:
    """J3 + F8: typed analysis with the original's defaults, plus a validity flag."""
    i = block_input
    domain = nonempty(i["domain"])
    valid = (i["email_type"].isin(*EMAIL_TYPES)
             & (domain.isNull() | domain.isin(*DOMAINS)))
    return F.struct(
        i["email_type"].alias("email_type"),
        domain.alias("domain"),
        F.coalesce(i["entities"], F.array().cast("array<string>")).alias("entities"),
        F.coalesce(i["summary"], F.lit("")).alias("summary"),
        F.coalesce(i["requires_reply"], F.lit(False)).alias("requires_reply"),
        nonempty(i["deadline"]).alias("deadline"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def parsed_results(lines: DataFrame) -> DataFrame:
    blocks = select_tool_block(read_results(lines))
    return blocks.withColumn("analysis", parse_analysis(F.col("block.input")))


def apply_results(lines: DataFrame, pending: DataFrame) -> DataFrame:
    """K3: each result joined to the mail it answers; outcome and failure reason.

    A result fails when its line is not a result record, it did not succeed,
    it names an unknown mail, it carries no analysis tool call, or the
    analysis does not validate.
    """
    p = pending.select(F.col("id").cast("string").alias("_pid"))
    r = parsed_results(lines)
    j = r.join(p, r["custom_id"] == p["_pid"], "left")
    reason = (F.when(F.col("result_type").isNull(), F.lit("malformed_result"))
              .when(F.col("result_type") != "succeeded", F.lit("not_succeeded"))
              .when(F.col("_pid").isNull(), F.lit("unknown_id"))
              .when(F.col("block").isNull(), F.lit("no_tool_call"))
              .when(~F.col("analysis.valid"), F.lit("invalid_analysis")))
    return j.select(
        "custom_id", "result_type",
        F.when(reason.isNull(), F.lit("processed")).otherwise(F.lit("failed")).alias("outcome"),
        reason.alias("reason"), "bad_line",
        F.when(reason.isNull(), F.col("analysis")).alias("analysis"))


def batch_outcomes(applied: DataFrame) -> DataFrame:
    """A5: request counts by status and the processed / failed split, in one pass."""
    return applied.agg(
        F.count_if(F.col("result_type") == "succeeded").alias("succeeded"),
        F.count_if(F.col("result_type") == "errored").alias("errored"),
        F.count_if(F.col("result_type").isNull()
                   | ~F.col("result_type").isin("succeeded", "errored")).alias("other"),
        F.count_if(F.col("outcome") == "processed").alias("processed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )


def analysis_failures(applied: DataFrame) -> DataFrame:
    """The dead-letter rows; a later backfill retries them since they were not stored.
    A line that is no record comes with its text (``bad_line``)."""
    return applied.where(F.col("outcome") == "failed").select("custom_id", "result_type",
                                                              "reason", "bad_line")


def rule_analyzer(mail: DataFrame) -> DataFrame:
    """X5 offline default: keyword rules in native expressions (no model call).

    The original always calls a hosted model; this stand-in lets the pipeline
    run without network access.  Swap in any ``DataFrame -> DataFrame``.
    """
    text = F.lower(F.concat_ws(" ", "subject", "body", "snippet"))
    automated = F.col("sender").rlike("(?i)(no-?reply|notifications?|mailer)")
    domain = (F.when(text.rlike("invoice|receipt|payment|bank"), F.lit("finance"))
              .when(text.rlike("order|shipped|delivery"), F.lit("shopping"))
              .when(text.rlike("flight|hotel|booking"), F.lit("travel"))
              .when(text.rlike("unsubscribe|newsletter"), F.lit("newsletter"))
              .otherwise(F.lit("other")))
    return mail.select(
        "id",
        F.when(automated, F.lit("automated")).otherwise(F.lit("human")).alias("email_type"),
        F.when(automated, domain).alias("domain"),
        F.array().cast("array<string>").alias("entities"),
        F.coalesce("subject", F.lit("")).alias("summary"),
        (~automated & text.contains("?")).alias("requires_reply"),
        F.regexp_extract(text, r"(by (monday|tuesday|wednesday|thursday|friday|"
                               r"saturday|sunday|tomorrow|end of day))", 1).alias("deadline"),
    ).withColumn("deadline", nonempty("deadline"))


# --------------------------------------------------------------------------
# the two backfill jobs around the inference step (Q12)
# --------------------------------------------------------------------------

SEQ_BATCH_SHIFT = 40     # seq of a backfill write = (batch number << 40) + ordinal in the batch


def read_result_file(spark, path: str) -> DataFrame:
    """S6 as a file source: JSONL results read with the fixed schema, broken lines beside them."""
    return read_results(spark.read.text(path))


OUTCOMES = "succeeded long, errored long, other long, processed long, failed long"


def _batches(spark, log_path: str) -> DataFrame:
    """(outcome counts, batch) of the committed batches of a log."""
    (spark.createDataFrame([(0,) * 5], OUTCOMES).coalesce(1)
     .write.mode("ignore").parquet(f"{log_path}-batches/batch=-1"))
    return spark.read.schema(f"{OUTCOMES}, batch long").parquet(f"{log_path}-batches").where("batch >= 0")


def read_backfill_log(spark, log_path: str) -> DataFrame:
    """The appended writes of the committed batches; a batch that was cut off is not seen."""
    batches = [r.batch for r in _batches(spark, log_path).select("batch").collect()]      # one row per batch
    if not batches:
        return spark.createDataFrame([], BACKFILL_WRITE)
    return spark.read.schema(BACKFILL_WRITE).parquet(*(f"{log_path}/batch={b}" for b in sorted(batches)))


BACKFILL_WRITE = ("seq long, id long, mailbox_id long, thread_id string, sender string, subject string, "
                  "snippet string, body string, date string, processed_at timestamp_ntz, email_type string, "
                  "domain string, summary string, requires_reply boolean, deadline string, entities string")


def run_backfill(spark, new_mail: DataFrame, service, base: str, batch_no: int, stamp: Column) -> DataFrame:
    """Q12 whole: prepare, hand the requests to ``service(requests_path, results_path)``, apply.

    Everything lies under ``base``: requests, results, the log of writes and the failures.
    A batch that is committed is not asked for again.  Returns the outcome counts (A5).
    """
    requests, results = f"{base}/requests/batch={batch_no}", f"{base}/results/batch={batch_no}"
    if not _batches(spark, f"{base}/log").where(F.col("batch") == batch_no).take(1):
        prepare_backfill(new_mail, requests)
        service(requests, results)
    return apply_backfill(spark, results, new_mail, batch_no, f"{base}/log", f"{base}/failures", stamp)


def prepare_backfill(new_mail: DataFrame, requests_path: str,
                     model: str = "analysis-model") -> None:
    """Q12 prepare: one JSON request per new mail, written as JSONL text files."""
    build_requests(new_mail, model).select("request").write.mode("overwrite").text(requests_path)


def apply_backfill(spark, results_path: str, pending: DataFrame, batch_no: int,
                   log_path: str, failures_path: str,
                   processed_at: Column | None = None) -> DataFrame:
    """Q12 apply: join the result file to the pending mail, append every processed
    analysis to the log as a new write and the failures to a dead-letter table.

    A write's ``seq`` is ``(batch_no << 40) + ordinal``, where the ordinal is the
    dense position 1..n in ``custom_id`` order: it orders after every earlier
    batch however many partitions or rows a batch has (below 2**40), and a rerun
    gives each mail its number again.  The batch's outcome counts are written last and
    commit it: a committed batch is left as it is and its counts are returned; one that was
    cut off is written anew as a whole.  ``read_backfill_log`` reads committed batches only.
    ``processed_at`` stamps the writes (default: now).  Returns the outcome counts (A5).
    """
    committed = _batches(spark, log_path).where(F.col("batch") == batch_no).drop("batch")
    if committed.take(1):
        return committed
    stamp = (processed_at if processed_at is not None
             else F.current_timestamp().cast("timestamp_ntz"))
    lines = spark.read.text(results_path)
    applied = apply_results(lines, pending).cache()
    done = applied.where(F.col("outcome") == "processed")
    raw = pending.select(F.col("id").cast("string").alias("custom_id"), "id", "mailbox_id",
                         "thread_id", "sender", "subject", "snippet", "body", "date")
    # several results for one mail: one write, the same one on every run
    found = (done.join(raw, "custom_id").groupBy("custom_id")
             .agg(F.min_by(F.struct(*raw.columns, "analysis"), F.to_json("analysis")).alias("w")))
    numbered = dense_ordinals(found, "custom_id").select("w.*", "ordinal")
    writes = numbered.select(
        (F.lit(batch_no).cast("long") * F.lit(1 << SEQ_BATCH_SHIFT) + F.col("ordinal")).alias("seq"),
        "id", "mailbox_id", "thread_id", "sender", "subject", "snippet", "body", "date",
        stamp.alias("processed_at"),
        "analysis.email_type", "analysis.domain", "analysis.summary",
        "analysis.requires_reply", "analysis.deadline",
        F.to_json("analysis.entities").alias("entities"))
    writes.write.mode("overwrite").parquet(f"{log_path}/batch={batch_no}")
    analysis_failures(applied).write.mode("overwrite").parquet(f"{failures_path}/batch={batch_no}")
    batch_outcomes(applied).coalesce(1).write.mode("overwrite").parquet(f"{log_path}-batches/batch={batch_no}")
    applied.unpersist()
    return _batches(spark, log_path).where(F.col("batch") == batch_no).drop("batch")
