"""Mailbox labels: which labels an analysis implies, and the label state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import AI_LABELS, DOMAIN_LABEL, HUMAN_FOLLOWUP_LABEL, HUMAN_LABEL


def _domain_label(domain_col: str = "domain"):
    """Domain -> label as a ``CASE`` over the twelve fixed domains (unknown or NULL -> Other)."""
    expr = None
    for dom, lab in DOMAIN_LABEL.items():
        cond = F.col(domain_col) == dom
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(DOMAIN_LABEL["other"]))


def labels_for(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Human -> AI/Human (+ FollowUp when a reply is asked); automated -> domain label.

    Automated mail never gets the FollowUp label, whatever its reply flag.
    """
    human = F.col("email_type") == "human"
    arr = F.when(human, F.array_compact(F.array(
        F.lit(HUMAN_LABEL),
        F.when(F.col("requires_reply"), F.lit(HUMAN_FOLLOWUP_LABEL))))
    ).otherwise(F.array(_domain_label()))
    extra = [c for c in ("seq", "mailbox_id") if c in df.columns]
    return df.select(F.col(id_col).alias("email_id"), *extra, F.explode(arr).alias("label"))


def label_events(log: DataFrame) -> DataFrame:
    """Every processing write applies its labels: an 'add' event per (write, label)."""
    return labels_for(log).withColumn("action", F.lit("add"))


def current_labels(events: DataFrame) -> DataFrame:
    """The last action per (email, label) decides; keep labels whose last action adds."""
    # fixed-width buffers (a flag and the mailbox), so Spark hash-aggregates
    last = events.groupBy("email_id", "label").agg(
        F.max_by(F.col("action") == "add", "seq").alias("is_add"),
        F.max_by("mailbox_id", "seq").alias("mailbox_id"))
    return last.where(F.col("is_add")).select("email_id", "mailbox_id", "label")


def taxonomy_per_mailbox(mailboxes: DataFrame) -> DataFrame:
    """The required taxonomy for each mailbox, generated per row (no join)."""
    arr = F.array(*[F.lit(x) for x in AI_LABELS])
    return (mailboxes.select("mailbox_id", F.posexplode(arr).alias("ordinal", "label"))
            .withColumn("level", F.size(F.split("label", "/")) - 1))


def missing_labels(mailboxes: DataFrame, existing: DataFrame) -> DataFrame:
    """K7: required labels not present in a mailbox, parents before children."""
    need = taxonomy_per_mailbox(mailboxes)
    have = existing.select("mailbox_id", "label").distinct()
    return (need.join(have, ["mailbox_id", "label"], "left_anti")
            .orderBy("mailbox_id", "level", "ordinal")
            .select("mailbox_id", "label", "level", "ordinal"))


def label_catalog(current: DataFrame) -> DataFrame:
    """The label listing of each mailbox: every label in use, with a stable id."""
    tax = F.array(*[F.lit(x) for x in AI_LABELS])
    used = current.select("mailbox_id", "label").distinct()
    return used.select(
        "mailbox_id", "label",
        F.concat(F.lit("Label_"), F.col("mailbox_id").cast("string"), F.lit("_"),
                 F.coalesce(F.array_position(tax, F.col("label")), F.lit(0)).cast("string"))
        .alias("label_id"))


def resolve_label_ids(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """K8: label name -> id from the mailbox's listing; unknown names flagged for creation."""
    return (wanted.join(catalog, ["mailbox_id", "label"], "left")
            .withColumn("needs_create", F.col("label_id").isNull()))
