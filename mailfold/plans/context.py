"""Lazy wiring of the fixture tables into the state tables used by the queries.

``Store`` names every intermediate the registered queries share.  Nothing is
computed until a query's DataFrame is run; Catalyst then prunes each plan to
the columns that query needs.

Fixture conventions (FIXTURES.md section 2):

* the mail source is the log folded per id (``messages``);
* "stored before the backfill" is the state folded from writes older than
  three days before ``as_of`` (the cutoff), so anti joins have work to do;
* mail whose id ends in 3 is missing from the emails side of the dangling
  joins (topic search, follow-up and deadline enrichment, batch results).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import SparkSession, functions as F

from ..operators import analysis, fold, labels, search, store
from ..session import shared_dir
from ..sources import fixture, mailbox
from ..sources.tables import read_table, spread

#: Tables written in this session, by (application, data directory, name).
_WRITTEN: dict = {}

#: Briefing times of the mailboxes, by mailbox_id % 4; the third is no time (07:00 holds).
BRIEFING_TIMES = ("06:15", "09:30", "at noon", " 21 : 5 ")
CUTOFF_DAYS = 3
BACKFILL_DAYS = 7


class Store:
    """The folded tables for one data directory; every attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str):
        return read_table(self.spark, self.sf_dir, name)

    # -- log and state ------------------------------------------------------
    @cached_property
    def consts(self):
        """Row counts and the newest write time, one small job."""
        return fixture.constants(self.spark, self.sf_dir)

    @cached_property
    def log(self):
        """Every write with its document content (the full log)."""
        return fixture.event_log(self.spark, self.sf_dir, self.consts)

    @cached_property
    def events(self):
        """Every write, narrow: only what ``events`` itself supplies (no join)."""
        return fixture.event_columns(self.spark, self.sf_dir, self.consts)

    @cached_property
    def as_of(self):
        return fixture.as_of(self.spark, self.sf_dir, self.consts)

    @property
    def today(self):
        return self.as_of.cast("date").cast("string")

    @cached_property
    def folded(self):
        """The one fold every state table is projected from: narrow writes folded
        by id first, then one document join per id (content never shuffled)."""
        return fixture.folded_state(self.spark, self.sf_dir, self.consts)

    @cached_property
    def emails(self):
        return fold.emails_from_partial(self.folded)

    @cached_property
    def contacts(self):
        return fixture.contacts_state(self.spark, self.sf_dir, self.consts)

    @cached_property
    def follow_ups(self):
        return fold.follow_ups_from_partial(self.folded, "follow_up_status")

    @cached_property
    def deadlines(self):
        return fold.deadlines_from_partial(self.folded, "deadline_status")

    @cached_property
    def emails_dangling(self):
        """The emails table with every id ending in 3 missing."""
        return self.emails.where(F.col("id") % 10 != 3)

    # -- stored state ---------------------------------------------------------
    @property
    def stored(self) -> store.StoredState:
        """The stored tables, each written when a query first reads it: once per session and data directory."""
        return self._once("state", lambda: store.StoredState(self.spark, self.folded, self.contacts, store.BUCKETS))

    @property
    def document_vectors(self):
        """(id, vec) of every document, stored once per session and data directory."""
        docs = lambda: self.table("documents").select(F.col("doc_id").alias("id"), "text")
        return self._once("documents", lambda: store.vector_store(
            self.spark, spread(docs()), "text", "document-vectors").select("id", "vec"))

    def _once(self, name, build):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            _WRITTEN[key] = build()
        return _WRITTEN[key]

    # -- before / after the cutoff -----------------------------------------
    @property
    def cutoff(self):
        return self.as_of - F.make_dt_interval(days=F.lit(CUTOFF_DAYS))

    @cached_property
    def log_before(self):
        return self.events.where(F.col("processed_at") < self.cutoff)

    @cached_property
    def log_after(self):
        return self.events.where(F.col("processed_at") >= self.cutoff)

    @cached_property
    def stored_ids_before(self):
        return self.log_before.select("id").distinct()

    # -- source ---------------------------------------------------------------
    @cached_property
    def messages(self):
        return mailbox.messages_from_partial(self.folded)

    @cached_property
    def fetched(self):
        return mailbox.scan_since_days(self.messages, self.as_of, BACKFILL_DAYS, None)

    # -- analysis results -----------------------------------------------------
    @cached_property
    def result_lines(self):
        return analysis.render_results(self.table("labels"), self.emails)

    @cached_property
    def with_broken_lines(self):
        """The result lines, and for every fifth result a first copy that was cut off."""
        cut = F.concat(F.lit('{"custom_id":"'), F.col("doc_id").cast("string"), F.lit('","result":{"ty'))
        broken = self.table("labels").where(F.col("doc_id") % 5 == 0).select(cut.alias("value"))
        return self.result_lines.unionByName(broken)

    @property
    def result_file(self) -> str:
        """The result file of the batch service, written once per session and data directory."""
        def write():
            path = shared_dir(self.spark, "results")
            self.with_broken_lines.write.text(path)
            return path
        return self._once("results", write)

    @cached_property
    def applied(self):
        return analysis.apply_results(self.result_lines, self.emails_dangling)

    # -- labels ---------------------------------------------------------------
    @cached_property
    def label_events(self):
        return labels.label_events(self.events)

    @cached_property
    def current_labels(self):
        return labels.current_labels(self.label_events)

    @cached_property
    def mailboxes(self):
        return self.folded.select(F.col("first.mailbox_id").alias("mailbox_id")).distinct()

    # -- search ---------------------------------------------------------------
    @cached_property
    def vector_index(self):
        return search.vector_index_from_fold(self.folded)

    @cached_property
    def query_text(self):
        """The topic searched for: the first benchmark passage."""
        bench = self.table("benchmark")
        first = bench.select(F.min("item_id")).scalar()
        return bench.where(F.col("item_id") == first).select("text").scalar()

    @cached_property
    def query_vector(self):
        """The dense query: the stored vector with the smallest id."""
        emb = self.table("embeddings")
        first = emb.select(F.min("vec_id")).scalar()
        row = emb.where(F.col("vec_id") == first).select("embedding").first()  # one vector
        return list(row[0]) if row else []
