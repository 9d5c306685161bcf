"""Stored state: one job writes the current tables, the reads scan them.

The log stays the source of truth; ``write_state`` folds it once (that fold is
itself written, so every table is a narrow projection of one copy) and writes

* ``emails``     partitioned by ``processed_day``, sorted by id inside the files:
  look-backs prune days, id lookups skip row groups by their statistics;
* ``contacts``   range-partitioned and sorted by address;
* ``follow_ups`` and ``deadlines`` partitioned by status;
* ``vectors``    (V6/V7) id, document, metadata, mailbox and the unit vector
  ``vec``, so a search scans numbers and tokenises nothing but its query; laid out by
  bucket of the mailbox, so a search within one mailbox opens one bucket;
* ``by_id``      the fold itself, laid out by bucket of the id, sorted by id and with
  Bloom filters, so the lookup of one mail opens one bucket's files.

All folders lie under the shared folder of the session; a reader holds the
folder's name, so a half-written state is never read.  ``reindex`` rebuilds the vectors
as a new version behind a pointer, and ``fan_out`` keeps a ledger (see ``ledger``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import EMBED_DIM
from ..session import shared_dir
from ..sources.tables import parallelism
from . import fold, search
from .ledger import Ledger, Versions


class StoredState:
    """DataFrames over the written tables (schemas fixed, nothing inferred).

    A table is written when it is first asked for, and the fold that all are projections of
    before it; ``write_state`` writes them all.
    """

    def __init__(self, spark: SparkSession, folded: DataFrame, contacts: DataFrame, buckets: int):
        self.spark, self._fold, self._contacts, self.buckets = spark, folded, contacts, buckets

    @cached_property
    def _base(self) -> str:
        return shared_dir(self.spark, "state")

    @cached_property
    def by_id(self) -> DataFrame:
        rows = _without_copies(self._fold).withColumn("id_bucket", _bucket(F.col("id"), self.buckets))
        rows = rows.repartition("id_bucket").sortWithinPartitions("id_bucket", "id")
        rows = _stored(rows, f"{self._base}/fold", "id_bucket", **{"parquet.bloom.filter.enabled#id": "true"})
        return _with_copies(rows).select(*self._fold.columns, "id_bucket")

    @cached_property
    def folded(self) -> DataFrame:
        return self.by_id.drop("id_bucket")

    @cached_property
    def emails(self) -> DataFrame:
        emails = (fold.emails_from_partial(self.folded).withColumn("processed_day", F.to_date("processed_at"))
                  .repartitionByRange("processed_day", "id").sortWithinPartitions("processed_day", "id"))
        return _stored(emails, f"{self._base}/emails", "processed_day")

    @cached_property
    def contacts(self) -> DataFrame:
        rows = self._contacts.repartitionByRange("email_address").sortWithinPartitions("email_address")
        return _stored(rows, f"{self._base}/contacts")

    @cached_property
    def follow_ups(self) -> DataFrame:
        rows = fold.follow_ups_from_partial(self.folded, "follow_up_status")
        return _stored(rows, f"{self._base}/follow_ups", "status")

    @cached_property
    def deadlines(self) -> DataFrame:
        rows = fold.deadlines_from_partial(self.folded, "deadline_status")
        return _stored(rows, f"{self._base}/deadlines", "status")

    @cached_property
    def vectors(self) -> DataFrame:
        index = search.vector_index_from_fold(
            self.folded, F.col("first.mailbox_id").alias("mailbox_id"),
            _bucket(F.col("first.mailbox_id"), self.buckets).alias("mailbox_bucket"))
        # texts are shuffled, not vectors; a large mailbox is a range of many tasks, each small enough to sort
        n = max(parallelism(self.spark), -(-self.by_id.count() // VECTOR_ROWS))
        index = index.repartitionByRange(n, "mailbox_bucket", "mailbox_id", "id")
        return _stored(embedded(index, "document"), f"{self._base}/vectors", "mailbox_bucket")

    def of_id(self, email_id) -> DataFrame:
        """The folded row of one mail, from its bucket."""
        here = F.col("id_bucket") == _bucket(F.lit(email_id).cast(self.by_id.schema["id"].dataType), self.buckets)
        return self.by_id.where(here & (F.col("id") == F.lit(email_id))).drop("id_bucket")

    def of_mailbox(self, mailbox_id) -> Column:
        """The condition on ``vectors`` for one mailbox, which prunes its bucket."""
        own = F.lit(mailbox_id).cast(self.vectors.schema["mailbox_id"].dataType)
        return (F.col("mailbox_bucket") == _bucket(own, self.buckets)) & (F.col("mailbox_id") == own)


BUCKETS = 64
#: Rows of the vector table that one task sorts (about 6 KB each).
VECTOR_ROWS = 20_000
#: The columns of ``fold.emails_state``.
EMAILS = ("id long, mailbox_id long, thread_id string, sender string, subject string, snippet string, body string, "
          "date string, email_type string, domain string, summary string, requires_reply boolean, deadline string, "
          "entities string, processed_at timestamp_ntz")


def _bucket(value: Column, n: int) -> Column:
    """A constant for a literal, so a comparison with it prunes partitions."""
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


def _stored(df: DataFrame, path: str, partition: str | None = None, **options) -> DataFrame:
    writer = df.write.options(**options)
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def embedded(df: DataFrame, text_col: str, dim: int = EMBED_DIM) -> DataFrame:
    """``df`` with ``vec``: the text's unit vector, each distinct token of a block hashed once."""
    vec = search.embed_udf(dim=dim, element="double")
    return df.withColumn("vec", vec(F.lower(text_col)))


def vector_store(spark: SparkSession, docs: DataFrame, text_col: str, purpose: str) -> DataFrame:
    """Write ``docs`` with their vectors and return the stored table (V6 / V7)."""
    return _stored(embedded(docs, text_col), shared_dir(spark, purpose))


def write_state(spark: SparkSession, folded: DataFrame, contacts: DataFrame, buckets: int = BUCKETS) -> StoredState:
    """D1-D4 and V6 from one state fold and the contacts fold.

    ``buckets``: of the id and mailbox layouts; choose it so that a bucket is a file or a few.
    """
    state = StoredState(spark, folded, contacts, buckets)
    for table in ("by_id", "emails", "contacts", "follow_ups", "deadlines", "vectors"):
        getattr(state, table)
    return state


COPIED = ("subject", "snippet", "body")


def _first(name: str) -> Column:
    return F.col("first.subject" if name == "subject" else f"first_text.{name}")


def _without_copies(folded: DataFrame) -> DataFrame:
    """The last write's texts only where they are not those of the first."""
    last = F.col("last_raw")
    for name in COPIED:
        same = F.col(f"last_raw.{name}").eqNullSafe(_first(name))
        last = last.withField(name, F.when(~same, F.col(f"last_raw.{name}"))).withField(f"same_{name}", same)
    return folded.withColumn("last_raw", last)


def _with_copies(stored: DataFrame) -> DataFrame:
    """``_without_copies`` undone."""
    last = F.col("last_raw")
    for name in COPIED:
        last = last.withField(name, F.when(F.col(f"last_raw.same_{name}"), _first(name))
                              .otherwise(F.col(f"last_raw.{name}")))
    return stored.withColumn("last_raw", last.dropFields(*(f"same_{name}" for name in COPIED)))


def recent(emails: DataFrame, as_of: Column, hours: int = 0, days: int = 0) -> DataFrame:
    """The stored mails of the days that a look-back covers (partition pruning)."""
    since = as_of - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))
    return emails.where(F.col("processed_day") >= F.to_date(since)).drop("processed_day")


def fan_out(spark: SparkSession, sinks: dict[str, DataFrame], base: str | None = None, batch: int = 0) -> DataFrame:
    """Write every sink to its own folder; (sink, n, path, error, written), one row per sink.

    A sink that fails leaves its error and the others are written.  A ledger beside ``base``
    holds what is done by (batch, sink): the same batch run again on the same ``base`` writes
    only what failed or was cut off (``written``) and reports the others as they stand.
    """
    base = base or shared_dir(spark, "sinks")
    ledger = Ledger(spark, f"{base}-ledger")
    earlier, done = ledger.of(batch), []
    for name, df in sinks.items():
        if name in earlier:
            done.append((name, earlier[name].n, earlier[name].path, None, False))
            continue
        path = f"{base}/{name}/batch={batch}"
        try:
            df.write.mode("overwrite").parquet(path)
            n = spark.read.schema(df.schema).parquet(path).count()
            ledger.record(batch, name, n, path)
            done.append((name, n, path, None, True))
        except Exception as exc:  # noqa: BLE001  isolated: reported, not raised
            done.append((name, None, path, f"{type(exc).__name__}: {exc}"[:500], False))
    return spark.createDataFrame(done, "sink string, n long, path string, error string, written boolean")


def vector_table(spark: SparkSession, folder: str, dim: int = EMBED_DIM) -> Versions:
    """The mail vectors as a table published by version: id, document, metadata, vec."""
    empty = spark.createDataFrame([], EMAILS)
    return Versions(spark, folder, embedded(search.reindex(empty), "document", dim).schema)


def reindex(emails: DataFrame, table: Versions, dim: int = EMBED_DIM) -> int:
    """V7 / Q13: embed every stored mail anew and switch the readers to the result.

    Until the new version is whole, and for good if it never is, readers see the one
    before.  Returns the version.
    """
    return table.publish(embedded(search.reindex(emails), "document", dim))
