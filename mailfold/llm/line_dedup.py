"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of ASCII white space at both ends, with A-Z
lower-cased; it is held as 128 bits of XXH64 (two seeds).  The state has three
tables:

* ``counts`` (k1, k2, n_docs): how many documents hold the key, exact;
* ``members`` (_k1, _k2, n): the rows whose keys are counted, by row key;
* ``filters`` (shard, filter): per shard of the key space one cuckoo filter of
  the keys that at least ``min_docs`` documents hold.

Inserting documents adds their counts, deleting documents subtracts them; the
keys whose count crosses ``min_docs`` are put into or taken out of their
shard's filter, so inserting and then deleting a batch restores every answer.
Deleting a row that is not a member is an error and changes nothing; a batch that is
given a name is applied once, so one that is replayed changes nothing either.
``save_state`` and ``load_state`` keep a state in a folder.
Shards are sized by ``KEYS_PER_SHARD``; when the frequent keys outgrow the
shards, the filters are built anew from the exact table with more of them.

To dedup documents, each one's distinct keys travel once, as longs, to the
filters of their shard: shards are salted (the filter is copied to each salt),
so the key of a line that a third of all documents hold is probed by many
tasks, and rows are streamed past one filter at a time.  What a filter lets
through is confirmed against the exact table, so false positives drop nothing.

Lines are split at ``\\n``; a null or empty text is one empty line.  Keys
shorter than ``min_length`` code points are never dropped.  Every row counts as
a document of its own, whatever its id (null or repeated).  Equal rows get
equal results; an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_WS, LOWER, UPPER, materialise, partitions, require_columns, row_key, text_slices

KEYS_PER_SHARD = 100_000
LEAST_SALTS = 32
SLOTS = 4
LOAD = 0.85
KICKS = 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four; insert, delete, vectorised lookup.

    Kicks follow a fixed order, so the same calls give the same bytes.
    """

    def __init__(self, table):
        self.table = table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * LOAD < max(n, 1):
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).astype(np.uint16))

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, k1, k2):
        """Fingerprint and both buckets of keys (arrays of 64-bit integers)."""
        k1, k2 = np.asarray(k1).astype(np.int64), np.asarray(k2).astype(np.int64)
        mark = (k2 & 0xFFFF).astype(np.uint16)
        mark[mark == 0] = 1
        first = (k1 >> 8) & (len(self.table) - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        spread = (np.asarray(mark).astype(np.int64) * 0x5BD1E995) >> 7
        return (bucket ^ spread) & (len(self.table) - 1)

    def contains(self, k1, k2):
        mark, a, b = self._places(k1, k2)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def insert(self, k1: int, k2: int) -> bool:
        """False if the filter is too full; it must then be built anew, larger."""
        mark, a, b = (x[0] for x in self._places([k1], [k2]))
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = b
        for turn in range(KICKS):
            slot = turn % SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self._other(bucket, mark))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, k1: int, k2: int) -> bool:
        mark, a, b = (x[0] for x in self._places([k1], [k2]))
        for bucket in (a, b):
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False


def build_filter(k1, k2) -> bytes:
    room = max(len(k1), 1)
    while True:
        built = CuckooFilter.for_keys(room)
        if all(built.insert(a, b) for a, b in zip(k1, k2)):
            return built.to_bytes()
        room *= 2


def changed_filter(data: bytes | None, added, removed, everything) -> bytes:
    """A shard's filter after the crossings; built anew from ``everything()`` if it overflows."""
    if data is None:
        return build_filter(*everything())
    held = CuckooFilter.from_bytes(data)
    for a, b in zip(*removed):
        held.delete(a, b)
    if all(held.insert(a, b) for a, b in zip(*added)):
        return held.to_bytes()
    return build_filter(*everything())


# -- lines and keys ---------------------------------------------------------------

def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(ASCII_WS)), UPPER, LOWER)


def _hashes(key: Column):
    return F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("second"), key).alias("k2")


def document_keys(docs: DataFrame, text: str, doc_id: str, min_length: int) -> DataFrame:
    """(_k1, _k2, k1, k2): each row's distinct line keys."""
    keys = F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_key))
    return (docs.select(*row_key(doc_id, text), F.explode(keys).alias("_key"))
                .where(F.length("_key") >= min_length)
                .select("_k1", "_k2", *_hashes(F.col("_key"))))


def count_keys(keys: DataFrame, sign: int = 1) -> DataFrame:
    return keys.groupBy("k1", "k2").agg((F.count("*") * sign).alias("n_docs"))


# -- state ------------------------------------------------------------------------

META = "min_docs int, min_length int, n_shards int, batches array<string>"
STATE_TABLES = {"counts": "k1 long, k2 long, n_docs long", "filters": "shard int, filter binary",
                "members": "_k1 long, _k2 long, n long"}


@dataclass
class LineState:
    counts: DataFrame       # k1, k2, n_docs
    filters: DataFrame      # shard, filter
    members: DataFrame      # _k1, _k2, n
    min_docs: int
    min_length: int
    n_shards: int
    batches: frozenset = frozenset()        # names of the batches applied


def row_counts(keys: DataFrame) -> DataFrame:
    """(_k1, _k2, n): the rows that ``document_keys`` are of; each row has each of its keys once."""
    once = keys.groupBy("_k1", "_k2", "k1", "k2").agg(F.count("*").alias("n"))
    return once.groupBy("_k1", "_k2").agg(F.max("n").alias("n"))


def _shard(n_shards: int) -> Column:
    return F.pmod("k2", F.lit(n_shards)).cast("int").alias("shard")


def _build_filters(counts: DataFrame, min_docs: int):
    frequent = counts.where(F.col("n_docs") >= min_docs)
    n_shards = 1 + frequent.count() // KEYS_PER_SHARD

    def build(key, rows):
        import pandas as pd
        rows = rows.sort_values(["k1", "k2"])
        return pd.DataFrame({"shard": [key[0]], "filter": [build_filter(rows.k1.to_numpy(), rows.k2.to_numpy())]})

    filters = (frequent.select(_shard(n_shards), "k1", "k2").groupBy("shard")
                       .applyInPandas(build, "shard int, filter binary"))
    return materialise(filters, "line-filters"), n_shards


def new_state(keys: DataFrame, min_docs: int, min_length: int = 1) -> LineState:
    """State of the documents whose ``document_keys`` are given."""
    counts = materialise(count_keys(keys), "line-counts")
    filters, n_shards = _build_filters(counts, min_docs)
    # not worked out before the first update
    return LineState(counts, filters, row_counts(keys), min_docs, min_length, n_shards)


def save_state(state: LineState, folder: str) -> None:
    spark = state.counts.sparkSession
    for name in ("counts", "filters", "members"):
        getattr(state, name).write.parquet(f"{folder}/{name}")
    # written last: a folder with it is whole
    rows = [(state.min_docs, state.min_length, state.n_shards, sorted(state.batches))]
    spark.createDataFrame(rows, META).coalesce(1).write.parquet(f"{folder}/meta")


def load_state(spark, folder: str) -> LineState:
    meta = spark.read.schema(META).parquet(f"{folder}/meta").first()
    tables = {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in STATE_TABLES.items()}
    return LineState(**tables, min_docs=meta.min_docs, min_length=meta.min_length, n_shards=meta.n_shards,
                     batches=frozenset(meta.batches))


def update(state: LineState, docs: DataFrame, sign: int, text: str = "text",
           doc_id: str = "doc_id", batch: str | None = None) -> LineState:
    """Insert (+1) or delete (-1) documents: membership, exact counts, then the filters that change.

    A ``batch`` that the state has been through is not applied again.
    """
    if batch is not None and batch in state.batches:
        return state
    keys = materialise(document_keys(docs, text, doc_id, state.min_length), "line-keys")
    signed = row_counts(keys).select("_k1", "_k2", (F.col("n") * sign).alias("n"))
    members = materialise(state.members.union(signed).groupBy("_k1", "_k2").agg(F.sum("n").alias("n")), "line-members")
    if not members.where("n < 0").isEmpty():
        raise ValueError("a deleted document was never inserted")
    members = members.where("n > 0")
    batches = state.batches | ({batch} if batch is not None else set())
    delta = count_keys(keys, sign)
    old = state.counts.select("k1", "k2", F.col("n_docs").alias("old"), F.lit(0).cast("long").alias("change"))
    new = delta.select("k1", "k2", F.lit(0).cast("long").alias("old"), F.col("n_docs").alias("change"))
    merged = (old.union(new).groupBy("k1", "k2").agg(F.sum("old").alias("old"), F.sum("change").alias("change"))
                 .withColumn("n_docs", F.col("old") + F.col("change")))
    merged = materialise(merged, "line-counts-merged")
    counts = merged.where("n_docs > 0").select("k1", "k2", "n_docs")
    frequent = counts.where(F.col("n_docs") >= state.min_docs)
    if frequent.count() > state.n_shards * KEYS_PER_SHARD:
        filters, n_shards = _build_filters(counts, state.min_docs)
        return LineState(counts, filters, members, state.min_docs, state.min_length, n_shards, batches)
    n_shards, limit = state.n_shards, state.min_docs
    crossed = merged.where((F.col("old") >= limit) != (F.col("n_docs") >= limit)).select("k1", "k2").distinct()
    touched = crossed.select(_shard(n_shards)).distinct()
    # a touched shard's keys: at most the frequent ones, before or after, of one shard
    frequent = (merged.where((F.col("old") >= limit) | (F.col("n_docs") >= limit))
                      .select(_shard(n_shards), "k1", "k2", "old", "n_docs").join(touched, "shard", "left_semi"))

    def change(key, held, rows):
        import pandas as pd
        if not len(rows):
            return held
        rows = rows.sort_values(["k1", "k2"])
        was, now = rows.old >= limit, rows.n_docs >= limit
        part = lambda mask: (rows.k1[mask].to_numpy(), rows.k2[mask].to_numpy())
        data = bytes(held["filter"].iloc[0]) if len(held) else None
        made = changed_filter(data, part(~was & now), part(was & ~now), lambda: part(now))
        return pd.DataFrame({"shard": [key[0]], "filter": [made]})

    filters = (state.filters.groupBy("shard").cogroup(frequent.groupBy("shard"))
                    .applyInPandas(change, "shard int, filter binary"))
    return LineState(counts, materialise(filters, "line-filters"), members, limit, state.min_length, n_shards, batches)


def insert_documents(state: LineState, docs: DataFrame, **columns) -> LineState:
    return update(state, docs, 1, **columns)


def delete_documents(state: LineState, docs: DataFrame, **columns) -> LineState:
    return update(state, docs, -1, **columns)


# -- dedup ------------------------------------------------------------------------

def frequent_keys(state: LineState, keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key is frequent: filters first, then the exact table."""
    n = partitions(keys.sparkSession)
    salts = max(LEAST_SALTS, -(-4 * n // state.n_shards))
    rows = keys.select(_shard(state.n_shards), F.pmod("_k1", F.lit(salts)).cast("int").alias("salt"),
                       F.lit(True).alias("is_key"), "_k1", "_k2", "k1", "k2",
                       F.lit(None).cast("binary").alias("filter"))
    zero = F.lit(0).cast("long")
    copies = state.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
                                  F.lit(False).alias("is_key"), zero.alias("_k1"), zero.alias("_k2"),
                                  zero.alias("k1"), zero.alias("k2"), "filter")
    routed = (rows.union(copies).repartition(n, "shard", "salt")
                  .sortWithinPartitions("shard", "salt", "is_key"))

    def probe(batches):
        import pyarrow as pa
        place, held = (-1, -1), None
        for batch in batches:
            shard, salt, is_key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            longs = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7)]
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(is_key.astype(np.int8)) != 0)) + 1
            passed = np.zeros(batch.num_rows, bool)
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if lo == hi:
                    continue
                if not is_key[lo]:
                    place, held = (shard[lo], salt[lo]), CuckooFilter.from_bytes(batch.column(7)[int(lo)].as_py())
                elif place == (shard[lo], salt[lo]):
                    passed[lo:hi] = held.contains(longs[2][lo:hi], longs[3][lo:hi])
                # else: the shard has no frequent key
            yield pa.RecordBatch.from_arrays([pa.array(x[passed]) for x in longs], names=["_k1", "_k2", "k1", "k2"])

    passed = routed.mapInArrow(probe, "_k1 long, _k2 long, k1 long, k2 long")
    exact = state.counts.where(F.col("n_docs") >= state.min_docs).select("k1", "k2")
    return passed.join(exact, ["k1", "k2"], "left_semi")


def dropped_lines(docs: DataFrame, min_docs: int, min_length: int = 1, text: str = "text",
                  doc_id: str = "doc_id", state: LineState | None = None) -> DataFrame:
    """(_k1, _k2, _dropped): per row key, the first hashes of its keys that must go."""
    keys = materialise(document_keys(docs, text, doc_id, min_length), "line-keys")
    state = state or new_state(keys, min_docs, min_length)
    return (frequent_keys(state, keys).groupBy("_k1", "_k2")
            .agg(F.collect_set(F.struct("k1", "k2")).alias("_dropped")))


def _with_drops(docs, min_docs, min_length, text, doc_id, state):
    require_columns(docs, text, doc_id)
    drops = dropped_lines(docs, min_docs, min_length, text, doc_id, state)
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return rows.select("*", *row_key("_id", "_text")).join(drops, ["_k1", "_k2"], "left")


class LineDropper:
    """Drops the lines of a text whose key hashes are in a set, as ``line_key`` forms them."""

    def __init__(self):
        from xxhash import xxh64_intdigest
        self.digest, self.second = xxh64_intdigest, xxh64_intdigest(b"second", 42)
        self.strip = ASCII_WS.encode()

    def hashes(self, line: bytes):
        key = line.strip(self.strip).lower()          # bytes: lowers A-Z only
        return tuple(h - (1 << 64) if h >> 63 else h for h in
                     (self.digest(key, 42), self.digest(key, self.second)))

    def split(self, text: bytes, dropped):
        """(number of lines, number dropped, text that stays)."""
        if not dropped:
            return text.count(b"\n") + 1, 0, text
        dropped = {(d["k1"], d["k2"]) for d in dropped}
        lines = text.split(b"\n")
        kept = [line for line in lines if self.hashes(line) not in dropped]
        return len(lines), len(lines) - len(kept), b"\n".join(kept)


def dedup_documents(docs: DataFrame, min_docs: int = 10, min_length: int = 1, text: str = "text",
                    doc_id: str = "doc_id", length: str = "n_chars",
                    state: LineState | None = None) -> DataFrame:
    """``docs`` without their frequent lines; a ``length`` column follows the text.

    Rows and columns stay as they are; a null text stays null.
    """
    found = _with_drops(docs, min_docs, min_length, text, doc_id, state)
    names = docs.columns
    rows = found.select(*(F.col(f"_row.`{c}`").alias(f"_c{i}") for i, c in enumerate(names)), "_text", "_dropped")
    schema = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    at, width = names.index(text), len(names)

    def drop(batches):
        import pyarrow as pa
        dropper = LineDropper()
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                kept = [t if not d else dropper.split(t.encode(), d)[2].decode()
                        for t, d in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())]
                columns = [batch.column(i) for i in range(width)]
                columns[at] = pa.array(kept, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=[f"_c{i}" for i in range(width)])

    done = rows.mapInArrow(drop, schema).toDF(*names)
    if length not in names:
        return done
    kind = docs.schema[length].dataType
    return done.withColumn(length, F.coalesce(F.length(text).cast(kind), F.col(length)))


def dedup_digests(docs: DataFrame, min_docs: int = 10, min_length: int = 1, text: str = "text",
                  doc_id: str = "doc_id", state: LineState | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row."""
    found = _with_drops(docs, min_docs, min_length, text, doc_id, state)
    kind = docs.schema[doc_id].dataType.simpleString()

    def digest(batches):
        import pyarrow as pa
        dropper = LineDropper()
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                out = []
                for text, dropped in zip(batch.column(1), batch.column(2).to_pylist()):
                    n, gone, kept = dropper.split((text.as_py() or "").encode(), dropped)
                    out.append((n, gone, hashlib.sha256(kept).hexdigest()))
                columns = [pa.array(list(c)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns],
                                                 names=["_id", "n_lines", "n_dropped", "kept_sha256"])

    return (found.select("_id", "_text", "_dropped")
                 .mapInArrow(digest, f"_id {kind}, n_lines long, n_dropped long, kept_sha256 string")
                 .withColumnRenamed("_id", doc_id))
