"""Approximate search over compact codes, re-ranked exactly (V9).

A vector is made a unit vector, turned by a fixed random rotation, so that each coordinate
is spread like a normal variable, and each coordinate is kept in two bits (the four levels that
lose least on a normal variable): a sixteenth of the floats.  The index is two tables:

* ``codes``  (id, code): all that a search scans;
* ``exact``  (id_bucket, id, vec), laid out by bucket of the id: a search opens the buckets of
  its shortlist only.

A search scores every code against the unrounded query through a table of partial sums a
byte, keeps the ``n * shortlist`` best ids and ranks those by their exact distance, so the
distances are exact and only membership is approximate.  No row is left out of the scan.
Rows without an id or a vector are not indexed; rows that repeat an id are ranked each by
itself; a zero vector has distance null or one as in the exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from . import search

# The levels and limits of the best two-bit quantiser of a standard normal variable.
LEVELS = (-1.510, -0.4528, 0.4528, 1.510)
LIMITS = (-0.9816, 0.0, 0.9816)


@dataclass(frozen=True)
class CodeIndex:
    codes: DataFrame
    exact: DataFrame
    dim: int
    buckets: int
    seed: int


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, the same for the same seed."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def encode(rows: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Vectors -> two bits a coordinate, four coordinates a byte (the last byte filled up)."""
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    spread = (rows / np.where(norms == 0, 1, norms)) @ turn * np.sqrt(rows.shape[1])
    digits = np.searchsorted(LIMITS, spread).astype(np.uint8)
    digits = np.pad(digits, ((0, 0), (0, -digits.shape[1] % 4)))
    return (digits.reshape(len(rows), -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2, dtype=np.uint8)


def byte_scores(query: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """For every byte of a code and each value of it, its share of the product with the query."""
    turned = np.pad(query @ turn, (0, -len(query) % 4)).reshape(-1, 4)
    digits = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
    return turned @ np.array(LEVELS)[digits].T                      # bytes x 256


def _bucket(value, n: int):
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


def code_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", buckets: int = 64,
               seed: int = 7) -> CodeIndex:
    """Write the two tables of the index.  ``buckets``: choose it so that a bucket is a file or a few."""
    spark, base = vectors.sparkSession, shared_dir(vectors.sparkSession, "codes")
    src = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
           .where("id is not null and vec is not null"))
    first = src.select(F.size("vec")).first()
    dim = first[0] if first else 0

    def run(batches):
        import pyarrow as pa
        turn = rotation(dim, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            # the values of the lists, flat: no row becomes a Python object
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            codes = encode(flat.reshape(batch.num_rows, dim), turn)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())],
                                             names=["id", "code"])

    src.mapInArrow(run, "id long, code binary").write.parquet(f"{base}/codes")
    exact = (src.withColumn("id_bucket", _bucket(F.col("id"), buckets))
             .repartition("id_bucket").sortWithinPartitions("id_bucket", "id"))
    exact.write.partitionBy("id_bucket").parquet(f"{base}/exact")
    return CodeIndex(spark.read.schema("id long, code binary").parquet(f"{base}/codes"),
                     spark.read.schema(exact.schema).parquet(f"{base}/exact"), dim, buckets, seed)


def shortlisted(index: CodeIndex, query_vec, m: int) -> DataFrame:
    """(id, score) of the ``m`` codes that score highest: at most ``m`` rows of each task meet."""
    table = byte_scores(np.asarray(query_vec, np.float64), rotation(index.dim, index.seed))

    def run(batches):
        import pyarrow as pa
        ids, scores, place = np.empty(0, np.int64), np.empty(0), np.arange(len(table))
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            scores = np.concatenate([scores, table[place, codes].sum(axis=1)])
            best = np.lexsort((ids, -scores))[:m]
            ids, scores = ids[best], scores[best]
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scores)], names=["id", "score"])

    return index.codes.mapInArrow(run, "id long, score double").orderBy(F.col("score").desc(), "id").limit(m)


def code_search(index: CodeIndex, query_vec, n: int = 10, shortlist: int = 10) -> DataFrame:
    """V9: id, distance, rank of the ``n`` nearest among the ``n * shortlist`` best codes."""
    if not index.dim:
        return index.exact.sparkSession.createDataFrame([], "id long, distance double, rank long")
    near = shortlisted(index, query_vec, n * shortlist).select("id", _bucket(F.col("id"), index.buckets).alias("b"))
    rows = near.distinct().collect()                                # at most n * shortlist ids
    own = F.col("id_bucket").isin(sorted({r.b for r in rows})) & F.col("id").isin(sorted(r.id for r in rows))
    return search.dense_search(index.exact.where(own), query_vec, n, id_col="id", vec_col="vec", keep=())
