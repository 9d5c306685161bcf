"""Vector index and nearest-neighbour search.

* index     - J5 document text + J6 metadata per mail, latest write wins (V6);
              from the state fold (``vector_index_from_fold``) or any log
* embedding - hashed bag of words: tokens hashed in-row with native md5, counted
              per Arrow batch with ``numpy.bincount`` (V1, no shuffle), or the
              native two-aggregate form; any model via an iterator Arrow UDF (V2)
* search    - corpus rows in Arrow batches times the query matrix in
              ``mapInArrow``, a running top-n per query and task, then a window
              limit per query (V3 is the one-query case, V5 the many-query one).
              Query vectors are built on the executors and fetched one tile of
              fixed size at a time.  No query x document pair is materialised.
* dense     - stored float vectors, cosine in native higher-order functions
              against a literal query vector, metadata filter first (V3/V4)
* LSH       - random-hyperplane band keys, candidates re-ranked exactly (V9)

Distances are ranked on their value rounded to 9 places, then id, so that
floating-point noise between engines cannot reorder equal vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import nonempty, slices
from ..functions.vector import (cells as corpus_cells, cosine_distance, hash_embed_sparse,
                                token_indexes)
from ..schema import EMBED_DIM
from ..session import shared_dir
from .fold import dense_ordinals

METADATA_FIELDS = ["sender", "subject", "thread_id", "date", "email_type", "domain",
                   "requires_reply", "summary"]
RANK_PLACES = 9
OUT_PLACES = 6


def document_text() -> Column:
    """Subject, then body else snippet, then the summary if any; blank-line separated."""
    return F.concat_ws("\n\n", F.col("subject"),
                       F.coalesce(nonempty("body"), nonempty("snippet")),
                       nonempty("summary"))


def metadata() -> Column:
    """Eight flat fields; NULL date and domain become ''."""
    return F.struct(
        F.col("sender"), F.col("subject"), F.col("thread_id"),
        F.coalesce(F.col("date"), F.lit("")).alias("date"),
        F.col("email_type"),
        F.coalesce(F.col("domain"), F.lit("")).alias("domain"),
        F.col("requires_reply"), F.col("summary"))


def vector_index(log: DataFrame) -> DataFrame:
    """V6: each write upserts (document, metadata) for its id; the latest write wins."""
    latest = log.groupBy("id").agg(
        F.max_by(F.struct(document_text().alias("document"), metadata().alias("metadata")),
                 "seq").alias("v"))
    return latest.select("id", "v.document", "v.metadata")


def vector_index_from_fold(folded: DataFrame, *keep: Column) -> DataFrame:
    """V6 from a state fold whose ``last_raw`` struct holds the latest write's raw
    fields: the same rows as ``vector_index`` over the log, with no extra pass.
    ``keep``: further columns of the fold."""
    r, a = F.col("last_raw"), F.col("last")
    doc = F.concat_ws("\n\n", r["subject"],
                      F.coalesce(nonempty(r["body"]), nonempty(r["snippet"])),
                      nonempty(a["summary"]))
    meta = F.struct(
        r["sender"].alias("sender"), r["subject"].alias("subject"),
        r["thread_id"].alias("thread_id"),
        F.coalesce(r["date"], F.lit("")).alias("date"), a["email_type"].alias("email_type"),
        F.coalesce(a["domain"], F.lit("")).alias("domain"),
        a["requires_reply"].alias("requires_reply"), a["summary"].alias("summary"))
    return folded.select("id", doc.alias("document"), meta.alias("metadata"), *keep)


def reindex(emails: DataFrame) -> DataFrame:
    """V7 / Q13: rebuild the index from the stored mail rows (no model calls)."""
    return emails.select("id", document_text().alias("document"), metadata().alias("metadata"))


def _rank_key(distance: Column) -> Column:
    return F.round(distance, RANK_PLACES)


def text_search(corpus: DataFrame, query_text: Column, n: int = 10,
                id_col: str = "id", text_col: str = "text") -> DataFrame:
    """V3 on text: exact cosine over hashed vectors for one query.

    ``query_text`` is a scalar column (e.g. a scalar subquery).  It runs as a
    one-query batch search: every document is hashed in-row and scored in
    numpy against the broadcast 384-float query, a top-n is kept per task, and
    only those rows meet in the final window - no shuffle of the corpus.
    """
    spark = corpus.sparkSession
    query = token_indexes(spark.range(1).select(F.lit(0).cast("long").alias("id"),
                                                query_text.alias("t")), "id", "t")
    hits = batch_search(token_indexes(corpus, id_col, text_col), query, n)
    return hits.select("id", "distance", "rank")


def vector_search(vectors: DataFrame, query_text: Column, n: int = 10,
                  where: Column | None = None) -> DataFrame:
    """V3 / V4 over a stored vector table (id, vec, and what ``where`` filters on).

    Only the query is tokenised; ``where`` is applied before ranking and reaches
    the scan.  Returns id, distance, rank.
    """
    spark = vectors.sparkSession
    query = token_indexes(spark.range(1).select(F.lit(0).cast("long").alias("id"),
                                                query_text.alias("t")), "id", "t")
    chosen = vectors if where is None else vectors.where(where)
    return tiled_search(chosen.select("id", "vec"), query_vectors(query), n).select("id", "distance", "rank")


def text_search_native(corpus: DataFrame, query_text: Column, n: int = 10,
                       id_col: str = "id", text_col: str = "text") -> DataFrame:
    """V3 in native expressions only: the query's cells (at most 384 rows) are
    broadcast and each document scored by one aggregate over its cells,
    ``sum(cnt * q) / sqrt(sum(cnt^2))``; documents sharing no word keep
    distance 1.  Same rows as ``text_search``."""
    spark = corpus.sparkSession
    q = hash_embed_sparse(spark.range(1).select(F.lit(0).alias("qid"), query_text.alias("t")),
                          "qid", "t").select("idx", F.col("weight").alias("qw"))
    cells = corpus_cells(corpus, id_col, text_col)
    scored = (cells.join(F.broadcast(q), "idx", "left")
              .groupBy("id")
              .agg(F.sum(F.coalesce(F.col("cnt") * F.col("qw"), F.lit(0.0))).alias("s"),
                   F.sum(F.col("cnt") * F.col("cnt")).alias("ss"))
              .select("id", (F.lit(1.0) - F.col("s") / F.sqrt("ss")).alias("distance")))
    return top_n(scored, n)


def top_n(scored: DataFrame, n: int) -> DataFrame:
    """T3 + N5: n nearest (naturally clamped to the collection size), 1-based rank."""
    top = scored.orderBy(_rank_key(F.col("distance")), "id").limit(n)
    w = Window.orderBy(_rank_key(F.col("distance")), "id")
    return top.select("id", F.round("distance", OUT_PLACES).alias("distance"),
                      F.row_number().over(w).cast("bigint").alias("rank"))


def dense_search(vectors: DataFrame, query_vec, n: int = 10,
                 where: dict | None = None, id_col: str = "vec_id",
                 vec_col: str = "embedding", keep=("label",)) -> DataFrame:
    """V3 / V4 on stored vectors; ``where`` is the metadata equality filter (F7),
    applied before ranking so the filter reaches the scan.

    ``query_vec`` is a list of floats (inlined as a literal array, so the
    distance stays one projection over the scan) or an array column.
    """
    if not isinstance(query_vec, Column):
        query_vec = F.array(*[F.lit(float(x)) for x in query_vec]).cast("array<double>")
    cond = metadata_where(where)
    v = vectors.where(cond) if cond is not None else vectors
    scored = v.select(F.col(id_col).alias("id"), *keep,
                      cosine_distance(F.col(vec_col), query_vec).alias("distance"))
    top = scored.orderBy(_rank_key(F.col("distance")), "id").limit(n)
    w = Window.orderBy(_rank_key(F.col("distance")), "id")
    return top.select(F.col("id").alias(id_col), *keep,
                      F.round("distance", OUT_PLACES).alias("distance"),
                      F.row_number().over(w).cast("bigint").alias("rank"))


def metadata_where(where: dict | None) -> Column | None:
    """a conjunction of equality predicates folded from a dict."""
    if not where:
        return None
    cond = None
    for k, v in where.items():
        c = F.col(k) == F.lit(v)
        cond = c if cond is None else cond & c
    return cond


# --------------------------------------------------------------------------
# batch search (V5)
# --------------------------------------------------------------------------

QUERY_TILE = 4096      # query vectors scored against one pass of the corpus (12 MiB at 384 floats)
MERGE_SALTS = 32       # groups in which a query's local hits are merged first
SCORE_ROWS = 512       # corpus rows scored at a time: a block of QUERY_TILE x SCORE_ROWS distances


def _counts(idx_lists, dim: int) -> np.ndarray:
    """Token-index arrays -> one row of token counts each."""
    lists = [() if ix is None else ix for ix in idx_lists]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    if not sizes.sum():
        return np.zeros((len(lists), dim))
    cell = np.repeat(np.arange(len(lists)) * dim, sizes) + np.concatenate([x for x in lists if len(x)])
    return np.bincount(cell.astype(np.int64), minlength=len(lists) * dim).reshape(len(lists), dim)


def _unit_rows(idx_lists, dim: int) -> np.ndarray:
    """Token-index arrays -> L2-normalised count vectors (a zero row stays zero)."""
    m = _counts(idx_lists, dim).astype(np.float64)
    norms = np.sqrt((m * m).sum(axis=1))
    norms[norms == 0] = 1.0
    return m / norms[:, None]


def _blocks(batches, *names: str):
    """The named columns of Arrow batches, ``SCORE_ROWS`` rows at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(name)) for name in names]
        for lo in range(0, batch.num_rows, SCORE_ROWS):
            yield [column.slice(lo, SCORE_ROWS) for column in columns]


def _lists(column) -> list:
    """The lists of an Arrow array as numpy arrays; a null is an empty one."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def _list_array(vectors, of) -> pa.Array:
    """Vectors, one or none a row, as an Arrow array of lists of the type ``of``."""
    return pa.array([v if v is None else np.asarray(v, of.to_pandas_dtype()) for v in vectors], pa.list_(of))


def _local_topn(shared, n, dim, vector_col=False):
    """mapInArrow body: a running top-n per query over this partition's corpus rows.

    ``shared`` holds (query numbers, query ids, query matrix).  Corpus rows are scored in blocks
    of ``SCORE_ROWS`` straight from the Arrow batch, which is all that is held of its size.
    """
    def run(batches):
        qids, names, qmat = shared.value
        best_d = np.empty((len(qids), 0))
        best_i = np.empty((len(qids), 0), dtype=np.int64)
        for ids, part in _blocks(batches, "id", "vec" if vector_col else "idx"):
            ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.stack(_lists(part)).astype(np.float64) if vector_col else _unit_rows(_lists(part), dim)
            dist = 1.0 - qmat @ rows.T                                     # queries x rows
            if best_d.shape[1] == n:
                # rows that are in no query's top n so far need no sorting
                worst = np.round(best_d[:, -1:], RANK_PLACES)
                near = np.flatnonzero((np.round(dist, RANK_PLACES) <= worst).any(axis=0))
                if not len(near):
                    continue
                dist, ids = dist[:, near], ids[near]
            d = np.concatenate([best_d, dist], axis=1)
            i = np.concatenate([best_i, np.broadcast_to(ids, dist.shape)], axis=1)
            # rank by (rounded distance, id) along the axis, for all queries at once
            order = np.lexsort((i, np.round(d, RANK_PLACES)), axis=1)[:, :n]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        if best_i.shape[1]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.asarray(x, dtype=np.int64), best_i.shape[1])) for x in (qids, names)]
                + [pa.array(best_i.reshape(-1)), pa.array(best_d.reshape(-1))], names=["qid", "name", "id", "distance"])
    return run


def hash_embed_cells(df: DataFrame, id_col: str, text_col: str,
                     dim: int = EMBED_DIM) -> DataFrame:
    """V1 without a shuffle: tokens hashed in-row natively, counted per Arrow
    batch with ``numpy.bincount``; emits (id, idx, cnt, weight) for every
    non-zero coordinate.  Same rows as ``hash_embed_sparse``."""
    def cells(batches):
        for ids, part in _blocks(batches, "id", "idx"):
            counts = _counts(_lists(part), dim)
            row, idx = np.nonzero(counts)
            cnt = counts[row, idx].astype(np.int64)
            norm = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.to_numpy(zero_copy_only=False).astype(np.int64)[row]), pa.array(idx.astype(np.int32)),
                 pa.array(cnt), pa.array(cnt / norm[row])], names=["id", "idx", "cnt", "weight"])
    return token_indexes(df, id_col, text_col).mapInArrow(
        cells, "id long, idx int, cnt long, weight double")


def query_vectors(query_tokens: DataFrame, dim: int = EMBED_DIM) -> DataFrame:
    """(id, vec array<double>): unit count vectors built on the executors."""
    def to_vec(batches):
        for ids, part in _blocks(batches, "id", "idx"):
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), _list_array(_unit_rows(_lists(part), dim), pa.float64())], names=["id", "vec"])
    return query_tokens.select("id", "idx").mapInArrow(to_vec, "id long, vec array<double>")


def batch_search(corpus_tokens: DataFrame, query_tokens: DataFrame, n: int = 10,
                 dim: int = EMBED_DIM, tile: int = QUERY_TILE) -> DataFrame:
    """V5: top-n corpus ids for every query row.

    Inputs are ``token_indexes`` rows ``(id, idx array<int>)``: hashing ran
    natively, counting and scoring run per Arrow batch in numpy.
    """
    return tiled_search(corpus_tokens.select("id", "idx"), query_vectors(query_tokens, dim), n, dim, tile)


def tiled_search(corpus: DataFrame, vectors: DataFrame, n: int = 10, dim: int = EMBED_DIM,
                 tile: int = QUERY_TILE) -> DataFrame:
    """Top-n rows of ``corpus`` (id, idx or vec) for every row of ``vectors`` (id, vec).

    The query rows are numbered 0.. and taken ``tile`` at a time, each under its
    number: a tile's
    matrix is the only thing that the driver fetches and broadcasts, the corpus
    is scanned once per tile, and a tile's local top-n rows are written under
    the shared folder before the next tile is fetched.  Query rows that repeat an
    id with another vector each return their own hits; equal rows return them once.  The final top-n of each query merges in two levels,
    by salted groups of tasks first, so a query never meets the rows of all
    tasks in one place.
    """
    spark = corpus.sparkSession
    base = shared_dir(spark, "search")
    by_vector = "vec" in corpus.columns
    vectors.select("id", "vec").dropDuplicates(["id", "vec"]).write.parquet(f"{base}/queries")
    queries = spark.read.schema("id long, vec array<double>").parquet(f"{base}/queries")
    count = queries.count()
    # a number for each query row, so equal ids with different vectors stay apart
    ordered = queries.withColumn("_row", F.monotonically_increasing_id())
    numbered = _numbered(ordered, base) if count else None
    paths, hits = [], "qid long, name long, id long, distance double"
    for k in range(-(-count // tile)):
        rows = (numbered.where(F.col("number").between(k * tile, (k + 1) * tile - 1))
                        .select("number", "id", "vec").toPandas())                   # ``tile`` rows
        shared = spark.sparkContext.broadcast(
            (rows["number"].tolist(), rows["id"].tolist(), np.stack(rows["vec"].to_numpy()).astype(np.float64)))
        paths.append(f"{base}/tile-{k}")
        corpus.mapInArrow(_local_topn(shared, n, dim, by_vector), hits) \
              .write.parquet(paths[-1])
        shared.unpersist()
    if not paths:
        return spark.createDataFrame([], "qid long, id long, distance double, rank long")
    cand = spark.read.schema(hits).parquet(*paths)
    salted = Window.partitionBy("qid", "salt").orderBy(_rank_key(F.col("distance")), "id")
    w = Window.partitionBy("qid").orderBy(_rank_key(F.col("distance")), "id")
    best = (cand.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(MERGE_SALTS)))
            .withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= n)
            .withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= n))
    return best.select(F.col("name").alias("qid"), "id", F.round("distance", OUT_PLACES).alias("distance"), "rank")


def _numbered(ordered: DataFrame, base: str) -> DataFrame:
    """The rows (id, vec, _row) with ``number`` 0.., written under ``base``."""
    numbered = dense_ordinals(ordered, "_row").select("id", "vec", (F.col("ordinal") - 1).cast("long").alias("number"))
    numbered.write.parquet(f"{base}/numbered")
    return ordered.sparkSession.read.schema("id long, vec array<double>, number long").parquet(f"{base}/numbered")


# --------------------------------------------------------------------------
# pluggable embedding (V2)
# --------------------------------------------------------------------------

TOKENS_KNOWN = 200_000   # hashed tokens that a task remembers


def _hashed_words(dim: int):
    """The default model: unit vectors of lower-cased texts or of token-index arrays, by blocks of rows."""
    known: dict[str, int] = {}

    def number(token: str) -> int:
        if len(known) >= TOKENS_KNOWN:
            known.clear()
        at = known[token] = int.from_bytes(hashlib.md5(token.encode()).digest(), "big") % dim
        return at

    def token_lists(texts):
        # 64-bit offsets: a block may hold texts of any length
        words = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        coded = words.flatten().dictionary_encode()
        numbers = np.fromiter((-1 if w == "" else known[w] if w in known else number(w)
                               for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        flat = numbers[coded.indices.to_numpy(zero_copy_only=False)]
        ends = words.offsets.to_numpy(zero_copy_only=False)
        return [x[x >= 0] for x in np.split(flat, ends[1:-1] - ends[0])]

    def model(rows):
        vectors = []
        for lo in range(0, len(rows), SCORE_ROWS):
            part = rows[lo:lo + SCORE_ROWS]
            if any(isinstance(x, str) for x in part):
                part = token_lists(part)
            vectors.extend(_unit_rows(part, dim))
        return vectors
    return model


def embed_udf(make_model=None, dim: int = EMBED_DIM, element: str = "float"):
    """An iterator Arrow UDF; ``make_model()`` runs once per task and
    returns ``values -> list of vectors``, which is called for a slice of rows at a time.

    A model of your own is given texts.  The default is the hashed bag of words:
    it is given lower-cased texts (``F.lower``), splits them by Arrow and hashes each
    distinct token of a block once, or native token indexes
    (``functions.vector.token_index_array``); its vectors are those of V1.
    """
    factory = make_model or (lambda: _hashed_words(dim))
    blank = "" if make_model else ()
    of = {"float": pa.float32(), "double": pa.float64()}[element]

    @F.arrow_udf(f"array<{element}>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for column in batches:
            for part in slices(column, SCORE_ROWS):
                rows = _lists(part) if pa.types.is_list(part.type) else part.to_pylist()
                yield _list_array(model([blank if v is None else v for v in rows]), of)
    return embed


def corpus_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return token_indexes(df, id_col, text_col)


# --------------------------------------------------------------------------
# approximate search (V9)
# --------------------------------------------------------------------------

def _planes(dim: int, bands: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bands * bits))


def _band_keys(mat: np.ndarray, planes: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """Sign bits of the projections, packed per band into one key (band id in the high bits)."""
    signs = (mat @ planes > 0).reshape(len(mat), bands, bits)
    weights = 1 << np.arange(bits, dtype=np.int64)
    codes = (signs * weights).sum(axis=2).astype(np.int64)
    return codes + (np.arange(bands, dtype=np.int64) << bits)


def lsh_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
              bands: int = 16, bits: int = 4, seed: int = 7) -> DataFrame:
    """The stored index: (band, id, vec), one row per vector and band key.

    Keys are computed per Arrow batch with hyperplanes fixed by ``seed``; the
    table is range-partitioned and sorted by key, so a query reads the row
    groups of its own keys.
    """
    first = vectors.select(vec_col).first()
    if first is None:
        raise ValueError("no vectors to index")
    planes = _planes(len(first[0]), bands, bits, seed)

    def sign(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            mat = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            yield pdf.assign(bands=list(_band_keys(mat, planes, bands, bits)))

    kind = vectors.schema[vec_col].dataType.simpleString()
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    keyed = src.mapInPandas(sign, f"id long, vec {kind}, bands array<long>")
    rows = keyed.select(F.explode("bands").alias("band"), "id", "vec")
    path = shared_dir(vectors.sparkSession, "lsh")
    rows.repartitionByRange("band").sortWithinPartitions("band", "id").write.parquet(path)
    return vectors.sparkSession.read.schema(rows.schema).parquet(path)


def lsh_search(index: DataFrame, query_vec, n: int = 10, bands: int = 16, bits: int = 4,
               seed: int = 7) -> DataFrame:
    """V9: the vectors that share at least one band bucket with the query (no cap),
    re-ranked exactly.  Only the buckets of the query's keys are read.  Returns
    id, distance, rank; ``lsh_recall`` compares with the exact search."""
    q = np.asarray(query_vec, dtype=np.float64)[None, :]
    keys = _band_keys(q, _planes(q.shape[1], bands, bits, seed), bands, bits)[0]
    near = index.where(F.col("band").isin([int(k) for k in keys])).groupBy("id").agg(F.first("vec").alias("vec"))
    return dense_search(near, query_vec, n, id_col="id", vec_col="vec", keep=())


def lsh_recall(approx: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits (V3) that the approximate ones hold."""
    wanted = exact.select("id").count()
    return approx.join(exact.select("id"), "id", "left_semi").count() / wanted if wanted else 1.0


THREAD_BLOCK = 64   # turns per context block


def thread_context(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn",
                   block: int = THREAD_BLOCK) -> DataFrame:
    """A7 over conversation threads: ``role: text`` of every turn, joined in turn
    order with the context separator, in blocks of at most ``block`` turns.

    A thread of any length is split into consecutive blocks, each aggregated
    on its own, so no task or value holds more than ``block`` turns; the
    blocks of a thread concatenate (in ``block`` order, with the separator) to
    the whole thread context.
    """
    from ..functions.agg import ordered_listagg
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(order_col).alias("turn"),
        F.floor(F.col(order_col) / block).cast("bigint").alias("block"),
        F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))
    return rows.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.min("turn").alias("first_turn"),
        ordered_listagg("line", "\n\n---\n\n", "turn").alias("context"))
