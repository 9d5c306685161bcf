"""Hash embedding and nearest-neighbour search against brute force."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from mailfold.functions.vector import hash_embed_sparse, token_index_array
from mailfold.operators import search


def py_embed(text, dim=384):
    vec = [0.0] * dim
    for w in text.lower().split():
        vec[int(hashlib.md5(w.encode()).hexdigest(), 16) % dim] += 1.0
    n = math.sqrt(sum(x * x for x in vec)) or 1.0
    return [x / n for x in vec]


DOCS = [
    (1, "budget dispute with the vendor about invoices"),
    (2, "team lunch on friday at noon"),
    (3, "vendor invoice overdue budget review"),
    (4, "holiday photos from the beach"),
    (5, "Budget BUDGET budget"),
]


def test_hash_embedding_matches_python(spark):
    df = spark.createDataFrame(DOCS, "id long, text string")
    cells = hash_embed_sparse(df, "id", "text").collect()
    got = {}
    for r in cells:
        got.setdefault(r["id"], {})[r["idx"]] = r["weight"]
    for i, t in DOCS:
        ref = py_embed(t)
        assert {k: round(v, 12) for k, v in got[i].items()} == \
               {k: round(v, 12) for k, v in enumerate(ref) if v}


def test_text_search_ranks_and_clamps(spark):
    df = spark.createDataFrame(DOCS, "id long, text string")
    hits = search.text_search(df, F.lit("budget vendor invoice"), 3).collect()
    assert [h["rank"] for h in hits] == [1, 2, 3]
    assert hits[0]["id"] in (1, 3)
    d = [h["distance"] for h in hits]
    assert d == sorted(d)
    assert len(search.text_search(df, F.lit("x"), 50).collect()) == len(DOCS)  # n clamped
    empty = spark.createDataFrame([], "id long, text string")
    assert search.text_search(empty, F.lit("x"), 10).collect() == []


def test_batch_search_equals_brute_force(spark):
    corpus = spark.createDataFrame(DOCS, "id long, text string")
    queries = spark.createDataFrame([(10, "budget"), (11, "beach holiday"), (12, "friday")],
                                    "id long, text string")
    got = search.batch_search(search.corpus_tokens(corpus, "id", "text"),
                              search.corpus_tokens(queries, "id", "text"), n=2,
                              tile=1)          # one query per tile
    got = sorted((r["qid"], r["rank"], r["id"]) for r in got.collect())
    want = []
    for qid, qt in [(10, "budget"), (11, "beach holiday"), (12, "friday")]:
        q = np.array(py_embed(qt))
        dist = sorted((round(1 - float(np.dot(q, py_embed(t))), 9), i) for i, t in DOCS)
        want += [(qid, r + 1, i) for r, (_, i) in enumerate(dist[:2])]
    assert got == sorted(want)


def test_dense_search_with_filter(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(50, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = [float(x) for x in vecs[0]]
    hits = search.dense_search(df, q, 5, where={"label": 1}).collect()
    assert all(h["label"] == 1 for h in hits)
    qn = vecs[0].astype(np.float64)
    ref = sorted((1 - float(np.dot(v.astype(np.float64), qn) /
                            (np.linalg.norm(v.astype(np.float64)) * np.linalg.norm(qn))), i)
                 for i, v in enumerate(vecs) if i % 3 == 1)[:5]
    assert [h["vec_id"] for h in hits] == [i for _, i in ref]


def test_embed_udf_matches_native(spark):
    df = spark.createDataFrame(DOCS, "id long, text string")
    emb = search.embed_udf()
    rows = df.select("id", emb(token_index_array("text")).alias("v")).collect()
    for r in rows:
        ref = py_embed(dict(DOCS)[r["id"]])
        assert np.allclose(r["v"], ref, atol=1e-6)


def test_document_and_metadata(spark):
    df = spark.createDataFrame([("S", None, "snip", "", "a@b", "t", None, "human", None, True)],
                               "subject string, body string, snippet string, summary string, "
                               "sender string, thread_id string, date string, "
                               "email_type string, domain string, requires_reply boolean")
    r = df.select(search.document_text().alias("d"), search.metadata().alias("m")).first()
    assert r["d"] == "S\n\nsnip"
    assert r["m"]["date"] == "" and r["m"]["domain"] == ""


def test_lsh_search_reranks_exactly(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8,))
    vecs = [base + rng.normal(scale=0.05, size=8) for _ in range(20)] + \
           [rng.normal(size=8) for _ in range(80)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    query = [float(x) for x in vecs[0]]
    approx = search.lsh_search(search.lsh_index(df), query, 5)
    hits = approx.collect()
    assert hits[0]["id"] == 0 and hits[0]["rank"] == 1
    assert all(h["id"] < 20 for h in hits)          # near-duplicates share buckets
    exact = search.dense_search(df.withColumnRenamed("vec_id", "id"), query, 5, id_col="id", keep=())
    assert search.lsh_recall(approx, exact) >= 0.8
    few = df.where("vec_id < 3")                     # fewer vectors than asked for: still 1.0
    exact = search.dense_search(few.withColumnRenamed("vec_id", "id"), query, 5, id_col="id", keep=())
    assert search.lsh_recall(search.lsh_search(search.lsh_index(few), query, 5), exact) == 1.0


def test_lsh_recall_on_the_test_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index, found = search.lsh_index(df), []
    for row in df.orderBy("vec_id").limit(8).collect():
        exact = search.dense_search(df.withColumnRenamed("vec_id", "id"), row["embedding"], 10, id_col="id", keep=())
        found.append(search.lsh_recall(search.lsh_search(index, row["embedding"], 10), exact))
    assert sum(found) / len(found) >= 0.9


def test_text_search_native_equals_batch_path(spark):
    df = spark.createDataFrame(DOCS, "id long, text string")
    q = F.lit("budget vendor invoice friday")
    a = [tuple(r) for r in search.text_search(df, q, 4).collect()]
    b = [tuple(r) for r in search.text_search_native(df, q, 4).collect()]
    assert sorted(a) == sorted(b)


def test_hash_embed_cells_equals_native(spark):
    df = spark.createDataFrame(DOCS + [(6, ""), (7, None)], "id long, text string")
    a = sorted((r["id"], r["idx"], r["cnt"], round(r["weight"], 12))
               for r in search.hash_embed_cells(df, "id", "text").collect())
    b = sorted((r["id"], r["idx"], r["cnt"], round(r["weight"], 12))
               for r in hash_embed_sparse(df, "id", "text").collect())
    assert a == b


def test_tiles_and_repeated_query_ids(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rng.choice(words, 6))
    corpus = spark.createDataFrame([(i, text()) for i in range(1500)], "id long, text string").repartition(3)
    queries = [(i % 9, text()) for i in range(9)] * 3 + [(100, text())]
    df = spark.createDataFrame(queries, "id long, text string")
    runs = [sorted(map(tuple, search.batch_search(search.corpus_tokens(corpus, "id", "text"),
                                                  search.corpus_tokens(df, "id", "text"), n=4, tile=tile).collect()))
            for tile in (4, 4096)]
    assert runs[0] == runs[1] and len(runs[0]) == 40
    texts = dict(queries)
    for qid in (3, 100):
        q = np.array(py_embed(texts[qid]))
        best = sorted((round(1 - float(np.dot(q, py_embed(r["text"]))), 9), r["id"]) for r in corpus.collect())[:4]
        assert [r[1] for r in sorted((x for x in runs[0] if x[0] == qid), key=lambda x: x[3])] == [i for _, i in best]


def test_embed_udf_takes_a_model_of_your_own(spark):
    emb = search.embed_udf(lambda: lambda texts: [[float(len(t))] for t in texts])
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    assert {r["id"]: r["v"] for r in df.select("id", emb("text").alias("v")).collect()} == {1: [3.0], 2: [0.0]}

def test_repeated_query_ids_with_different_vectors(spark):
    corpus = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.0, 1.0])], "id long, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])],
                                    "id long, vec array<double>")
    runs = [sorted(map(tuple, search.tiled_search(corpus, queries, 1, dim=2, tile=tile).collect())) for tile in (1, 2, 4096)]
    assert runs[0] == runs[1] == runs[2] == [(1, 0, 0.0, 1), (1, 2, 0.0, 1), (2, 2, 0.0, 1)]


def test_embedding_hashes_each_distinct_token_once(spark, monkeypatch):
    import hashlib
    from mailfold.functions.vector import token_index_array
    from mailfold.operators import search
    texts = ["a b\ta", None, "", " \x0b \n", "É Straße ΟΔΟΣ \x1c x y z", "  a  \r\n B\x0cb "] + [f"w{i % 7} " * 50 for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    emb = search.embed_udf(element="double")
    rows = df.select("id", emb(F.lower("t")).alias("a"), emb(token_index_array("t")).alias("b")).collect()
    assert len(rows) == len(texts) and all(r.a == r.b for r in rows)
    calls = []
    real = hashlib.md5
    monkeypatch.setattr(search.hashlib, "md5", lambda b: calls.append(b) or real(b))
    search._hashed_words(384)(["x y x y"] * 2000)
    assert sorted(calls) == [b"x", b"y"]


def test_embedding_and_search_hold_a_slice_of_an_arrow_batch_at_a_time(spark):
    texts = ["a b"] * 1500 + ["c" * 3_000_000, "d", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").coalesce(1)
    calls = search.embed_udf(lambda: lambda part: [[float(len(part)), float(sum(map(len, part)))] for _ in part])
    got = df.select("id", calls("t").alias("v")).orderBy("id").collect()
    assert len(got) == len(texts) and max(r.v[0] for r in got) <= search.SCORE_ROWS
    assert got[1500].v == [1.0, 3_000_000.0]                       # a long text by itself
    vec = search.embed_udf(element="double")
    corpus = df.where("id < 1504").select("id", vec(F.lower("t")).alias("vec")).coalesce(1)
    query = spark.createDataFrame([(7, py_embed("a b"))], "id long, vec array<double>")
    hits = search.tiled_search(corpus, query, 1490).collect()
    assert sorted(r.id for r in hits) == [*range(1490)] and all(r.distance == 0 for r in hits)
