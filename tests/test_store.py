"""Stored state: same rows as the folds; a failing sink does not stop the others."""

from pyspark.sql import functions as F

from mailfold.operators import store
from mailfold.plans.context import Store

SF = "/root/testdata/sf0.001"


def test_stored_tables_equal_the_folds(spark):
    s = Store(spark, SF)
    pairs = [(s.stored.emails.drop("processed_day"), s.emails), (s.stored.contacts, s.contacts),
             (s.stored.follow_ups, s.follow_ups), (s.stored.deadlines, s.deadlines),
             (s.stored.vectors.select("id", "document"), s.vector_index.select("id", "document"))]
    for got, want in pairs:
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == \
               sorted(map(tuple, want.collect()), key=repr)
    assert s.stored is Store(spark, SF).stored               # written once per session


def test_stored_vectors_are_unit_length(spark):
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    sizes = Store(spark, SF).stored.vectors.select(norm.alias("n"), F.size("vec").alias("d")).distinct().collect()
    assert {r["d"] for r in sizes} == {384} and all(abs(r["n"] - 1) < 1e-9 or r["n"] == 0 for r in sizes)


def test_fan_out_isolates_a_failing_sink(spark):
    good = spark.range(5)
    bad = spark.range(3).select(F.raise_error(F.lit("sink is down")).alias("x"))
    rows = {r["sink"]: r for r in store.fan_out(spark, {"a": good, "b": bad, "c": good}).collect()}
    assert rows["a"]["n"] == rows["c"]["n"] == 5
    assert rows["b"]["n"] is None and "sink is down" in rows["b"]["error"]


def test_lookups_and_mailboxes_from_their_buckets(spark):
    s = Store(spark, SF)
    for email_id in (0, 42, 199, 10**9):
        want = s.folded.where(F.col("id") == email_id).select("id", "first.mailbox_id").collect()
        assert s.stored.of_id(email_id).select("id", "first.mailbox_id").collect() == want
    for mailbox in (0, 3, 99):
        want = sorted(r.id for r in s.stored.vectors.where(F.col("mailbox_id") == mailbox).collect())
        assert sorted(r.id for r in s.stored.vectors.where(s.stored.of_mailbox(mailbox)).collect()) == want


def test_a_table_is_written_when_it_is_first_read(spark):
    s = Store(spark, SF)
    state = store.StoredState(spark, s.folded, s.contacts, 8)
    want = sorted(map(repr, s.folded.collect()))
    assert sorted(map(repr, state.folded.collect())) == want
    assert "vectors" not in vars(state) and "emails" not in vars(state)


def test_the_last_texts_are_stored_once(spark):
    rows = [(1, ("s", 1), ("n", "b"), ("s", "n", "b")), (2, ("s", 1), ("n", None), ("s", "n", "b")),
            (3, (None, 1), ("n", "b"), (None, "n", None)), (4, ("s", 1), (None, "b"), ("t", "m", "b"))]
    df = spark.createDataFrame(rows, "id long, first struct<subject:string,seq:long>, "
                                     "first_text struct<snippet:string,body:string>, "
                                     "last_raw struct<subject:string,snippet:string,body:string>")
    slim = store._without_copies(df)
    assert [r.last_raw.body for r in slim.orderBy("id").collect()] == [None, "b", None, None]
    assert store._with_copies(slim).orderBy("id").collect() == df.orderBy("id").collect()
