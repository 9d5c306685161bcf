"""Plan properties that matter at scale, asserted on executed plans."""

import re

import pytest

from mailfold.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    df = QUERIES[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_hash_aggregates_once(spark):
    plan = _plan(spark, "emails_state")
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    # one exchange for the fold on id (plus at most the spread of a narrow scan)
    assert len(re.findall(r"Exchange hashpartitioning\(id", plan)) == 1
    assert "Subquery" not in plan            # counts and as_of are literals


def test_contacts_single_shuffle(spark):
    plan = _plan(spark, "contacts_state")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "SortAggregate" not in plan and "Join" not in plan


def test_embedding_and_search_do_not_shuffle_the_corpus(spark):
    assert "Exchange hashpartitioning" not in _plan(spark, "hash_embed")
    plan = _plan(spark, "batch_search")
    # the local hits are written; a query's rows meet by salted groups first
    assert "WindowGroupLimit" in plan and "documents" not in plan


def test_stored_reads_prune_and_push(spark):
    plan = _plan(spark, "needs_reply")
    assert re.search(r"PartitionFilters: \[[^\]]*processed_day", plan) and "Aggregate" not in plan
    assert "Exchange" not in _plan(spark, "email_by_id")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(id,42\)", _plan(spark, "email_by_id"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(email_address,", _plan(spark, "contact_by_address"))
    assert re.search(r"PartitionFilters: \[[^\]]*status", _plan(spark, "follow_ups_by_status"))


def test_look_back_pushed_to_scan(spark):
    plan = _plan(spark, "new_emails_antijoin")
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(ts,", plan)


@pytest.mark.parametrize("name", ["briefing_text", "missing_labels", "status_counts",
                                  "topic_emails", "lsh_search", "cosine_topk_dense"])
def test_no_cartesian_products(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _scans(plan):
    """(directory, partition filters) of the plan's file scans."""
    return [(re.search(r"Location: [^\[]*\[([^\]]*)", x), re.search(r"PartitionFilters: \[([^\]]*)", x)[1])
            for x in plan.split("FileScan parquet ")[1:]]


@pytest.mark.parametrize("name", ["email_by_id", "email_lookup"])
def test_a_lookup_opens_one_bucket(spark, name):
    plan = _plan(spark, name)
    scans = _scans(plan)
    assert len(scans) == 1 and re.search(r"id_bucket#\d+ = \d+", scans[0][1])
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_a_mailbox_search_opens_one_bucket(spark):
    df = QUERIES["search_filtered"](spark, SF)
    filters = [f for _, f in _scans(df._jdf.queryExecution().executedPlan().toString()) if "bucket" in f]
    assert filters and all(re.search(r"mailbox_bucket#\d+ = \d+", f) for f in filters)
