"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion into Spark's ``noop`` sink (every row is
computed, nothing is collected to the driver).  Each query is run twice and
the faster run is reported (``cold`` has the first runs); ``value`` is the sum
of the reported times.  For the streaming headline (W2) the source files are
written before the clock starts, so the time is the drain itself.  The stored
tables that the reads and searches scan are timed by ``write_state`` and
``write_document_vectors``; a read's own first run (``cold``) writes them once
more for the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailfold.operators import store  # noqa: E402
from mailfold.plans import queries as Q  # noqa: E402
from mailfold.plans.context import Store  # noqa: E402
from mailfold.session import build_session  # noqa: E402
from mailfold.sources.tables import read_table, spread  # noqa: E402

HEADLINE = [
    "write_state",         # D1-D4 and V6 written
    "write_document_vectors",  # V1 stored
    "emails_state",        # D1 fold
    "contacts_state",      # D2
    "follow_ups_state",    # D3
    "deadlines_state",     # D4
    "hash_embed",          # V1
    "cosine_topk",         # V3
    "batch_search",        # V5
    "new_emails_antijoin", # K1
    "needs_reply",         # F1
    "briefing_text",       # Q11
    "stream_dedup",        # W2
]
RUNS = 2

INPUT = {
    "write_state": "events", "write_document_vectors": "documents",
    "emails_state": "events", "contacts_state": "events", "follow_ups_state": "events",
    "deadlines_state": "events", "new_emails_antijoin": "events", "needs_reply": "events",
    "briefing_text": "events", "stream_dedup": "events", "hash_embed": "documents",
    "cosine_topk": "documents", "batch_search": "documents*benchmark",
}


def _input_rows(sf_dir, spec):
    import pyarrow.parquet as pq
    n = 1
    for t in spec.split("*"):
        n *= pq.ParquetFile(os.path.join(sf_dir, f"{t}.parquet")).metadata.num_rows
    return n


def _run(spark, sf_dir, name):
    if name == "stream_dedup":
        s = Store(spark, sf_dir)
        prepared = Q._stream_source(s)                    # fixture, untimed
        t0 = time.perf_counter()
        df = Q.stream_dedup_drain(s, *prepared)
    elif name == "write_state":
        s = Store(spark, sf_dir)
        t0 = time.perf_counter()
        df = store.write_state(spark, s.folded, s.contacts).emails
    elif name == "write_document_vectors":
        docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
        t0 = time.perf_counter()
        df = store.vector_store(spark, docs, "text", "bench-vectors").select("doc_id")
    else:
        t0 = time.perf_counter()
        df = Q.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0, df


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    only = sys.argv[1:] or HEADLINE
    # warm the JVM and the Python workers once, untimed
    Q.QUERIES["email_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(cpus * 4, numPartitions=cpus).mapInPandas(
        lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    times, cold, rows = {}, {}, {}
    for name in only:
        runs = []
        for _ in range(RUNS):
            sec, df = _run(spark, sf_dir, name)
            runs.append(sec)
        cold[name] = round(runs[0], 3)
        times[name] = round(min(runs), 3)
        rows[name] = df.count()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    rate = {n: round(_input_rows(sf_dir, INPUT[n]) / times[n]) for n in times if n in INPUT}
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "cold": cold, "rows": rows,
                      "input_rows_per_sec": rate, "input": {n: INPUT[n] for n in rate},
                      "sf": sf, "cpus": cpus, "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
