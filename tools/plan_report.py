"""Summarise the executed physical plans of the headline queries into PLANS.md.

    python tools/plan_report.py [sf_dir]

For each query: shuffles (Exchange), joins by strategy, aggregates by kind,
Python stages, and every scan's columns and pushed filters - the facts to
check when asking how a plan behaves at 1000x the data.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailfold.plans.queries import QUERIES  # noqa: E402
from mailfold.session import build_session  # noqa: E402

NAMES = ["emails_state", "contacts_state", "follow_ups_state", "needs_reply",
         "needs_reply_snapshot", "status_counts", "briefing_text", "hash_embed", "cosine_topk",
         "batch_search", "new_emails_antijoin", "scan_unread_ids", "parse_text_messages",
         "label_events", "surrogate_ids", "thread_context"]
OPS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
       "Exchange RoundRobinPartitioning", "BroadcastExchange", "ReusedExchange",
       "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
       "CartesianProduct", "HashAggregate", "SortAggregate", "ObjectHashAggregate",
       "WindowGroupLimit", "TakeOrderedAndProject", "MapInPandas", "ArrowEvalPython",
       "Generate"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    out = ["# Physical plans of the headline queries", "",
           f"Executed plans at `{sf_dir}` on local[8] (AQE final plans), summarised by "
           "`tools/plan_report.py`. Subquery plans (`as_of`, table counts) are included "
           "in the counts.", ""]
    for name in NAMES:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = Counter()
        for op in OPS:
            n = len(re.findall(re.escape(op), plan))
            if n:
                counts[op] = n
        scans = sorted(set(re.findall(
            r"FileScan parquet \[[^\]]*\].*?(?:PartitionFilters: \[[^\]]*\])?,? ?"
            r"(?:PushedFilters: \[[^\]]*\])?, ReadSchema: struct<[^>]*>", plan)))
        out.append(f"## {name}")
        out.append("")
        out.append(", ".join(f"{k} x{v}" for k, v in counts.items()) or "(no operators)")
        out.append("")
        for sc in scans:
            cols = re.search(r"ReadSchema: (struct<[^>]*>)", sc).group(1)
            table = re.search(r"/([a-z]+)\.parquet", sc)
            pushed = re.search(r"PushedFilters: (\[[^\]]*\])", sc)
            parts = re.search(r"PartitionFilters: (\[[^\]]*\])", sc)
            line = f"- scan `{table.group(1) if table else '?'}` reads `{cols}`"
            if pushed and pushed.group(1) != "[]":
                line += f", pushed `{pushed.group(1)}`"
            if parts and parts.group(1) != "[]":
                line += f", partition filters `{parts.group(1)}`"
            out.append(line)
        out.append("")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                           "PLANS.md"), "w") as fh:
        fh.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
