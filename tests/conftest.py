import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailfold.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="mailfold-test-ckpt-")
    s = build_session(master="local[4]", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


LOG_SCHEMA = ("seq long, id long, mailbox_id long, thread_id string, sender string, "
              "subject string, snippet string, body string, date string, "
              "processed_at timestamp_ntz, email_type string, domain string, summary string, "
              "requires_reply boolean, deadline string, entities string")


def make_log(spark, rows):
    """rows: dicts with any subset of the log columns; sensible defaults for the rest."""
    import datetime as dt
    full = []
    for i, r in enumerate(rows):
        d = {"seq": i, "id": 1, "mailbox_id": 0, "thread_id": "t", "sender": "a@x",
             "subject": "s", "snippet": "snip", "body": "body", "date": "2026-02-27",
             "processed_at": dt.datetime(2026, 2, 27, 9, 0) + dt.timedelta(minutes=i),
             "email_type": "human", "domain": None, "summary": "sum",
             "requires_reply": False, "deadline": None, "entities": '["Alice"]'}
        d.update(r)
        full.append(d)
    cols = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(d[c] for c in cols) for d in full], LOG_SCHEMA)
