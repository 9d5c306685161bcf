"""The library runs from a plain, default SparkSession started outside the repo
(executor code is pickled by value, so workers need no copy of the package)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
assert len(e.entry(spark).collect()) == 12
q = e.queries()
for name in ["batch_search", "html_to_text_exact", "hash_embed", "lsh_search"]:
    assert q[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("PORTABLE-OK")
"""


def test_plain_session_outside_repo():
    cwd = tempfile.mkdtemp(prefix="portability-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "PORTABLE-OK" in out.stdout, out.stderr[-2000:]
