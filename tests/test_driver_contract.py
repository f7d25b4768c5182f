"""The driver imports __spark_entry__ from its own working directory with a
plain session: worker-side Python (Arrow folds, pandas UDFs) must not need
this package on the workers' path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as E
from tieout.operators import audit as A
q = E.queries()
print("ENTRY", E.entry(spark).count())
for name in ["audit_chain_built", "audit_verify_variants", "zscore_mad"]:
    print("ROWS", name, q[name](spark, "/root/testdata/sf0.001").count())
from tieout.sources import fixtures as FX
log = A.audit_append(FX.f5_events(spark, "/root/testdata/sf0.001"), order_by=["timestamp", "src_id"])
print("V1", A.verify(log, hash_version=1).verdict.first().valid)
"""


def test_worker_side_python_needs_no_package_import():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd="/", env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.startswith(("ENTRY", "ROWS", "V1"))]
    assert lines[0] == "ENTRY 1"
    assert "ROWS audit_chain_built 1000" in lines and "ROWS audit_verify_variants 5" in lines
    assert "V1 False" in lines  # a v2 chain does not verify as v1, but the v1 UDF ran on the workers
