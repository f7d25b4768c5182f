"""Headline benchmark: the reference's published micro-benchmarks re-run as
Spark jobs on data derived from the driver's tables at ``$BENCH_SF_DIR``
(default sf0.1).

Method as in the reference harness: inputs are prepared outside the timer
(here: derived from the parquet tables and written once as parquet under
the checkpoint folder), then one warm-up run per operator (all warm-ups
first) and ``$BENCH_REPEATS`` (default 5) timed runs each; the median is
reported. Every
run forces full execution with the ``noop`` sink (nothing is collected
except one-row verdicts). ``rows`` is the number of records the
published rate counts (matching, checks and three-way: the source side alone) and ``records_per_sec`` = rows / median.

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tieout.operators import audit as A  # noqa: E402
from tieout.operators import audit_tree  # noqa: E402
from tieout.operators import checks as C  # noqa: E402
from tieout.operators import exceptions as X  # noqa: E402
from tieout.operators import gate as G  # noqa: E402
from tieout.operators import match as M  # noqa: E402
from tieout.operators import registry as R  # noqa: E402
from tieout.session import build_session, ensure_checkpoint_dir  # noqa: E402
from tieout.sources import fixtures as FX  # noqa: E402
from tieout.sources.tables import read_table  # noqa: E402


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


class Inputs:
    """Materialised inputs (written once, read per run)."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
        self.frames: dict = {}

    def put(self, name: str, df) -> None:
        p = f"{self.base}/{name}"
        df.write.parquet(p)
        # the table handle is opened once (file listing, footers), as a user holds a DataFrame;
        # no data is cached: every run scans the files again
        self.frames[name] = self.spark.read.parquet(p)

    def get(self, name: str):
        return self.frames[name]

    def rows(self, *names: str) -> int:
        return sum(self.get(n).count() for n in names)


def prepare(inp: Inputs) -> None:
    s, d = inp.spark, inp.sf_dir
    inp.put("f1_source", FX.f1_source(s, d))
    inp.put("f1_target", FX.f1_target(s, d))
    # the gate scores every line item (600,000 at sf0.1) against the price history of the orders
    inp.put("gate_current", read_table(s, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"),
        F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("segment")))
    inp.put("gate_history", read_table(s, d, "lineitem").select(
        F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("segment")))
    gl, proc, wh = FX.f3_sources(s, d)
    inp.put("f3_gl", gl)
    inp.put("f3_proc", proc)
    inp.put("f3_wh", wh)
    inp.put("f4_queue", FX.f4_queue(s, d))
    inp.put("f5_events", FX.f5_events(s, d))
    inp.put("f6_registry", FX.f6_registry(s, d))
    inp.put("reg_batch", read_table(s, d, "orders").select(  # distinct names, as in the published run
        F.concat(F.lit("metric-"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderpriority").alias("description"), F.lit("finance").alias("owner")))
    orders = read_table(s, d, "orders")
    inp.put("issues", orders.select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("txn_id"),
                                    F.col("o_orderpriority").alias("priority"), "o_orderkey"))
    inp.put("audit_log", A.audit_append(inp.get("f5_events"), order_by=["timestamp", "src_id"]))
    inp.put("audit_tree", audit_tree.build(inp.get("audit_log"), block_rows=A.BLOCK_ROWS).nodes)


def ops(inp: Inputs) -> dict:
    """name -> (BASELINE metric, run(), input rows)."""
    g = inp.get
    levels = audit_tree._levels(-(-inp.rows("audit_log") // A.BLOCK_ROWS), audit_tree.FANOUT)

    def recorded():
        nodes = g("audit_tree")
        return audit_tree.AuditTree(nodes, audit_tree._head(nodes, levels, inp.rows("audit_log"), audit_tree.FANOUT))

    as_of = "2024-02-01 00:00:00"
    return {
        "match_report": ("two-source record match (report)",
                         lambda: M.match_summary(g("f1_source"), g("f1_target"), ["txn_id"], ["amount"]).collect(),
                         inp.rows("f1_source")),
        "match_rows": ("two-source record match (all result rows)",
                       lambda: _noop(M.match(g("f1_source"), g("f1_target"), ["txn_id"], ["amount"])),
                       inp.rows("f1_source")),
        "zscore_global": ("z-score gate, global baseline",
                          lambda: _gate(G.validate(g("gate_current"), g("gate_history"))),
                          inp.rows("gate_current")),
        "zscore_segmented": ("z-score gate, segmented",
                             lambda: _gate(G.validate_segmented(g("gate_current"), g("gate_history"))),
                             inp.rows("gate_current")),
        "zscore_mad": ("MAD gate, exact medians",
                       lambda: _gate(G.validate(g("gate_current"), g("gate_history"), params=G.GateParams(method="mad"))),
                       inp.rows("gate_current")),
        "check_run_all": ("count + amount + completeness checks",
                          lambda: C.run_all(g("f1_source"), g("f1_target"), ["txn_id"], "amount",
                                            money_scale=2).collect(),
                          inp.rows("f1_source")),
        "audit_append": ("audit append (hash chain)",
                         lambda: _noop(A.audit_append(g("f5_events"), order_by=["timestamp", "src_id"])),
                         inp.rows("f5_events")),
        "audit_verify": ("audit chain verification",
                         lambda: A.verify(g("audit_log"), tree=recorded()).verdict.collect(),
                         inp.rows("audit_log")),
        "exception_routing": ("exception routing",
                              lambda: _noop(X.route(g("issues"), source="txn_id", description=F.lit("gap"),
                                                    severity=F.lit("medium"), order_by=["o_orderkey"], as_of=as_of)),
                              inp.rows("issues")),
        "metric_registration": ("metric registration",
                                lambda: _outcome(R.register(g("f6_registry"), g("reg_batch"), as_of=as_of)),
                                inp.rows("reg_batch")),
        "three_way": ("three-way reconciliation",
                      lambda: _noop(M.three_way_classify(M.three_way_key_stats(g("f3_gl"), g("f3_proc"), g("f3_wh")))),
                      inp.rows("f3_gl")),
        "exceptions_sla_view": ("exceptions SLA view",
                                lambda: _noop(X.sla_view(g("f4_queue"), as_of=FX.F4_AS_OF)),
                                inp.rows("f4_queue")),
    }


def _gate(r) -> None:
    # one pass: records written (noop sink) while the verdict counters are observed
    G.run(r, _noop).collect()


def _outcome(o) -> None:
    # accepted definitions and rejections written as one outcomes table (one pass)
    _noop(o.outcomes)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    spark = build_session()
    inp = Inputs(spark, sf_dir)
    prepare(inp)
    table = ops(inp)
    names = sys.argv[1:] or list(table)
    times, rows, rate = {}, {}, {}
    for name in names:  # one warm-up per operator, all before any timing (JIT-warm JVM)
        table[name][1]()
    for name in names:
        _, fn, n = table[name]
        # settle the JVM between operators (outside the timer): a GC lets Spark's
        # context cleaner drop the previous operator's shuffle files now rather
        # than during the next measurement
        spark.sparkContext._jvm.System.gc()
        time.sleep(1.0)
        samples = []
        for _ in range(repeats):
            t0 = time.time()
            fn()
            samples.append(time.time() - t0)
        med = statistics.median(samples)
        times[name], rows[name] = round(med, 3), n
        rate[name] = round(n / med) if med > 0 else None
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else None, "rows": rows, "records_per_sec": rate,
        "repeats": repeats, "stat": "median", "cpus": int(os.environ.get("BENCH_CPUS", "8")),
        "baseline_metric": {k: table[k][0] for k in names}}))


if __name__ == "__main__":
    main()
