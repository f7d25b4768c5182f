import random

from pyspark.sql import functions as F

from tieout.operators import audit as A
from tieout.plans import flows as FL


def records(spark, n=200, seed=42, drop=(), drift=(), outlier=None):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if i in drop:
            continue
        amt = round(rnd.gauss(2000, 200), 2)
        if i in drift:
            amt += 0.01
        if outlier is not None and i == outlier:
            amt = 1_000_000.0
        rows.append((f"TXN-{i:05d}", amt, "finance"))
    return spark.createDataFrame(rows, "txn_id string, amount double, dept string")


def history(spark, n=500, seed=1):
    rnd = random.Random(seed)
    return spark.createDataFrame([(round(rnd.gauss(2000, 200), 2),) for _ in range(n)], "value double")


def test_clean_two_source_flow(spark):
    out = FL.two_source(records(spark), records(spark), history(spark), key="txn_id", amount="amount",
                        as_of="2024-01-01 00:00:00")
    s = out["summary"].first()
    assert s.is_fully_reconciled and s.match_rate == 1.0 and s.overall_status == "PASS"
    assert s.audit_events == 2 and s.chain_valid


def test_outlier_blocks_and_mismatch_routes(spark):
    out = FL.two_source(records(spark, outlier=7), records(spark, outlier=7), history(spark), key="txn_id",
                        amount="amount", as_of="2024-01-01 00:00:00")
    assert out["summary"].first().gate_decision == "block"
    q = FL.mismatch_to_queue(records(spark, n=100), records(spark, n=100, drop=(5, 42, 77)), key="txn_id",
                             value_fields=["amount"], as_of="2024-01-01 00:00:00")
    s = q["summary"].first()
    assert (s.open, s.audit_events, s.chain_valid) == (3, 4, True)
    assert sorted(r.source for r in q["queue"].collect()) == ["TXN-00005", "TXN-00042", "TXN-00077"]


def test_replay_is_deterministic(spark):
    ev = records(spark, n=60).select(F.lit("reconciliation").alias("event_type"),
                                     F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"),
                                     F.lit("pipeline").alias("actor"), F.lit("check").alias("action"),
                                     F.col("txn_id").alias("resource"),
                                     F.to_json(F.struct("amount")).alias("details"))
    a = A.audit_append(ev, order_by=["resource"]).orderBy("seq").select("event_hash").collect()
    b = A.audit_append(ev.repartition(7), order_by=["resource"]).orderBy("seq").select("event_hash").collect()
    assert a == b and len(a) == 60
