"""More edge cases from the documented semantics and traps."""

from pyspark.sql import functions as F

from tieout.operators import audit as A
from tieout.operators import checks as C
from tieout.operators import exceptions as X
from tieout.operators import gate as G
from tieout.operators import match as M


def test_numeric_key_widening_matches(spark):
    s = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k int, amount double")
    t = spark.createDataFrame([(1, 10.0), (3, 30.0)], "k long, amount double")
    got = sorted(r.status for r in M.match(s, t, ["k"], ["amount"]).collect())
    assert got == ["matched", "unmatched_source", "unmatched_target"]


def test_missing_key_sample_with_composite_keys(spark):
    s = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", 9)], "a string, b int")
    t = spark.createDataFrame([("x", 1)], "a string, b int")
    r = C.missing_keys_sample(s, t, ["a", "b"], n=2).first()
    assert r.missing_count == 3 and [tuple(x) for x in r.sample] == [("x", 2), ("y", 1)]


def test_re_resolving_overwrites(spark):
    q = X.route(spark.createDataFrame([("T1",)], "txn_id string"), source="txn_id", description=F.lit("gap"),
                order_by=["txn_id"], as_of="2024-01-01 00:00:00")
    r1 = X.resolve(q, spark.createDataFrame([("EXC-000001", "first")], "exception_id string, resolution_notes string"),
                   as_of="2024-01-02 00:00:00").queue
    r2 = X.resolve(r1, spark.createDataFrame([("EXC-000001", "second")], "exception_id string, resolution_notes string"),
                   as_of="2024-01-03 00:00:00").queue.first()
    assert (r2.status, r2.resolution_notes, str(r2.resolved_at)) == ("resolved", "second", "2024-01-03 00:00:00")


def test_purge_of_everything_keeps_an_anchor(spark):
    ev = spark.range(5).select(F.col("id").alias("i"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"),
                               F.lit("system_event").alias("event_type"), F.lit("a").alias("actor"),
                               F.lit("x").alias("action"), F.lit("r").alias("resource"), F.lit("{}").alias("details"))
    log = A.audit_append(ev, order_by=["i"])
    p = A.purge(log, retention_days=1, as_of="2030-01-01 00:00:00")
    assert p.log.count() == 0
    assert p.anchor.first().anchor_hash == log.filter("seq = 5").first().event_hash
    assert A.verify(p.log, anchor_hash=p.anchor.first().anchor_hash).verdict.first().valid is True


def test_null_values_flag_with_zero_score(spark):
    cur = spark.createDataFrame([("r1", None), ("r2", 10.0)], "record_id string, value double")
    hist = spark.createDataFrame([(float(10 + i % 3),) for i in range(40)], "value double")
    rows = {r.record_id: (r.decision, r.z_score) for r in G.validate(cur, hist).records.collect()}
    assert rows["r1"] == ("flag", 0.0) and rows["r2"][0] == "pass"
