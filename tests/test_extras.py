import hashlib
import json
import os
import tempfile
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tieout.functions.canonical import python_timestamp_text
from tieout.operators import audit as A
from tieout.operators import controls as K
from tieout.operators import gate as G
from tieout.sources.sinks import write_table
from tieout.streaming.gate_stream import score_stream, write_anomalies


def test_control_summary_and_rollup(spark):
    controls = spark.createDataFrame(
        [("TEST-01", "TEST", "Test Category", "A test control", "Implemented via test", ["test.json"]),
         ("DE.X-01", "DETECT", "Monitoring", "d", "i", ["gate_log.json", "queue.json"])], K.CONTROL_SCHEMA)
    s = K.control_summary(controls).first()
    assert s.total_controls_mapped == 2 and s.functions_covered == ["DETECT", "TEST"]
    assert s.assessment_scope == K.ASSESSMENT_SCOPE and {c.evidence_status for c in s.controls} == {"mapped"}
    assert K.get_control(controls, "TEST-01").count() == 1
    assert K.control_rows(controls).filter("id = 'DE.X-01'").first().evidence == "gate_log.json, queue.json"
    log = spark.createDataFrame([("gate_log.json",), ("gate_log.json",), ("other",)], "resource string")
    r = {x.control_id: (x.artifacts, x.artifacts_with_events, x.evidence_events)
         for x in K.evidence_rollup(controls, log).collect()}
    assert r == {"TEST-01": (1, 0, 0), "DE.X-01": (2, 1, 2)}


def test_streaming_gate_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="tieout-stream-")
    cur = spark.createDataFrame([(f"r{i}", float(v), "s") for i, v in enumerate([10, 11, 9, 50, 10, 12])],
                                "record_id string, value double, segment string")
    cur.write.parquet(f"{d}/in")
    hist = spark.createDataFrame([(float(10 + (i % 5) - 2), "s") for i in range(40)], "value double, segment string")
    base = G.baseline(hist, segment_col="segment")
    stream = spark.readStream.schema(cur.schema).parquet(f"{d}/in")
    q = score_stream(stream, base, segment_col="segment").writeStream.format("memory") \
        .queryName("gate_stream_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.record_id: r.decision for r in spark.sql("SELECT * FROM gate_stream_out").collect()}
    want = {r.record_id: r.decision for r in G.validate_segmented(cur, hist).records.collect()}
    assert got == want and got["r3"] == "block"
    sq = write_anomalies(score_stream(spark.readStream.schema(cur.schema).parquet(f"{d}/in"), base,
                                      segment_col="segment"), f"{d}/anom", f"{d}/ckpt", trigger_once=True,
                         ingested_at="2024-01-02 03:00:00")
    sq.awaitTermination(120)
    assert spark.read.parquet(f"{d}/anom").count() == 1


def _reference_style_chain(events):
    """Chain as the original logger hashed it: sorted-key JSON of the event."""
    prev, out = "0" * 64, []
    for i, (ts, actor, details) in enumerate(events, start=1):
        data = {"event_id": f"AUD-{i:08d}", "event_type": "data_access", "timestamp": str(ts), "actor": actor,
                "action": "read", "resource": "res", "details": details, "previous_hash": prev}
        h = hashlib.sha256(json.dumps(data, sort_keys=True, default=str).encode()).hexdigest()
        out.append((i, f"AUD-{i:08d}", "data_access", ts.replace(tzinfo=None), actor, "read", "res",
                    json.dumps(details), prev, h))
        prev = h
    return out


def test_v1_hash_verifies_reference_style_chain(spark):
    evs = [(datetime(2024, 1, 1, 0, 0, 0, tzinfo=timezone.utc), "ana", {"rate": 0.5, "n": 3}),
           (datetime(2024, 1, 1, 0, 0, 1, 250, tzinfo=timezone.utc), "bo", {"tags": ["b", "a"], "x": "é"}),
           (datetime(2024, 1, 2, 3, 4, 5, 600000, tzinfo=timezone.utc), "cy", {})]
    rows = _reference_style_chain(evs)
    log = spark.createDataFrame(rows, "seq long, event_id string, event_type string, timestamp timestamp_ntz, "
                                      "actor string, action string, resource string, details string, "
                                      "previous_hash string, event_hash string")
    texts = [r.t for r in log.select(python_timestamp_text(F.col("timestamp")).alias("t")).orderBy("t").collect()]
    assert texts == [str(e[0]) for e in evs]
    assert A.verify(log, hash_version=1).verdict.first().valid is True
    bad = log.withColumn("actor", F.when(F.col("seq") == 2, F.lit("eve")).otherwise(F.col("actor")))
    v = A.verify(bad, hash_version=1).verdict.first()
    assert (v.valid, v.event_id, v.violation) == (False, "AUD-00000002", "hash_mismatch")


def test_sink_writers_partition_by_date(spark):
    d = tempfile.mkdtemp(prefix="tieout-sink-")
    q = spark.createDataFrame([("EXC-000001", "s", "x", "high", "open", "2024-01-01 10:00:00"),
                               ("EXC-000002", "s", "x", "low", "open", "2024-01-02 10:00:00")],
                              "exception_id string, source string, description string, severity string, "
                              "status string, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    write_table("exceptions_queue", q, f"{d}/exceptions_queue")
    assert sorted(x for x in os.listdir(f"{d}/exceptions_queue") if x.startswith("created_date=")) == \
        ["created_date=2024-01-01", "created_date=2024-01-02"]
    back = spark.read.parquet(f"{d}/exceptions_queue").filter("created_date = '2024-01-02'")
    assert [r.exception_id for r in back.collect()] == ["EXC-000002"]


def test_gate_decision_events_and_table(spark):
    verdict = G.validate(spark.createDataFrame([("r", 5.0)], "record_id string, value double"),
                         spark.createDataFrame([(float(i % 7),) for i in range(40)], "value double")).verdict
    ev = A.gate_decision_events(verdict, gate_name="g1", timestamp="2024-01-01 00:00:00")
    acc = A.access_events(spark.createDataFrame([("ana", "tbl", "2024-01-01 00:00:01")], "actor string, resource string, "
                                                "timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))
    log = A.audit_append(ev.withColumn("_o", F.lit(0)).unionByName(acc.withColumn("_o", F.lit(1))), order_by=["_o"])
    t = A.gate_decisions_table(log).first()
    v = verdict.first()
    assert (t.gate_name, t.decision, t.record_count, t.anomaly_count) == ("g1", v.gate_decision, 1, v.flagged + v.blocked)
    assert t.baseline_mean == v.baseline_mean and t.event_hash == log.filter("seq = 1").first().event_hash
    a = A.access_log(log).first()
    assert (a.actor, a.action, a.resource) == ("ana", "read", "tbl")


def test_canonical_set(spark):
    from tieout.functions.scalars import canonical_set
    r = spark.range(1).select(canonical_set(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("s")).first()
    assert r.s == ["a", "b"]


def test_registry_and_audit_log_writers(spark):
    from tieout.operators import registry as R
    d = tempfile.mkdtemp(prefix="tieout-sink-")
    m = spark.createDataFrame([("m1", "d", "f", "o", "public"), ("m2", "d", "f", "o", "restricted")],
                              "name string, description string, formula string, owner string, sensitivity string")
    reg = R.register(spark.createDataFrame([], "name string"), m, as_of="2024-01-01 00:00:00").registry
    R.write_registry(reg, f"{d}/semantic_registry")
    back = spark.read.parquet(f"{d}/semantic_registry")
    assert sorted(r.name for r in back.filter("sensitivity = 'restricted'").collect()) == ["m2"]
    ev = spark.createDataFrame([(i, f"2024-01-0{1 + i % 2} 00:00:00") for i in range(6)], "i long, ts string") \
        .select("i", F.col("ts").cast("timestamp_ntz").alias("timestamp"), F.lit("system_event").alias("event_type"),
                F.lit("a").alias("actor"), F.lit("x").alias("action"), F.lit("r").alias("resource"),
                F.lit("{}").alias("details"))
    log = A.audit_append(ev, order_by=["timestamp", "i"])
    write_table("audit_log", log, f"{d}/audit_log")
    stored = spark.read.parquet(f"{d}/audit_log")
    # partition discovery reads the yyyy-MM-dd directories back as DATE values
    assert {str(r.event_date) for r in stored.select("event_date").distinct().collect()} == {"2024-01-01", "2024-01-02"}
    assert A.verify(stored).verdict.first().valid is True


def test_v1_append_continues_reference_style_chains(spark):
    evs = [(datetime(2024, 1, 1, 0, 0, 0, tzinfo=timezone.utc), "ana", {"rate": 0.5, "n": 3}),
           (datetime(2024, 1, 1, 0, 0, 1, 250, tzinfo=timezone.utc), "bo", {"tags": ["b", "a"], "x": "é"}),
           (datetime(2024, 1, 2, 3, 4, 5, 600000, tzinfo=timezone.utc), "cy", {})]
    want = [(r[8], r[9]) for r in _reference_style_chain(evs)]
    df = spark.createDataFrame([(i, e[0].replace(tzinfo=None), e[1], json.dumps(e[2])) for i, e in enumerate(evs)],
                               "i long, timestamp timestamp_ntz, actor string, details string") \
        .select("i", "timestamp", F.lit("data_access").alias("event_type"), "actor", F.lit("read").alias("action"),
                F.lit("res").alias("resource"), "details")
    small = A.audit_append(df, order_by=["i"], hash_version=1).orderBy("seq").collect()
    assert [(r.previous_hash, r.event_hash) for r in small] == want and {r.hash_version for r in small} == {1}
    big = A.audit_append(df, order_by=["i"], hash_version=1, block_rows=2)
    assert [(r.previous_hash, r.event_hash) for r in big.orderBy("seq").collect()] == want
    assert A.verify(big).verdict.first().valid is True  # version read from the stored column
