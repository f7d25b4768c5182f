from pyspark.sql import functions as F

from tieout.operators import exceptions as X

AS_OF = "2024-01-02 00:00:00"


def issues(spark):
    return spark.createDataFrame([(f"T{i}", sev) for i, sev in enumerate(["low", "medium", "high", "critical"])],
                                 "txn_id string, severity string")


def test_route_ids_and_defaults(spark):
    q = X.route(issues(spark), source="txn_id", description=F.lit("gap"), severity="severity",
                order_by=["txn_id"], as_of="2024-01-01 22:00:00").orderBy("exception_id").collect()
    assert [r.exception_id for r in q] == ["EXC-000001", "EXC-000002", "EXC-000003", "EXC-000004"]
    assert {r.status for r in q} == {"open"}
    q2 = X.route(issues(spark), source="txn_id", description=F.lit("gap"), order_by=["txn_id"],
                 as_of=AS_OF, start_seq=1234567)
    assert q2.orderBy("exception_id").first().exception_id == "EXC-1234567"  # grows past the width
    assert {r.severity for r in q2.collect()} == {"medium"}


def test_escalate_is_idempotent_and_resolve(spark):
    q = X.route(issues(spark), source="txn_id", description=F.lit("gap"), severity="severity",
                order_by=["txn_id"], as_of="2024-01-01 22:00:00")
    e1 = X.escalate_overdue(q, as_of=AS_OF)  # 2 hours old: critical (1h) breached only
    assert [r.severity for r in e1.escalated.collect()] == ["critical"]
    assert X.escalate_overdue(e1.queue, as_of=AS_OF).escalated.count() == 0
    res = spark.createDataFrame([("EXC-000001", "fixed"), ("EXC-999999", "nope")],
                                "exception_id string, resolution_notes string")
    r = X.resolve(q, res, as_of=AS_OF)
    row = r.queue.filter(F.col("exception_id") == "EXC-000001").first()
    assert row.status == "resolved" and row.resolution_notes == "fixed"
    assert [x.exception_id for x in r.unknown.collect()] == ["EXC-999999"]
    assert X.open_count(r.queue).first().open == 3


def test_sla_view_and_summary(spark):
    q = X.route(issues(spark), source="txn_id", description=F.lit("gap"), severity="severity",
                order_by=["txn_id"], as_of="2024-01-01 22:59:00")
    v = {r.severity: (r.age_hours, r.sla_hours, r.is_sla_breached) for r in X.sla_view(q, as_of=AS_OF).collect()}
    assert v["critical"] == (1, 1, False) and v["low"] == (1, 72, False)
    s = {(r.dimension, r.value): r.n for r in X.queue_summary(q).collect()}
    assert s[("total", "all")] == 4 and s[("open", "all")] == 4 and s[("status", "open")] == 4
    m = X.summary_maps(X.queue_summary(q)).first()
    assert m.by_severity["high"] == 1


def test_open_and_fifo(spark):
    q = X.route(issues(spark), source="txn_id", description=F.lit("gap"), order_by=["txn_id"],
                as_of="2024-01-01 00:00:00", start_seq=999999)
    r = X.resolve(q, spark.createDataFrame([("EXC-1000000", "")], "exception_id string, resolution_notes string"),
                  as_of=AS_OF).queue
    assert [x.exception_id for x in X.fifo(r).collect()] == ["EXC-999999", "EXC-1000000", "EXC-1000001", "EXC-1000002"]
    assert X.open_exceptions(r).count() == 3
