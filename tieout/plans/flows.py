"""Composed reconciliation flows: the layers wired together as Spark jobs.

Each flow returns a dict of DataFrames (nothing is collected); ``summary`` is
a one-row overview. Audit events are built from one-row verdicts and from
DataFrames of exceptions, then appended as one hash chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import audit_tree
from ..operators import checks as C
from ..operators import exceptions as X
from ..operators import gate as G
from ..operators import match as M
from ..session import stored

ACTOR = "tieout_pipeline"


def _event(df: DataFrame, *, order: tuple[int | Column, int | Column], event_type: str, action: Column,
           resource: Column, details: Column, as_of: str, actor: str = ACTOR) -> DataFrame:
    """Audit event rows from ``df``; ``order`` = (group, position) fixes the
    append order across the unioned event sources."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in order)
    return df.select(
        F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")).alias("_ord"),
        F.lit(event_type).alias("event_type"), F.lit(as_of).cast("timestamp_ntz").alias("timestamp"),
        F.lit(actor).alias("actor"), action.alias("action"), resource.alias("resource"), details.alias("details"))


def _gate_event(verdict: DataFrame, group: int, gate_name: str, as_of: str) -> DataFrame:
    ev = A.gate_decision_events(verdict, gate_name=gate_name, timestamp=as_of, actor=ACTOR)
    return ev.select(F.struct(F.lit(group).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("_ord"),
                     *ev.columns)


def _chain(events: list[DataFrame]) -> DataFrame:
    u = events[0]
    for e in events[1:]:
        u = u.unionByName(e)
    return A.audit_append(u, order_by=["_ord"])


def _recorded(events: list[DataFrame]) -> tuple[DataFrame, A.Verification]:
    """The flow's log with its tree recorded, and its verification against it."""
    log = A.reliable_log(_chain(events))
    return log, A.verify(log, tree=audit_tree.build(log, block_rows=A.BLOCK_ROWS))


def two_source(source: DataFrame, target: DataFrame, history: DataFrame, *, key: str, amount: str,
               as_of: str, params: G.GateParams = G.GateParams(), money_scale: int | None = 2,
               history_value_col: str = "value") -> dict[str, DataFrame]:
    """match -> checks -> z-score gate on source amounts -> two gate-decision
    audit events -> chain verification."""
    results = M.match(source, target, [key], [amount])
    report = M.match_summary(source, target, [key], [amount])  # same report, no pass over the result rows
    checks = C.run_all(source, target, [key], amount, money_scale=money_scale)
    overall = C.overall_status(checks)
    gate = G.validate(source.withColumn("_rid", F.col(key)), history, value_col=amount, record_id_col="_rid",
                      history_value_col=history_value_col, params=params)
    verdict = stored(gate.verdict, "verdict")  # written once, read by the event and the summary
    ev = [
        _event(report, order=(1, 0), event_type="gate_decision",
               action=F.concat(F.lit("gate_"), F.when(F.col("is_fully_reconciled"), "pass").otherwise("fail")),
               resource=F.lit("deterministic_reconciliation"),
               details=F.to_json(F.struct("match_rate")), as_of=as_of),
        _gate_event(verdict, 2, "zscore_anomaly_detection", as_of),
    ]
    log, ver = _recorded(ev)
    summary = report.crossJoin(overall.select("overall_status")) \
        .crossJoin(verdict.select("gate_decision", "blocked")) \
        .crossJoin(log.agg(F.count(F.lit(1)).alias("audit_events"))) \
        .crossJoin(ver.verdict.select(F.col("valid").alias("chain_valid")))  # all one-row frames
    return {"results": results, "report": report, "checks": checks, "overall": overall,
            "gate_records": gate.records, "gate_verdict": verdict, "audit_log": log,
            "verification": ver.verdict, "summary": summary}


def mismatch_to_queue(source: DataFrame, target: DataFrame, *, key: str, value_fields: list[str],
                      as_of: str) -> dict[str, DataFrame]:
    """Unmatched source rows -> HIGH exceptions "missing in target" -> one
    gate event plus one exception_created event per open exception."""
    results = M.match(source, target, [key], value_fields)
    report = M.match_summary(source, target, [key], value_fields)
    unmatched = results.filter(F.col("status") == M.UNMATCHED_SOURCE) \
        .select(F.col(f"source_record.{key}").alias("_src"))
    queue = stored(X.route(unmatched, source="_src", description=F.lit("missing in target"),
                           severity=F.lit("high"), order_by=["_src"], as_of=as_of), "queue")
    open_q = queue.filter(F.col("status") != X.RESOLVED)
    ev = [
        _event(report, order=(0, 0),
               event_type="gate_decision", action=F.lit("gate_fail"), resource=F.lit("match"),
               details=F.to_json(F.struct(F.col("match_rate").alias("rate"),
                                          F.col("unmatched_source_count").alias("unmatched"))), as_of=as_of),
        _event(open_q, order=(1, F.regexp_extract("exception_id", r"(\d+)$", 1)),
               event_type="exception_created", action=F.lit("created"), resource=F.col("exception_id"),
               details=F.to_json(F.struct("severity")), as_of=as_of),
    ]
    log, ver = _recorded(ev)
    summary = X.open_count(queue).crossJoin(log.agg(F.count(F.lit(1)).alias("audit_events"))) \
        .crossJoin(ver.verdict.select(F.col("valid").alias("chain_valid")))
    return {"results": results, "queue": queue, "audit_log": log, "summary": summary}


def three_way(gl: DataFrame, proc: DataFrame, wh: DataFrame, history: DataFrame, *, as_of: str,
              params: G.GateParams = G.GateParams(sigma_threshold=2.5, block_threshold=5.0),
              history_value_col: str = "value") -> dict[str, DataFrame]:
    """Three systems: classify -> route -> gate on ledger amounts -> audit
    (3 pair events + 1 per issue + 1 gate event) -> verify."""
    stats = M.three_way_key_stats(gl, proc, wh)
    issues = M.three_way_classify(stats)
    rank = F.element_at(F.create_map(*[x for i, c in enumerate(M.THREE_WAY_CATEGORIES)
                                       for x in (F.lit(c), F.lit(i))]), F.col("category"))
    queue = stored(X.route(issues.withColumn("_rank", rank), source="txn_id",
                           description=F.concat(F.col("category"), F.lit(": "), F.col("evidence")),
                           severity="severity", order_by=["_rank", "txn_id"], as_of=as_of), "queue")
    pairs = M.three_way_pair_counts(stats)
    gate = G.validate(gl.withColumn("_rid", F.col("txn_id")), history, value_col="amount", record_id_col="_rid",
                      history_value_col=history_value_col, params=params)
    verdict = stored(gate.verdict, "verdict")
    pair_rank = F.when(F.col("left_name") == "GL", F.when(F.col("right_name") == "PROC", 0).otherwise(1)).otherwise(2)
    ev = [
        _event(pairs, order=(0, pair_rank),
               event_type="reconciliation", action=F.concat(F.lit("pair_"), F.col("left_name"), F.lit("_"),
                                                            F.col("right_name")),
               resource=F.lit("multi_source_reconciliation"),
               details=F.to_json(F.struct("only_left", "only_right", "conflicts")), as_of=as_of),
        _event(queue, order=(1, F.regexp_extract("exception_id", r"(\d+)$", 1)),
               event_type="exception_created", action=F.lit("three_way_exception"), resource=F.col("source"),
               details=F.to_json(F.struct(F.split("description", ":").getItem(0).alias("category"), "severity")),
               as_of=as_of),
        _gate_event(verdict, 2, "zscore_gl_amounts", as_of),
    ]
    log, ver = _recorded(ev)
    by_sev = X.queue_summary(queue)
    summary = queue.agg(F.count(F.lit(1)).alias("exceptions"),
                        F.count_if(F.col("severity") == "high").alias("high"),
                        F.count_if(F.col("severity") == "medium").alias("medium"),
                        F.count_if(F.col("severity") == "low").alias("low")) \
        .crossJoin(verdict.select("gate_decision", "passed", "flagged", "blocked")) \
        .crossJoin(log.agg(F.count(F.lit(1)).alias("audit_events"))) \
        .crossJoin(ver.verdict.select(F.col("valid").alias("chain_valid")))
    return {"issues": issues, "queue": queue, "queue_summary": by_sev, "pairs": pairs,
            "gate_records": gate.records, "gate_verdict": verdict, "audit_log": log,
            "verification": ver.verdict, "summary": summary}
