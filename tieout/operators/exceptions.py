"""Layer 1 exception queue: routing with sequential ids, resolution,
SLA escalation, the warehouse SLA view and queue summaries.

The queue is a DataFrame (``exceptions_queue`` schema); every state change
returns a new snapshot instead of mutating rows. Time always enters as an
explicit ``as_of`` literal, never the wall clock, so results are
reproducible.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import seq_id
from ..plans.seq import dense_sequence

# fixed values: exception statuses and severities
OPEN, ASSIGNED, ESCALATED, RESOLVED = "open", "assigned", "escalated", "resolved"
SEVERITIES = ("low", "medium", "high", "critical")

# fixed values: SLA hours by severity
SLA_HOURS = {"critical": 1, "high": 4, "medium": 24, "low": 72}
CODE_DEFAULT_SLA = 72   # unknown severity in the Python property
VIEW_DEFAULT_SLA = 24   # unknown severity in the warehouse views

QUEUE_COLUMNS = ["exception_id", "source", "description", "severity", "status", "created_at",
                 "assigned_to", "resolved_at", "resolution_notes"]


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def sla_hours(severity: Column, *, default: int = CODE_DEFAULT_SLA, case_insensitive: bool = False) -> Column:
    sev = F.lower(severity) if case_insensitive else severity
    expr = None
    for k, v in SLA_HOURS.items():
        expr = F.when(sev == k, F.lit(v)) if expr is None else expr.when(sev == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def age_hours(created_at: Column, resolved_at: Column, as_of: str) -> Column:
    """Fractional hours from creation to resolution (or ``as_of``)."""
    end = F.coalesce(resolved_at.cast("timestamp_ntz"), _ts(as_of))
    start = created_at.cast("timestamp_ntz")
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3.6e9)


def sla_breached(status: Column, severity: Column, created_at: Column, resolved_at: Column,
                 as_of: str) -> Column:
    """Never for resolved rows; otherwise age strictly above the SLA."""
    return F.when(status == RESOLVED, F.lit(False)).otherwise(
        age_hours(created_at, resolved_at, as_of) > sla_hours(severity))


def route(issues: DataFrame, *, source: Column | str, description: Column | str,
          severity: Column | str | None = None, default_severity: str = "medium",
          order_by: list[str | Column], as_of: str, start_seq: int = 1) -> DataFrame:
    """Bulk ``route()``: one OPEN exception per issue row with ids
    ``EXC-%06d`` numbered in ``order_by`` order from ``start_seq`` (pass the
    existing queue's ``next_sequence`` to continue it)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    sev = col(severity) if severity is not None else F.lit(default_severity)
    staged = issues.select("*", col(source).alias("_source"), col(description).alias("_description"),
                           sev.alias("_severity"))
    numbered = dense_sequence(staged, order_by, name="_seq", start=start_seq)
    return numbered.select(
        seq_id("EXC", F.col("_seq"), 6).alias("exception_id"),
        F.col("_source").cast("string").alias("source"),
        F.col("_description").cast("string").alias("description"),
        F.col("_severity").cast("string").alias("severity"),
        F.lit(OPEN).alias("status"), _ts(as_of).alias("created_at"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolution_notes"))


def next_sequence(queue: DataFrame) -> DataFrame:
    """One row: the next free numeric id (max ``EXC-n`` + 1; ids are never
    reused)."""
    n = F.regexp_extract("exception_id", r"^EXC-(\d+)$", 1)
    return queue.agg(F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(0)).alias("_m")) \
        .select((F.col("_m") + 1).alias("next_seq"))


class Resolved(NamedTuple):
    queue: DataFrame
    unknown: DataFrame  # resolution requests whose id is not in the queue


def resolve(queue: DataFrame, resolutions: DataFrame, *, as_of: str,
            notes_col: str = "resolution_notes") -> Resolved:
    """Mark ids resolved with ``as_of`` and notes; re-resolving overwrites.
    Resolutions are joined on the id (AQE picks broadcast for a small batch)."""
    notes = resolutions.groupBy("exception_id").agg(
        F.max(F.coalesce(F.col(notes_col), F.lit(""))).alias("_notes"))
    j = queue.join(notes, "exception_id", "left")
    hit = F.col("_notes").isNotNull()
    q = j.select(
        "exception_id", "source", "description", "severity",
        F.when(hit, F.lit(RESOLVED)).otherwise(F.col("status")).alias("status"),
        "created_at", "assigned_to",
        F.when(hit, _ts(as_of)).otherwise(F.col("resolved_at").cast("timestamp_ntz")).alias("resolved_at"),
        F.when(hit, F.col("_notes")).otherwise(F.col("resolution_notes")).alias("resolution_notes"))
    unknown = notes.join(queue.select("exception_id"), "exception_id", "left_anti").select("exception_id")
    return Resolved(q, unknown)


class Escalated(NamedTuple):
    queue: DataFrame
    escalated: DataFrame  # only the rows escalated by this call


def escalate_overdue(queue: DataFrame, *, as_of: str) -> Escalated:
    """Breached and not already escalated -> escalated (open or assigned).
    Idempotent: a second call escalates nothing."""
    newly = sla_breached(F.col("status"), F.col("severity"), F.col("created_at"), F.col("resolved_at"),
                         as_of) & (F.col("status") != ESCALATED)
    marked = queue.withColumn("_esc", newly)
    q = marked.withColumn("status", F.when(F.col("_esc"), F.lit(ESCALATED)).otherwise(F.col("status")))
    return Escalated(q.drop("_esc"), q.filter(F.col("_esc")).drop("_esc"))


def sla_view(queue: DataFrame, *, as_of: str) -> DataFrame:
    """``v_exceptions_sla``: all columns + whole-hour age (truncated),
    sla_hours (unknown -> 24) and is_sla_breached. Resolved rows are NOT
    exempt here (unlike the Python property)."""
    end = F.coalesce(F.col("resolved_at").cast("timestamp_ntz"), _ts(as_of))
    age = F.expr("timestampdiff(HOUR, created_at, _end)")
    # the views compare UPPER(severity); lower-casing the input is equivalent
    sla = sla_hours(F.lower("severity"), default=VIEW_DEFAULT_SLA)
    return queue.withColumn("_end", end).select(
        *QUEUE_COLUMNS, age.cast("long").alias("age_hours"), sla.alias("sla_hours"),
        (age > sla).alias("is_sla_breached"))


def open_exceptions(queue: DataFrame) -> DataFrame:
    """Exceptions not yet resolved (open, assigned or escalated)."""
    return queue.filter(F.col("status") != RESOLVED)


def fifo(queue: DataFrame) -> DataFrame:
    """Queue in creation order: created_at, then the numeric id as the
    tie-breaker (ids are assigned in creation order and grow past their
    zero-padded width, so the string order alone is not enough)."""
    n = F.regexp_extract("exception_id", r"(\d+)$", 1)
    return queue.orderBy("created_at", F.when(n != "", n.cast("long")), "exception_id")


def open_count(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("status") != RESOLVED).alias("open"))


def queue_summary(queue: DataFrame) -> DataFrame:
    """Long-form summary in ONE aggregation pass (grouping sets):
    (dimension, value, n) for status, severity and the totals."""
    g = queue.groupingSets([["status"], ["severity"], []], "status", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != RESOLVED).alias("_open"),
        F.grouping_id().alias("_gid"))
    # _gid: 1 -> grouped by status, 2 -> by severity, 3 -> grand total
    rows = F.when(F.col("_gid") == 1, F.array(F.struct(F.lit("status").alias("dimension"),
                                                       F.col("status").alias("value"), F.col("n").alias("n")))) \
        .when(F.col("_gid") == 2, F.array(F.struct(F.lit("severity").alias("dimension"),
                                                   F.col("severity").alias("value"), F.col("n").alias("n")))) \
        .otherwise(F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value"), F.col("n").alias("n")),
                           F.struct(F.lit("open").alias("dimension"), F.lit("all").alias("value"),
                                    F.col("_open").alias("n"))))
    return g.select(F.explode(rows).alias("r")).select("r.*")


def summary_maps(summary: DataFrame) -> DataFrame:
    """The reference's dict form: total, open, by_status, by_severity maps
    (built from the small long-form summary)."""
    def m(dim: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("dimension") == dim,
                                                        F.struct("value", "n"))))
    return summary.agg(F.max(F.when(F.col("dimension") == "total", F.col("n"))).alias("total"),
                       F.max(F.when(F.col("dimension") == "open", F.col("n"))).alias("open"),
                       m("status").alias("by_status"), m("severity").alias("by_severity"))
