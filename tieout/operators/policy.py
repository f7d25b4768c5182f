"""Layer 4 row policies by sensitivity clearance, and the recon-results sink.

Spark does not enforce row access policies itself; these are filter
operators that a serving layer applies for the calling principal. The
static form is a pure predicate (pushed into the parquet scan); the dynamic
form resolves the principal's clearance from ``user_attributes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sensitivity tiers in clearance order
LEVELS = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")
# fixed values: visible tiers per role; None = every row, NULL labels included
ROLE_TIERS = {
    "analyst": ("PUBLIC", "INTERNAL"),
    "finance_lead": ("PUBLIC", "INTERNAL", "CONFIDENTIAL"),
    "data_engineer": ("PUBLIC", "INTERNAL", "CONFIDENTIAL"),
    "auditor": None,
    "pipeline": None,
}


def role_predicate(role: str | None, level_col: str = "sensitivity_level") -> Column:
    """Row visible if any policy of the role matches; no policy -> nothing."""
    if role not in ROLE_TIERS:
        return F.lit(False)
    tiers = ROLE_TIERS[role]
    if tiers is None:
        return F.lit(True)
    return F.coalesce(F.upper(F.col(level_col)).isin(*tiers), F.lit(False))


def visible_rows(df: DataFrame, role: str | None, level_col: str = "sensitivity_level") -> DataFrame:
    return df.filter(role_predicate(role, level_col))


def level_ordinal(c: Column) -> Column:
    expr = None
    for i, lv in enumerate(LEVELS):
        expr = F.when(F.upper(c) == lv, F.lit(i)) if expr is None else expr.when(F.upper(c) == lv, F.lit(i))
    return expr


def visible_rows_for_user(df: DataFrame, user_attributes: DataFrame, user: str, *,
                          user_col: str = "user_email", level_col: str = "sensitivity_level") -> DataFrame:
    """Dynamic policy: clearance from ``user_attributes`` for ``user``; a row
    is visible when ordinal(clearance) >= ordinal(level). RESTRICTED
    clearance also sees unlabelled rows; no entry -> nothing. The directory
    is filtered to the one principal first (a key lookup: at most one row
    per user, aggregated to one row), so the broadcast side is bounded."""
    me = user_attributes.filter(F.col(user_col) == user).agg(
        F.max(level_ordinal(F.col("sensitivity_clearance"))).alias("_clear"))  # exactly one row
    lvl = level_ordinal(F.col(level_col))
    top = len(LEVELS) - 1
    cond = (lvl <= F.col("_clear")) | (lvl.isNull() & (F.col("_clear") == top))
    return df.join(F.broadcast(me), cond, "left_semi")


def recon_results(match_rows: DataFrame, gate_rows: DataFrame | None, *, record_id: Column,
                  source_system: str, target_system: str, created_at: str, amount_field: str = "amount",
                  sensitivity: Column | None = None) -> DataFrame:
    """``reconciliation_results`` rows: Layer 1 status + Layer 2 decision per
    record; ``amount_difference`` = source - target; enums upper-cased for
    the warehouse. One row per match row: a record id that was gated several
    times takes its most severe decision, so the join never multiplies rows;
    a NULL id takes the decision of the NULL id."""
    m = match_rows.select(
        record_id.alias("record_id"), "status",
        (F.col(f"source_record.{amount_field}") - F.col(f"target_record.{amount_field}")).alias("amount_difference"),
        (sensitivity if sensitivity is not None else F.lit(None).cast("string")).alias("sensitivity_level"))
    if gate_rows is not None:
        rank = F.when(F.col("decision") == "block", 2).when(F.col("decision") == "flag", 1).otherwise(0)
        worst = gate_rows.groupBy(F.col("record_id").alias("_of")).agg(
            F.max(F.struct(rank.alias("r"), "z_score", "decision")).alias("_w"))
        m = m.join(worst, F.col("record_id").eqNullSafe(F.col("_of")), "left").select(
            *m.columns, F.col("_w.decision").alias("decision"), F.col("_w.z_score").alias("z_score"))
    else:
        m = m.select("*", F.lit(None).cast("string").alias("decision"), F.lit(None).cast("double").alias("z_score"))
    ts = F.lit(created_at).cast("timestamp_ntz")
    return m.select(
        "record_id", F.lit(source_system).alias("source_system"), F.lit(target_system).alias("target_system"),
        F.upper("status").alias("match_status"), "amount_difference", F.upper("decision").alias("gate_decision"),
        "z_score", "sensitivity_level", ts.alias("created_at"),
        F.date_format(ts, "yyyy-MM-dd").alias("created_date"))
