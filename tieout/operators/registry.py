"""Layer 3 versioned metric registry.

The registry is an append-only table with one row per (name, version);
every update appends the next version, and readers use the latest view.
Batch register / update return (accepted, rejected) DataFrames instead of
raising per row, so a whole batch is validated in one pass; schema-level
mistakes (unknown or immutable fields) still raise before touching data.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: sensitivity levels and the fields update() may change
SENSITIVITY = ("public", "internal", "confidential", "restricted")
UPDATABLE = ("description", "formula", "owner", "sensitivity", "source_system", "refresh_frequency",
             "sla_hours", "lineage")
COLUMNS = ["name", "version", "description", "formula", "owner", "sensitivity", "source_system",
           "refresh_frequency", "sla_hours", "lineage", "created_at", "updated_at"]
GLOSSARY = ["name", "description", "formula", "owner", "sensitivity", "source_system", "refresh_frequency",
            "version"]


def latest(registry: DataFrame) -> DataFrame:
    """``v_semantic_registry_latest``: the highest version per name. One
    aggregate with ``max_by`` (partial on the map side), no ``rn`` column."""
    cols = [c for c in registry.columns if c != "name"]
    agg = registry.groupBy("name").agg(F.max_by(F.struct(*cols), "version").alias("_l"))
    return agg.select("name", *[F.col(f"_l.{c}").alias(c) for c in cols])


def get(registry: DataFrame, name: str) -> DataFrame:
    return latest(registry.filter(F.col("name") == name))


def count(registry: DataFrame) -> DataFrame:
    return registry.agg(F.countDistinct("name").alias("count"))


def search(registry: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring in name OR description; '' matches all."""
    q = F.lit(query.lower())
    return latest(registry).filter(F.lower("name").contains(q) | F.lower("description").contains(q))


def glossary(registry: DataFrame) -> DataFrame:
    return latest(registry).select(*GLOSSARY).orderBy("name")


class Outcome(NamedTuple):
    registry: DataFrame  # rows to append (accepted)
    rejected: DataFrame  # name + reason
    outcomes: DataFrame | None = None  # register(): one frame with both, written in one pass


def _sens_ok(c: Column) -> Column:
    return F.lower(c).isin(*SENSITIVITY)


def register(registry: DataFrame, metrics: DataFrame, *, as_of: str,
             order_by: list[str] | None = None) -> Outcome:
    """New names only. Per name the batch is reduced by one partial
    aggregate: the first row (by ``order_by``, default description) is
    registered unless the name exists; the rest are rejected and counted
    (``rows``), so a name repeated across a third of the batch never lands
    whole in one task."""
    ts = F.lit(as_of).cast("timestamp_ntz")
    order = order_by or ["description"]
    cols = [c for c in metrics.columns if c != "name"]
    rec = F.struct(*[F.col(c) for c in cols])
    ordc = F.struct(*[F.col(c) for c in order])
    # one union-tag aggregate: batch rows and existing names meet per name
    batch = metrics.select("name", rec.alias("_rec"), ordc.alias("_ord"), F.lit(1).alias("_b"),
                           F.lit(0).alias("_e"))
    known = registry.select("name", F.lit(None).cast(batch.schema["_rec"].dataType).alias("_rec"),
                            F.lit(None).cast(batch.schema["_ord"].dataType).alias("_ord"),
                            F.lit(0).alias("_b"), F.lit(1).alias("_e"))
    flagged = batch.unionByName(known).groupBy("name").agg(
        F.min_by("_rec", "_ord").alias("_f"), F.sum("_b").cast("long").alias("_n"),
        F.max("_e").alias("_exists")).filter(F.col("_n") > 0)
    is_new = F.col("_exists") == 0
    sens = F.coalesce(F.col("_f.sensitivity"), F.lit("internal")) if "sensitivity" in cols else F.lit("internal")
    ok = is_new & _sens_ok(sens)

    def field(c: str, default):
        return F.col(f"_f.{c}") if c in cols else default

    definition = [
        F.coalesce(field("version", F.lit(None)).cast("int"), F.lit(1)).alias("version"),
        field("description", F.lit("")).alias("description"), field("formula", F.lit("")).alias("formula"),
        field("owner", F.lit("")).alias("owner"), F.lower(sens).alias("sensitivity"),
        field("source_system", F.lit("")).alias("source_system"),
        field("refresh_frequency", F.lit("daily")).alias("refresh_frequency"),
        field("sla_hours", F.lit(24.0)).cast("double").alias("sla_hours"),
        field("lineage", F.array().cast("array<string>")).alias("lineage"),
        ts.alias("created_at"), ts.alias("updated_at")]
    accepted = flagged.filter(ok).select("name", *definition)
    reasons = F.array_compact(F.array(
        F.when(~is_new, F.struct(F.lit("already registered").alias("reason"), F.col("_n").alias("rows"))),
        F.when(is_new & ~_sens_ok(sens), F.struct(F.lit("invalid sensitivity").alias("reason"),
                                                  F.lit(1).cast("long").alias("rows"))),
        F.when(is_new & (F.col("_n") > 1), F.struct(F.lit("duplicate in batch").alias("reason"),
                                                    (F.col("_n") - 1).alias("rows")))))
    rejected = flagged.select("name", F.explode(reasons).alias("r")).select("name", "r.reason", "r.rows")
    # both results from ONE pass over the per-name aggregate: the registered
    # definition (NULL when rejected) next to every outcome of the name
    registered = F.array(F.struct(F.lit("registered").alias("reason"), F.lit(1).cast("long").alias("rows")))
    empty = F.array().cast("array<struct<reason:string,rows:bigint>>")
    outcome_rows = F.concat(F.when(ok, registered).otherwise(empty), reasons)
    outcomes = flagged.select("name", F.when(ok, F.struct(*definition)).alias("definition"),
                              F.explode(outcome_rows).alias("r")) \
        .select("name", F.col("r.reason").alias("outcome"), F.col("r.rows").alias("rows"), "definition")
    return Outcome(accepted, rejected, outcomes)


def update(registry: DataFrame, patches: DataFrame, *, as_of: str, order_by: list[str] | None = None) -> Outcome:
    """Apply patches (``name`` + any updatable columns; NULL keeps the current
    value) with ``updated_at = as_of``. Several patches of one name apply in
    the order of ``order_by`` (columns of the patches that are not fields of
    a metric; default: the patched fields) and give consecutive versions,
    each on top of the one before. Unknown names and bad sensitivity values
    are rejected per row and take no version."""
    order = order_by or []
    fields = [c for c in patches.columns if c != "name" and c not in order]
    bad_fields = [c for c in fields if c not in UPDATABLE]
    if bad_fields:
        raise ValueError(f"fields {bad_fields} cannot be updated; allowed: {sorted(UPDATABLE)}")
    cur = latest(registry)
    p = patches.select("name", *[F.col(c).alias(f"_p_{c}") for c in fields],
                       *[F.col(c).alias(f"_o_{c}") for c in order])
    j = p.join(cur, "name", "left")
    known = F.col("version").isNotNull()
    sens_ok = (F.col("_p_sensitivity").isNull() | _sens_ok(F.col("_p_sensitivity"))) \
        if "sensitivity" in fields else F.lit(True)
    ok = known & sens_ok
    ts = F.lit(as_of).cast("timestamp_ntz")
    by_name = Window.partitionBy("name").orderBy(*([f"_o_{c}" for c in order] or [f"_p_{c}" for c in fields]))
    so_far = by_name.rowsBetween(Window.unboundedPreceding, 0)

    def pick(c: str) -> Column:
        if c not in fields:
            return F.col(c)
        v = F.lower(F.col(f"_p_{c}")) if c == "sensitivity" else F.col(f"_p_{c}")
        return F.coalesce(F.last(v.cast(cur.schema[c].dataType), ignorenulls=True).over(so_far), F.col(c))

    accepted = j.filter(ok).select(
        "name", (F.col("version") + F.row_number().over(by_name)).cast("int").alias("version"),
        *[pick(c).alias(c) for c in COLUMNS if c not in ("name", "version", "created_at", "updated_at")],
        "created_at", ts.alias("updated_at"))
    rejected = j.filter(~ok).select("name", F.when(~known, "metric not found")
                                    .otherwise("invalid sensitivity").alias("reason"))
    return Outcome(accepted, rejected)


def conformance(observations: DataFrame, registry: DataFrame, *, metric_col: str = "metric_name",
                value_col: str = "value") -> DataFrame:
    """``validate_conformance`` per observation: metric_exists, has_owner,
    has_formula, has_lineage, value_type_valid; version and sensitivity of the
    latest definition. The registry side is small after ``latest`` and AQE
    broadcasts it when its measured size allows."""
    vt = observations.schema[value_col].dataType
    type_ok = isinstance(vt, (T.NumericType, T.StringType, T.BooleanType))
    cur = latest(registry).select(F.col("name").alias(metric_col), "version", "owner", "formula", "lineage",
                                  "sensitivity")
    j = observations.join(cur, metric_col, "left")
    exists = F.col("version").isNotNull()
    checks = F.struct(
        F.lit(True).alias("metric_exists"),
        (F.coalesce(F.length("owner"), F.lit(0)) > 0).alias("has_owner"),
        (F.coalesce(F.length("formula"), F.lit(0)) > 0).alias("has_formula"),
        (F.coalesce(F.size("lineage"), F.lit(0)) > 0).alias("has_lineage"),
        (F.col(value_col).isNotNull() & F.lit(type_ok)).alias("value_type_valid"))
    all_ok = (checks["has_owner"] & checks["has_formula"] & checks["has_lineage"] & checks["value_type_valid"])
    return j.select(
        metric_col, value_col,
        F.when(exists, all_ok).otherwise(F.lit(False)).alias("is_valid"),
        F.when(exists, checks).alias("checks"),
        F.col("version").alias("metric_version"), "sensitivity",
        F.when(~exists, F.concat(F.lit("Metric '"), F.col(metric_col), F.lit("' not found in registry")))
         .alias("error"))


def write_registry(registry: DataFrame, path: str, mode: str = "append") -> None:
    """``semantic_registry`` sink: one file group per sensitivity level so
    parquet min/max stats prune by sensitivity."""
    registry.select(*COLUMNS).repartitionByRange("sensitivity", "name", "version") \
        .sortWithinPartitions("sensitivity", "name") \
        .write.mode(mode).parquet(path)
