"""Deterministic defect-seeded inputs derived from the driver's tables.

These are the FIXTURES.md recipes F1-F7 written with the DataFrame API.
Every fixture is a lazy derivation of the parquet tables, so its size grows
with the scale factor. The modulo expressions seed *defects* (drops, drift,
noise); they never subset the data to make a check cheaper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def order_id(key: Column, offset: int = 0) -> Column:
    """``ORD-`` + 9-digit zero padded order key."""
    return F.concat(F.lit("ORD-"), F.lpad((key + F.lit(offset)).cast("string"), 9, "0"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders")


def ntz(ts: str) -> Column:
    return F.expr(f"timestamp_ntz'{ts}'")


# --------------------------------------------------------------------------- F1
def f1_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    base = o.select(
        F.when(k % 1009 == 1, F.lit(None).cast("string")).otherwise(order_id(k)).alias("txn_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("dept"))
    extra = o.filter(k % 89 == 0).select(
        order_id(k).alias("txn_id"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("dept"))
    return base.unionByName(extra)


def f1_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    base = o.filter(k % 20 != 7).select(
        F.when(k % 1009 == 1, F.lit(None).cast("string"))
         .when(k % 3 == 0, F.concat(F.lit("  "), F.lower(order_id(k)), F.lit(" ")))
         .otherwise(order_id(k)).alias("txn_id"),
        F.when(k % 113 == 0, F.lit(None).cast("double"))
         .when(k % 50 == 3, F.col("o_totalprice") + F.lit(0.01))
         .otherwise(F.col("o_totalprice")).alias("amount"),
        F.col("o_orderpriority").alias("dept"))
    dup = o.filter(k % 97 == 0).select(
        order_id(k).alias("txn_id"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("dept"))
    extra = o.filter(k % 41 == 0).select(
        order_id(k, 100000000).alias("txn_id"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("dept"))
    return base.unionByName(dup).unionByName(extra)


# --------------------------------------------------------------------------- F2
F2_SPLIT = "2024-01-25 00:00:00"


def f2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.filter(F.col("ts") >= ntz(F2_SPLIT)).select(
        F.col("event_id").cast("string").alias("record_id"), "value",
        F.col("event_type").alias("segment"), "ts")


def f2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.filter(F.col("ts") < ntz(F2_SPLIT)).select("value", F.col("event_type").alias("segment"), "ts")


def f2_history_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history with one cold segment, for the queries that are about it."""
    e = read_table(spark, sf_dir, "events").filter(~((F.col("event_type") == "signup") & (F.col("event_id") >= 100)))
    return e.filter(F.col("ts") < ntz(F2_SPLIT)).select("value", F.col("event_type").alias("segment"), "ts")


def f2_history_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.filter(F.col("ts") < ntz(F2_SPLIT)).select(
        F.when(F.col("event_id") % 50 == 0, F.col("value") * 100).otherwise(F.col("value")).alias("value"),
        F.col("event_type").alias("segment"), "ts")


# --------------------------------------------------------------------------- F3
def f3_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    gl = o.select(order_id(k).alias("txn_id"), F.col("o_totalprice").alias("amount"))
    proc = o.filter((k % 101 != 5) & (k % 307 != 11)).select(
        order_id(k).alias("txn_id"),
        F.when(k % 211 == 2, F.col("o_totalprice") + 5).otherwise(F.col("o_totalprice")).alias("amount"))
    wh = o.filter((k % 103 != 9) & (k % 307 != 11)).select(
        order_id(k).alias("txn_id"),
        F.when(k % 50 == 3, F.col("o_totalprice") + F.lit(0.01)).otherwise(F.col("o_totalprice")).alias("amount"))
    return gl, proc, wh


# --------------------------------------------------------------------------- F4
F4_AS_OF = "2001-08-02 00:00:00"


def f4_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    sev = (F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
           .when(F.col("o_orderpriority") == "2-HIGH", "high")
           .when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
           .when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("unknown"))
    status = (F.when(k % 4 == 0, "open").when(k % 4 == 1, "assigned")
              .when(k % 4 == 2, "escalated").otherwise("resolved"))
    return o.select(
        F.concat(F.lit("EXC-"), F.lpad(k.cast("string"), 9, "0")).alias("exception_id"),
        F.lit("orders").alias("source"),
        F.concat(F.lit("order "), k.cast("string")).alias("description"),
        sev.alias("severity"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.when(k % 4 == 3, F.col("o_orderdate") + F.expr("INTERVAL 10 HOURS")).alias("resolved_at"),
        F.lit(None).cast("string").alias("resolution_notes"),
    )


# --------------------------------------------------------------------------- F5
def f5_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit event payloads; ``ts``/``event_id`` give the append order."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("src_id"), F.col("ts").alias("timestamp"),
        F.lit("data_access").alias("event_type"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("res-"), (F.col("event_id") % 10).cast("string")).alias("resource"),
        F.col("props").alias("details"))


# --------------------------------------------------------------------------- F6
SENSITIVITY_LEVELS = ["public", "internal", "confidential", "restricted"]


def f6_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.seq import group_row_number
    # version = row_number() over (partition by p_brand order by p_partkey), numbered skew-proof
    p = group_row_number(read_table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], name="_version")
    sens = F.element_at(F.array(*[F.lit(s) for s in SENSITIVITY_LEVELS]),
                        (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select(
        F.col("p_brand").alias("name"),
        F.col("_version").cast("int").alias("version"),
        F.col("p_name").alias("description"),
        F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("SUM("), F.col("p_type"), F.lit(")"))).alias("formula"),
        F.when(F.col("p_size") % 11 == 0, "").otherwise(F.lit("finance")).alias("owner"),
        sens.alias("sensitivity"),
        F.lit("erp").alias("source_system"),
        F.lit("daily").alias("refresh_frequency"),
        F.lit(24.0).alias("sla_hours"),
        F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>"))
         .otherwise(F.array(F.lit("part"), F.col("p_type"))).alias("lineage"),
        ntz("2024-01-01 00:00:00").alias("created_at"),
        ntz("2024-01-01 00:00:00").alias("updated_at"),
    )


# --------------------------------------------------------------------------- F7
def f7_sensitivity(key: Column) -> Column:
    return (F.when(key % 5 == 0, "PUBLIC").when(key % 5 == 1, "INTERNAL")
            .when(key % 5 == 2, "CONFIDENTIAL").when(key % 5 == 3, "RESTRICTED"))
