"""Plan-shape tests: the scale properties the operators promise."""

import re

from pyspark.sql import functions as F

from tieout.operators import checks as C
from tieout.operators import gate as G
from tieout.operators import match as M
from tieout.operators import policy as P

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange (\w+)", plan(df))


def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


def sides(spark):
    o = orders(spark)
    s = o.select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").alias("amount"))
    t = o.filter(F.col("o_orderkey") % 7 != 0).select(F.col("o_orderkey").cast("string").alias("k"),
                                                     F.col("o_totalprice").alias("amount"))
    return s, t


def test_window_match_is_one_shuffle_on_the_key(spark):
    s, t = sides(spark)
    ex = exchanges(M.match(s, t, ["k"], ["amount"], strategy="window"))
    assert ex == ["hashpartitioning"]


def test_aggregate_match_never_gathers_rows_in_one_partition(spark):
    s, t = sides(spark)
    p = plan(M.match(s, t, ["k"], ["amount"], strategy="aggregate"))
    assert "SinglePartition" not in p
    # the per-key aggregate is partial on the map side (hot keys collapse before the shuffle)
    assert "partial_min" in p or "partial_count" in p


def test_checks_use_one_row_level_shuffle(spark):
    s, t = sides(spark)
    ex = exchanges(C.run_all(s, t, ["k"], "amount"))
    # one shuffle by key; the second exchange only moves partial per-key totals to one row
    assert ex.count("hashpartitioning") == 1 and ex.count("SinglePartition") == 1


def test_global_gate_broadcasts_a_one_row_baseline(spark):
    cur = orders(spark).select(F.col("o_orderkey").cast("string").alias("record_id"),
                               F.col("o_totalprice").alias("value"))
    hist = orders(spark).select(F.col("o_totalprice").alias("value"))
    p = plan(G.validate(cur, hist).records)
    assert "BroadcastNestedLoopJoin" in p or "CartesianProduct" not in p
    assert "BroadcastExchange" in p


def test_scan_is_pruned_and_filters_pushed(spark):
    o = orders(spark).filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    p = o._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in p


def test_static_row_policy_pushes_into_the_scan(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").select(
        F.col("o_orderkey"), F.col("o_orderpriority").alias("sensitivity_level"))
    p = plan(P.visible_rows(df, "analyst"))
    assert "PushedFilters" in p and "Exchange" not in p


def test_match_plans_do_not_depend_on_size(spark):
    s, t = sides(spark)
    assert "partial_" in plan(M.match(s, t, ["k"], ["amount"]))  # the pre-aggregating plan at every size
    assert "sizeInBytes" not in open(M.__file__).read()


def test_match_summary_is_a_hash_aggregate(spark):
    s, t = sides(spark)
    p = plan(M.match_summary(s.withColumn("other", F.lit("x")), t, ["k"], ["amount"]))
    assert "SortAggregate" not in p and "HashAggregate" in p and "other" not in p


def test_three_way_is_one_row_level_shuffle(spark):
    o = orders(spark)
    side = o.select(F.col("o_orderkey").cast("string").alias("txn_id"), F.col("o_totalprice").alias("amount"))
    issues = M.three_way_classify(M.three_way_key_stats(side, side, side))
    ex = exchanges(issues)
    assert ex == ["hashpartitioning"] and "Join" not in plan(issues)


def test_segmented_gate_leaves_the_baseline_join_to_aqe(spark):
    cur = orders(spark).select(F.col("o_orderkey").cast("string").alias("record_id"),
                               F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("segment"))
    hist = orders(spark).select(F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("segment"))
    logical = G.validate_segmented(cur, hist).records._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in logical.lower()  # no forced hint: the segment count is not bounded
    assert "AdaptiveSparkPlan" in G.validate_segmented(cur, hist).records._jdf.queryExecution().executedPlan().toString()
