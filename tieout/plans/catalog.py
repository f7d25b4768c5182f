"""Registered queries: one Spark builder per operator plus the equivalent
DuckDB SQL used as the correctness oracle.

Every query reads the driver's tables (or fixtures Spark derives from them
in full) so its work grows with the scale factor. Column names are aliased
identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match as M
from ..sources import fixture_sql as S
from ..sources import fixtures as FX
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# =============================================================== match family
def _f1_match(spark, sf_dir, normalize=True, order_by=None, strategy="aggregate"):
    return M.match(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir), ["txn_id"], ["amount"],
                   normalize_keys=normalize, order_by=order_by, strategy=strategy)


def _status_rows(r: DataFrame) -> DataFrame:
    own_is_tgt = F.col("origin") == "target"
    return r.select(
        "status", "origin",
        F.coalesce("source_key.txn_id", "target_key.txn_id").alias("match_key"),
        F.when(own_is_tgt, F.col("target_record.txn_id")).otherwise(F.col("source_record.txn_id")).alias("own_txn_id"),
        F.when(own_is_tgt, F.col("target_record.amount")).otherwise(F.col("source_record.amount")).alias("own_amount"),
        F.when(F.col("origin") == "pair", F.col("target_record.amount")).alias("pair_target_amount"),
        F.size("conflicts").cast("bigint").alias("n_conflicts"))


def _match_sql_core(src: str, tgt: str, normalize: bool) -> str:
    """DuckDB match over two CTEs with (txn_id, amount, dept)."""
    nk = "lower(trim(txn_id))" if normalize else "txn_id"
    return f"""
u AS (
  SELECT {nk} AS k, true AS is_src, txn_id, amount, dept,
         {{'a': txn_id IS NOT NULL, 'b': coalesce(txn_id, ''), 'c': amount IS NOT NULL,
           'd': coalesce(amount, 0), 'e': dept IS NOT NULL, 'f': coalesce(dept, '')}} AS ord
  FROM {src}
  UNION ALL
  SELECT {nk}, false, txn_id, amount, dept,
         {{'a': txn_id IS NOT NULL, 'b': coalesce(txn_id, ''), 'c': amount IS NOT NULL,
           'd': coalesce(amount, 0), 'e': dept IS NOT NULL, 'f': coalesce(dept, '')}}
  FROM {tgt}),
st AS (
  SELECT k,
         count(*) FILTER (WHERE is_src) AS ns,
         count(*) FILTER (WHERE NOT is_src) AS nt,
         arg_min({{'txn_id': txn_id, 'amount': amount}}, ord) FILTER (WHERE is_src) AS s1,
         arg_min({{'txn_id': txn_id, 'amount': amount}}, ord) FILTER (WHERE NOT is_src) AS t1
  FROM u GROUP BY k),
res AS (
  SELECT CASE WHEN ns = 1 AND nt = 1 THEN
                CASE WHEN (s1.amount IS DISTINCT FROM t1.amount) OR coalesce(isnan(s1.amount), false)
                          OR coalesce(isnan(t1.amount), false) THEN 'conflict' ELSE 'matched' END
              WHEN ns = 1 THEN 'unmatched_source' ELSE 'unmatched_target' END AS status,
         CASE WHEN ns = 1 AND nt = 1 THEN 'pair' WHEN ns = 1 THEN 'source' ELSE 'target' END AS origin,
         k AS match_key,
         CASE WHEN ns = 1 THEN s1.txn_id ELSE t1.txn_id END AS own_txn_id,
         CASE WHEN ns = 1 THEN s1.amount ELSE t1.amount END AS own_amount,
         CASE WHEN ns = 1 AND nt = 1 THEN t1.amount END AS pair_target_amount,
         CAST(CASE WHEN ns = 1 AND nt = 1 AND ((s1.amount IS DISTINCT FROM t1.amount)
                   OR coalesce(isnan(s1.amount), false) OR coalesce(isnan(t1.amount), false))
              THEN 1 ELSE 0 END AS BIGINT) AS n_conflicts,
         s1, t1
  FROM st WHERE ns <= 1 AND nt <= 1
  UNION ALL
  SELECT 'duplicate', CASE WHEN u.is_src THEN 'source' ELSE 'target' END, u.k,
         u.txn_id, u.amount, CAST(NULL AS DOUBLE), CAST(0 AS BIGINT),
         CASE WHEN u.is_src THEN {{'txn_id': u.txn_id, 'amount': u.amount}} ELSE st.s1 END,
         CASE WHEN u.is_src THEN st.t1 ELSE {{'txn_id': u.txn_id, 'amount': u.amount}} END
  FROM u JOIN st ON u.k IS NOT DISTINCT FROM st.k
  WHERE st.ns > 1 OR st.nt > 1)
"""


_F1 = S.with_(f1_source=S.F1_SOURCE, f1_target=S.F1_TARGET)
_ROWS_COLS = "status, origin, match_key, own_txn_id, own_amount, pair_target_amount, n_conflicts"


@register("match_status_rows",
          _F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", True) + f"SELECT {_ROWS_COLS} FROM res")
def q_match_status_rows(spark, sf_dir):
    return _status_rows(_f1_match(spark, sf_dir))


@register("match_window_strategy",
          _F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", True) + f"SELECT {_ROWS_COLS} FROM res")
def q_match_window_strategy(spark, sf_dir):
    return _status_rows(_f1_match(spark, sf_dir, strategy="window"))


@register("match_unnormalized",
          _F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", False)
          + "SELECT status, CAST(count(*) AS BIGINT) AS n FROM res GROUP BY status")
def q_match_unnormalized(spark, sf_dir):
    r = _f1_match(spark, sf_dir, normalize=False)
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("match_duplicates",
          _F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", True) + """
SELECT match_key, origin, own_txn_id, own_amount,
       s1.txn_id AS sample_source_txn_id, s1.amount AS sample_source_amount,
       t1.txn_id AS sample_target_txn_id, t1.amount AS sample_target_amount
FROM res WHERE status = 'duplicate'""")
def q_match_duplicates(spark, sf_dir):
    r = _f1_match(spark, sf_dir, order_by=["txn_id", "amount", "dept"])
    own_is_tgt = F.col("origin") == "target"
    return r.filter(F.col("status") == M.DUPLICATE).select(
        F.coalesce("source_key.txn_id", "target_key.txn_id").alias("match_key"), "origin",
        F.when(own_is_tgt, F.col("target_record.txn_id")).otherwise(F.col("source_record.txn_id")).alias("own_txn_id"),
        F.when(own_is_tgt, F.col("target_record.amount")).otherwise(F.col("source_record.amount")).alias("own_amount"),
        F.col("source_record.txn_id").alias("sample_source_txn_id"),
        F.col("source_record.amount").alias("sample_source_amount"),
        F.col("target_record.txn_id").alias("sample_target_txn_id"),
        F.col("target_record.amount").alias("sample_target_amount"))


@register("match_conflicts_exploded",
          _F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", True) + """
SELECT match_key, 'amount' AS field, s1.amount AS source_value, t1.amount AS target_value
FROM res WHERE status = 'conflict'""")
def q_match_conflicts_exploded(spark, sf_dir):
    r = _f1_match(spark, sf_dir)
    return r.filter(F.col("status") == M.CONFLICT) \
        .select(F.col("source_key.txn_id").alias("match_key"), F.explode("conflicts").alias("c")) \
        .select("match_key", "c.field",
                F.col("c.source_value").cast("double").alias("source_value"),
                F.col("c.target_value").cast("double").alias("target_value"))


@register("match_report",
          _F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", True) + """
SELECT CAST(count(*) FILTER (WHERE origin IN ('source', 'pair')) AS BIGINT) AS source_count,
       CAST(count(*) FILTER (WHERE origin IN ('target', 'pair')) AS BIGINT) AS target_count,
       CAST(count(*) FILTER (WHERE status IN ('matched', 'conflict')) AS BIGINT) AS matched_count,
       CAST(count(*) FILTER (WHERE status = 'unmatched_source') AS BIGINT) AS unmatched_source_count,
       CAST(count(*) FILTER (WHERE status = 'unmatched_target') AS BIGINT) AS unmatched_target_count,
       CAST(count(*) FILTER (WHERE status = 'conflict') AS BIGINT) AS conflict_count,
       CAST(count(*) FILTER (WHERE status = 'duplicate') AS BIGINT) AS duplicate_count,
       CAST(count(*) AS BIGINT) AS result_count,
       round(CASE WHEN count(*) FILTER (WHERE origin IN ('source', 'pair')) > 0
             THEN count(*) FILTER (WHERE status IN ('matched', 'conflict'))
                  / count(*) FILTER (WHERE origin IN ('source', 'pair')) ELSE 0.0 END, 9) AS match_rate,
       count(*) FILTER (WHERE status = 'matched') = count(*) AS is_fully_reconciled
FROM res""")
def q_match_report(spark, sf_dir):
    rep = M.match_report(_f1_match(spark, sf_dir))
    return rep.withColumn("match_rate", F.round("match_rate", 9))


@register("match_summary", ORACLE["match_report"])
def q_match_summary(spark, sf_dir):
    rep = M.match_summary(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir), ["txn_id"], ["amount"])
    return rep.withColumn("match_rate", F.round("match_rate", 9))


_LI_COMPOSITE = """
li_src AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem),
li_tgt AS (SELECT l_orderkey, l_linenumber,
                  CASE WHEN l_suppkey % 17 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
                  l_extendedprice
           FROM lineitem WHERE l_partkey % 13 <> 0),
u AS (SELECT l_orderkey, l_linenumber, true AS is_src, l_quantity, l_extendedprice FROM li_src
      UNION ALL SELECT l_orderkey, l_linenumber, false, l_quantity, l_extendedprice FROM li_tgt),
st AS (SELECT l_orderkey, l_linenumber,
              count(*) FILTER (WHERE is_src) AS ns, count(*) FILTER (WHERE NOT is_src) AS nt,
              min(l_quantity) FILTER (WHERE is_src) AS sq, min(l_quantity) FILTER (WHERE NOT is_src) AS tq,
              min(l_extendedprice) FILTER (WHERE is_src) AS sp, min(l_extendedprice) FILTER (WHERE NOT is_src) AS tp
       FROM u GROUP BY l_orderkey, l_linenumber),
res AS (
  SELECT CASE WHEN ns = 1 AND nt = 1 THEN CASE WHEN sq IS DISTINCT FROM tq OR sp IS DISTINCT FROM tp
                                          THEN 'conflict' ELSE 'matched' END
              WHEN ns = 1 THEN 'unmatched_source' ELSE 'unmatched_target' END AS status
  FROM st WHERE ns <= 1 AND nt <= 1
  UNION ALL
  SELECT 'duplicate' FROM u JOIN st USING (l_orderkey, l_linenumber) WHERE ns > 1 OR nt > 1)
"""


@register("match_composite_key",
          "WITH " + _LI_COMPOSITE + "SELECT status, CAST(count(*) AS BIGINT) AS n FROM res GROUP BY status")
def q_match_composite_key(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    src = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    tgt = li.filter(F.col("l_partkey") % 13 != 0).select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_suppkey") % 17 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice")
    r = M.match(src, tgt, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("match_orders_vs_lineitem", """
WITH o AS (SELECT o_orderkey AS orderkey, o_totalprice AS amount FROM orders),
l AS (SELECT l_orderkey AS orderkey,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount
      FROM lineitem GROUP BY l_orderkey),
st AS (SELECT orderkey, count(o.amount) AS ns, count(l.amount) AS nt, min(o.amount) AS sa, min(l.amount) AS ta
       FROM o FULL OUTER JOIN l USING (orderkey) GROUP BY orderkey)
SELECT CASE WHEN ns = 1 AND nt = 1 THEN CASE WHEN sa IS DISTINCT FROM ta THEN 'conflict' ELSE 'matched' END
            WHEN ns = 1 THEN 'unmatched_source' ELSE 'unmatched_target' END AS status,
       CAST(count(*) AS BIGINT) AS n
FROM st GROUP BY 1""")
def q_match_orders_vs_lineitem(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("amount"))
    li = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    r = M.match(o, li, ["orderkey"], ["amount"])
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ three-way
_F3 = S.with_(f3_gl=S.F3_GL, f3_proc=S.F3_PROC, f3_wh=S.F3_WH)
_F3_STATS = """,
u AS (SELECT lower(trim(txn_id)) AS k, 'g' AS side, txn_id, amount FROM f3_gl
      UNION ALL SELECT lower(trim(txn_id)), 'p', txn_id, amount FROM f3_proc
      UNION ALL SELECT lower(trim(txn_id)), 'w', txn_id, amount FROM f3_wh),
st AS (SELECT k,
         count(*) FILTER (WHERE side = 'g') AS ng, count(*) FILTER (WHERE side = 'p') AS np,
         count(*) FILTER (WHERE side = 'w') AS nw,
         min(txn_id) FILTER (WHERE side = 'g') AS g_raw,
         min(amount) FILTER (WHERE side = 'g') AS ga, min(amount) FILTER (WHERE side = 'p') AS pa,
         min(amount) FILTER (WHERE side = 'w') AS wa
       FROM u GROUP BY k),
issues AS (
  SELECT g_raw AS txn_id, 'LEDGER_ONLY_TRUTH' AS category,
         'present in GL but absent from processor AND warehouse' AS evidence, 'high' AS severity
  FROM st WHERE ng = 1 AND np = 0 AND nw = 0
  UNION ALL
  SELECT g_raw, 'WAREHOUSE_MISSING', 'present in GL + processor but missing from warehouse', 'medium'
  FROM st WHERE ng = 1 AND nw = 0 AND np >= 1
  UNION ALL
  SELECT g_raw, 'PROCESSOR_MISSING', 'present in GL + warehouse but missing from processor', 'high'
  FROM st WHERE ng = 1 AND np = 0 AND nw >= 1
  UNION ALL
  SELECT g_raw, 'WAREHOUSE_DRIFT', printf('GL=%.2f vs WH=%.2f (Δ=%+.2f)', ga, wa, wa - ga), 'low'
  FROM st WHERE ng = 1 AND nw = 1 AND ga IS DISTINCT FROM wa
  UNION ALL
  SELECT g_raw, 'PROCESSOR_DRIFT', printf('GL=%.2f vs PROC=%.2f (Δ=%+.2f)', ga, pa, pa - ga), 'high'
  FROM st WHERE ng = 1 AND np = 1 AND ga IS DISTINCT FROM pa)
"""


def _f3_stats(spark, sf_dir):
    gl, proc, wh = FX.f3_sources(spark, sf_dir)
    return M.three_way_key_stats(gl, proc, wh)


@register("three_way_exceptions", _F3[:-1] + _F3_STATS + "SELECT txn_id, category, evidence, severity FROM issues")
def q_three_way_exceptions(spark, sf_dir):
    return M.three_way_classify(_f3_stats(spark, sf_dir))


@register("three_way_category_counts", _F3[:-1] + _F3_STATS
          + "SELECT category, CAST(count(*) AS BIGINT) AS n FROM issues GROUP BY category")
def q_three_way_category_counts(spark, sf_dir):
    return M.three_way_classify(_f3_stats(spark, sf_dir)).groupBy("category") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("three_way_pair_counts", _F3[:-1] + _F3_STATS + """
SELECT 'GL' AS left_name, 'PROC' AS right_name,
       CAST(count(*) FILTER (WHERE ng = 1 AND np = 0) AS BIGINT) AS only_left,
       CAST(count(*) FILTER (WHERE ng = 0 AND np = 1) AS BIGINT) AS only_right,
       CAST(count(*) FILTER (WHERE ng = 1 AND np = 1 AND ga IS DISTINCT FROM pa) AS BIGINT) AS conflicts FROM st
UNION ALL
SELECT 'GL', 'WH', CAST(count(*) FILTER (WHERE ng = 1 AND nw = 0) AS BIGINT),
       CAST(count(*) FILTER (WHERE ng = 0 AND nw = 1) AS BIGINT),
       CAST(count(*) FILTER (WHERE ng = 1 AND nw = 1 AND ga IS DISTINCT FROM wa) AS BIGINT) FROM st
UNION ALL
SELECT 'PROC', 'WH', CAST(count(*) FILTER (WHERE np = 1 AND nw = 0) AS BIGINT),
       CAST(count(*) FILTER (WHERE np = 0 AND nw = 1) AS BIGINT),
       CAST(count(*) FILTER (WHERE np = 1 AND nw = 1 AND pa IS DISTINCT FROM wa) AS BIGINT) FROM st""")
def q_three_way_pair_counts(spark, sf_dir):
    return M.three_way_pair_counts(_f3_stats(spark, sf_dir))


# ===================================================================== checks
from ..operators import checks as C  # noqa: E402

_CHECK_COLS = ("check_order, check_name, status, message, source_value, target_value, difference, "
               "tolerance_used")
_F1_TOTALS = _F1[:-1] + """,
u AS (SELECT txn_id, true AS s, CAST(amount AS DECIMAL(18, 2)) AS a FROM f1_source
      UNION ALL SELECT txn_id, false, CAST(amount AS DECIMAL(18, 2)) FROM f1_target),
pk AS (SELECT txn_id, count(*) FILTER (WHERE s) AS ns, count(*) FILTER (WHERE NOT s) AS nt,
              sum(a) FILTER (WHERE s) AS sa, sum(a) FILTER (WHERE NOT s) AS ta FROM u GROUP BY txn_id),
tot AS (SELECT sum(ns) AS source_count, sum(nt) AS target_count,
               CAST(sum(sa) AS DOUBLE) AS source_amount, CAST(sum(ta) AS DOUBLE) AS target_amount,
               count(*) FILTER (WHERE ns > 0) AS source_keys, count(*) FILTER (WHERE nt > 0) AS target_keys,
               count(*) FILTER (WHERE ns > 0 AND nt = 0) AS missing_keys FROM pk),
checks AS (
  SELECT 1 AS check_order, 'record_count' AS check_name,
         CASE WHEN target_count = source_count THEN 'PASS' ELSE 'FAIL' END AS status,
         CASE WHEN target_count = source_count THEN printf('Counts match: %d records', source_count)
              ELSE printf('Count mismatch: %+d records', target_count - source_count) END AS message,
         CAST(source_count AS DOUBLE) AS source_value, CAST(target_count AS DOUBLE) AS target_value,
         CAST(target_count - source_count AS DOUBLE) AS difference, CAST(NULL AS DOUBLE) AS tolerance_used
  FROM tot
  UNION ALL
  SELECT 2, 'amount_balance_amount',
         CASE WHEN p <= 0.01 THEN 'PASS' ELSE 'FAIL' END,
         CASE WHEN p <= 0.01 THEN 'amount balanced within 1.00% tolerance'
              ELSE concat('amount mismatch: ', printf('%,.2f', d), ' (',
                          CASE WHEN isinf(p) THEN 'inf%' ELSE printf('%.4f%%', p * 100) END, ' of source)') END,
         source_amount, target_amount, d, 0.01
  FROM (SELECT *, target_amount - source_amount AS d,
               CASE WHEN source_amount = 0 THEN CASE WHEN target_amount = 0 THEN 0.0 ELSE 'inf'::DOUBLE END
                    ELSE abs(target_amount - source_amount) / abs(source_amount) END AS p FROM tot)
  UNION ALL
  SELECT 3, 'key_completeness', CASE WHEN missing_keys = 0 THEN 'PASS' ELSE 'FAIL' END,
         CASE WHEN missing_keys = 0 THEN printf('All %d source keys present in target', source_keys)
              ELSE printf('%d source keys missing in target', missing_keys) END,
         CAST(source_keys AS DOUBLE), CAST(target_keys AS DOUBLE),
         CASE WHEN missing_keys > 0 THEN CAST(missing_keys AS DOUBLE) END, CAST(NULL AS DOUBLE)
  FROM tot)
"""


def _f1_checks(spark, sf_dir):
    return C.run_all(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir), ["txn_id"], "amount",
                     money_scale=2)


@register("check_run_all", _F1_TOTALS + f"SELECT {_CHECK_COLS} FROM checks")
def q_check_run_all(spark, sf_dir):
    return _f1_checks(spark, sf_dir)


@register("check_count", _F1_TOTALS + f"SELECT {_CHECK_COLS} FROM checks WHERE check_order = 1")
def q_check_count(spark, sf_dir):
    t = C.side_totals(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir), ["txn_id"], None)
    return t.select(C.count_check(F.col("source_count"), F.col("target_count")).alias("c")).select("c.*")


@register("check_amount", _F1_TOTALS + f"SELECT {_CHECK_COLS} FROM checks WHERE check_order = 2")
def q_check_amount(spark, sf_dir):
    t = C.side_totals(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir), ["txn_id"], "amount",
                      money_scale=2)
    return t.select(C.amount_check(F.col("source_amount"), F.col("target_amount")).alias("c")).select("c.*")


@register("check_overall_status", _F1_TOTALS + """
SELECT CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL'
            WHEN count(*) FILTER (WHERE status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS overall_status,
       CAST(count(*) AS BIGINT) AS check_count,
       string_agg(check_name || ':' || status, ',' ORDER BY check_order) AS checks
FROM checks""")
def q_check_overall_status(spark, sf_dir):
    o = C.overall_status(_f1_checks(spark, sf_dir))
    return o.select("overall_status", "check_count",
                    F.array_join(F.transform("checks", lambda x: F.concat(x["name"], F.lit(":"), x["status"])),
                                 ",").alias("checks"))


@register("check_completeness_missing", S.with_(f1_source=S.F1_SOURCE, f1_target=S.F1_TARGET) + """
SELECT txn_id FROM (SELECT DISTINCT txn_id FROM f1_source) s
WHERE NOT EXISTS (SELECT 1 FROM f1_target t WHERE t.txn_id IS NOT DISTINCT FROM s.txn_id)""")
def q_check_completeness_missing(spark, sf_dir):
    return C.missing_keys(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir), ["txn_id"])


_ORD_HASH = ("sha256(concat_ws('|', coalesce(length(cast(o_orderkey AS VARCHAR)) || ':' || cast(o_orderkey AS VARCHAR), '~'), "
             "coalesce(length(o_orderstatus) || ':' || o_orderstatus, '~'), "
             "coalesce(length(printf('%.6f', {p})) || ':' || printf('%.6f', {p}), '~')))")


@register("check_row_hash", f"""
WITH expected AS (SELECT o_orderkey, {_ORD_HASH.format(p='o_totalprice')} AS expected_hash FROM orders),
data AS (SELECT o_orderkey, {_ORD_HASH.format(p='CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END')}
                AS actual_hash FROM orders)
SELECT d.o_orderkey, 'hash_integrity' AS check_name,
       CASE WHEN actual_hash = expected_hash THEN 'PASS' ELSE 'FAIL' END AS status,
       CASE WHEN actual_hash = expected_hash THEN 'Hash integrity verified'
            ELSE 'Hash mismatch — possible data tampering' END AS message,
       substr(expected_hash, 1, 16) || '...' AS source_value, substr(actual_hash, 1, 16) || '...' AS target_value
FROM data d LEFT JOIN expected e ON d.o_orderkey = e.o_orderkey""")
def q_check_row_hash(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    expected = o.select("o_orderkey", C.row_hash(o, cols, double_format="%.6f").alias("expected_hash"))
    data = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1)
                        .otherwise(F.col("o_totalprice")))
    return C.hash_integrity(data, expected, ["o_orderkey"], cols, double_format="%.6f")


_F1_FP = """
SELECT CAST(count(*) AS BIGINT) AS row_count,
       CAST(coalesce(sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT), 0) AS VARCHAR) AS lane1_sum,
       CAST(coalesce(sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT), 0) AS VARCHAR) AS lane2_sum
FROM (SELECT sha256(concat_ws('|', coalesce(length(txn_id) || ':' || txn_id, '~'),
                                   coalesce(length(printf('%.6f', amount)) || ':' || printf('%.6f', amount), '~'),
                                   coalesce(length(dept) || ':' || dept, '~'))) AS h FROM {t})"""


@register("check_fingerprint", S.with_(f1_target=S.F1_TARGET) + _F1_FP.format(t="f1_target"))
def q_check_fingerprint(spark, sf_dir):
    t = FX.f1_target(spark, sf_dir)
    return C.fingerprint(t, ["txn_id", "amount", "dept"], double_format="%.6f")


@register("check_fingerprint_compare", S.with_(f1_source=S.F1_SOURCE, f1_target=S.F1_TARGET) + f"""
SELECT 'dataset_fingerprint' AS check_name,
       CASE WHEN s.row_count = t.row_count AND s.lane1_sum = t.lane1_sum AND s.lane2_sum = t.lane2_sum
            THEN 'PASS' ELSE 'FAIL' END AS status,
       s.row_count AS source_rows, t.row_count AS target_rows
FROM ({_F1_FP.format(t="f1_source")}) s, ({_F1_FP.format(t="f1_target")}) t""")
def q_check_fingerprint_compare(spark, sf_dir):
    return C.fingerprint_check(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir),
                               ["txn_id", "amount", "dept"])


@register("check_row_hash_null_and_drift", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN true ELSE o_orderkey % 3 = 2 END AS differs FROM orders""")
def q_check_row_hash_null_and_drift(spark, sf_dir):
    """A NULL boolean is not false, and a drift of 1e-7 shows."""
    o = read_table(spark, sf_dir, "orders")
    third = F.col("o_orderkey") % 3
    before = o.select("o_orderkey", F.when(third != 1, F.lit(False)).alias("flag"), F.col("o_totalprice").alias("v"))
    after = o.select("o_orderkey", F.lit(False).alias("flag"),
                     F.when(third == 2, F.col("o_totalprice") + 1e-7).otherwise(F.col("o_totalprice")).alias("v"))
    cols = ["flag", "v"]
    j = before.select("o_orderkey", C.row_hash(before, cols).alias("a")).join(
        after.select("o_orderkey", C.row_hash(after, cols).alias("b")), "o_orderkey")
    return j.select("o_orderkey", (F.col("a") != F.col("b")).alias("differs"))


# ------------------------------------------------------------------- variance
def _daily_series(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("metric"),
                     F.date_format("ts", "yyyy-MM-dd").alias("period")) \
        .agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


_DAILY_SQL = """
WITH series AS (SELECT event_type AS metric, strftime(ts, '%Y-%m-%d') AS period,
                       CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value
                FROM events GROUP BY 1, 2)
"""


def _var_sql(cur: str, prior: str, metric: str, prefix: str = "period_variance_") -> str:
    p = (f"(CASE WHEN {prior} = 0 THEN CASE WHEN {cur} = 0 THEN 0.0 ELSE 'inf'::DOUBLE END "
         f"ELSE abs({cur} - {prior}) / abs({prior}) END)")
    return f"""'{prefix}' || {metric} AS check_name,
       CASE WHEN {p} <= 0.15 THEN 'PASS' ELSE 'FAIL' END AS status,
       {metric} || ' variance ' || CASE WHEN isinf({p}) THEN 'inf%' ELSE printf('%.2f%%', {p} * 100) END
         || CASE WHEN {p} <= 0.15 THEN ' within 15% threshold' ELSE ' exceeds 15% threshold' END AS message,
       {prior} AS source_value, {cur} AS target_value, {cur} - {prior} AS difference, CAST(0.15 AS DOUBLE) AS tolerance_used"""


@register("variance_period", _DAILY_SQL + f"""
SELECT metric, period, prior_period, {_var_sql('cur', 'prior', 'metric')}
FROM (SELECT metric, period, value AS cur,
             lag(value) OVER (PARTITION BY metric ORDER BY period) AS prior,
             lag(period) OVER (PARTITION BY metric ORDER BY period) AS prior_period FROM series)
WHERE prior_period IS NOT NULL""")
def q_variance_period(spark, sf_dir):
    return C.period_variance(_daily_series(spark, sf_dir))


@register("variance_historical", _DAILY_SQL + f"""
, last AS (SELECT metric, max(period) AS period FROM series GROUP BY metric),
cur AS (SELECT s.metric, s.value FROM series s JOIN last l ON s.metric = l.metric AND s.period = l.period),
hist AS (SELECT s.metric, avg(s.value) AS avg_v FROM series s JOIN last l ON s.metric = l.metric
         WHERE s.period < l.period GROUP BY s.metric)
SELECT metric, check_name, status, message, round(source_value, 6) AS source_value, target_value,
       round(difference, 6) AS difference, tolerance_used
FROM (SELECT cur.metric, {_var_sql('cur.value', 'hist.avg_v', 'cur.metric')}
      FROM cur JOIN hist ON cur.metric = hist.metric)""")
def q_variance_historical(spark, sf_dir):
    s = _daily_series(spark, sf_dir)
    last = s.groupBy("metric").agg(F.max("period").alias("_last"))
    sj = s.join(last, "metric")
    cur = sj.filter(F.col("period") == F.col("_last")).select("metric", "value")
    hist = sj.filter(F.col("period") < F.col("_last")).select("metric", "value")
    # the mean of the history is a float average: report it (and the difference) to micro-units
    return C.historical_variance(cur, hist).withColumn("source_value", F.round("source_value", 6)) \
        .withColumn("difference", F.round("difference", 6))


# ======================================================================= gate
from ..operators import gate as G  # noqa: E402

_F2 = S.with_(cur=S.F2_CURRENT, hist=S.F2_HISTORY, hist_c=S.F2_HISTORY_CONTAMINATED)
_F2_SEG = S.with_(cur=S.F2_CURRENT, hist=S.F2_HISTORY_COLD)


def _median_sql(src: str, val: str, seg: bool) -> str:
    """Exact median as the mean of the two middle values (same arithmetic as
    the Spark operator)."""
    gby = "GROUP BY segment" if seg else ""
    gsel = "segment, " if seg else ""
    part = "PARTITION BY segment" if seg else ""
    return f"""(SELECT {gsel}avg(v) AS m FROM (
        SELECT {gsel}{val} AS v, row_number() OVER ({part} ORDER BY {val}) - 1 AS r,
               count(*) OVER ({part}) AS n FROM {src} WHERE {val} IS NOT NULL)
      WHERE r IN ((n - 1) // 2, n // 2) {gby})"""


def _gate_sql(hist: str, method: str = "zscore", seg: bool = False, min_obs: int = 30,
              block: float = 4.0, sigma: float = 2.5) -> str:
    """CTEs ``bb`` (baseline) and ``rec`` (scored records)."""
    gsel = "segment, " if seg else ""
    gby = "GROUP BY segment" if seg else ""
    if method == "zscore":
        base = f"""b AS (SELECT {gsel}count(value) AS n, avg(value) AS c,
                          coalesce(stddev_samp(value), 'nan'::DOUBLE) AS s
                   FROM {hist} WHERE value IS NOT NULL {gby})"""
    else:
        med = _median_sql(hist, "value", seg)
        on = "USING (segment)" if seg else "ON true"
        devsrc = f"(SELECT {gsel}abs(h.value - md.m) AS d FROM {hist} h JOIN {med} md {on} WHERE h.value IS NOT NULL)"
        mad = _median_sql(devsrc, "d", seg)
        cnt = f"(SELECT {gsel}count(value) AS n FROM {hist} WHERE value IS NOT NULL {gby})"
        base = f"""b AS (SELECT {gsel}cn.n, md.m AS c, ma.m AS s FROM {cnt} cn JOIN {med} md {on}
                         JOIN {mad} ma {on})"""
    z = ("CASE WHEN s = 0 THEN CASE WHEN value = c THEN 0.0 ELSE 'inf'::DOUBLE END ELSE "
         + ("abs(0.6745 * (value - c) / s)" if method == "mad" else "abs(value - c) / s") + " END")
    join = ("cur LEFT JOIN bb ON cur.segment IS NOT DISTINCT FROM bb.segment" if seg else "cur, bb")
    segcol = "cur.segment, " if seg else ""
    return f""",
{base},
bb AS (SELECT {gsel}n, CASE WHEN n >= {min_obs} THEN c ELSE 0.0 END AS c,
              CASE WHEN n >= {min_obs} THEN s ELSE 0.0 END AS s, n >= {min_obs} AS ok FROM b),
sc AS (SELECT record_id, {segcol}value, coalesce(ok, false) AND value IS NOT NULL AS ok, c, s, {z} AS z
       FROM {join}),
rec AS (SELECT record_id, {'segment, ' if seg else ''}value,
   CASE WHEN ok THEN CASE WHEN isnan(z) OR isinf(z) THEN z ELSE round(z, 2) END ELSE 0.0 END AS z_score,
   CASE WHEN ok THEN CASE WHEN isnan(z) THEN 'pass' WHEN z >= {block} THEN 'block'
                          WHEN z >= {sigma} THEN 'flag' ELSE 'pass' END ELSE 'flag' END AS decision,
   CASE WHEN ok THEN round(c, 2) ELSE 0.0 END AS baseline_mean,
   CASE WHEN ok THEN round(s, 2) ELSE 0.0 END AS baseline_std
   FROM sc)
"""


_REC_COLS = "record_id, value, z_score, decision, baseline_mean, baseline_std"


def _rec(r: G.GateResult, seg: bool = False) -> DataFrame:
    cols = ["record_id", *(["segment"] if seg else []), "value", "z_score", "decision", "baseline_mean",
            "baseline_std"]
    return r.records.select(*cols)


def _verdict_sql(global_gate: bool, limit: float = 0.1) -> str:
    bm = "round((SELECT c FROM bb), 6)" if global_gate else "CAST(0.0 AS DOUBLE)"
    bs = "round((SELECT s FROM bb), 6)" if global_gate else "CAST(0.0 AS DOUBLE)"
    invalid = "NOT (SELECT ok FROM bb)" if global_gate else "false"
    return f"""
SELECT CAST(count(*) AS BIGINT) AS total_records,
       CAST(count(*) FILTER (WHERE decision = 'pass') AS BIGINT) AS passed,
       CAST(count(*) FILTER (WHERE decision = 'flag') AS BIGINT) AS flagged,
       CAST(count(*) FILTER (WHERE decision = 'block') AS BIGINT) AS blocked,
       CASE WHEN {invalid} THEN 'flag'
            WHEN count(*) FILTER (WHERE decision = 'block') > 0 THEN 'block'
            WHEN count(*) > 0 AND count(*) FILTER (WHERE decision <> 'pass') / count(*) > {limit} THEN 'block'
            WHEN count(*) FILTER (WHERE decision = 'flag') > 0 THEN 'flag' ELSE 'pass' END AS gate_decision,
       CASE WHEN {invalid} THEN 1.0
            WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE decision <> 'pass') / count(*), 4)
            ELSE 0.0 END AS batch_anomaly_rate,
       {bm} AS baseline_mean, {bs} AS baseline_std,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE decision = 'pass') / count(*) END AS pass_rate
FROM rec"""


def _verdict(r: G.GateResult) -> DataFrame:
    return r.verdict.withColumn("baseline_mean", F.round("baseline_mean", 6)) \
        .withColumn("baseline_std", F.round("baseline_std", 6))


@register("zscore_global", _F2[:-1] + _gate_sql("hist") + f"SELECT {_REC_COLS} FROM rec")
def q_zscore_global(spark, sf_dir):
    return _rec(G.validate(FX.f2_current(spark, sf_dir), FX.f2_history(spark, sf_dir)))


@register("zscore_verdict", _F2[:-1] + _gate_sql("hist") + _verdict_sql(True))
def q_zscore_verdict(spark, sf_dir):
    return _verdict(G.validate(FX.f2_current(spark, sf_dir), FX.f2_history(spark, sf_dir)))


@register("zscore_mad", _F2[:-1] + _gate_sql("hist", "mad") + f"SELECT {_REC_COLS} FROM rec")
def q_zscore_mad(spark, sf_dir):
    return _rec(G.validate(FX.f2_current(spark, sf_dir), FX.f2_history(spark, sf_dir),
                           params=G.GateParams(method="mad")))


@register("zscore_mad_contaminated", _F2[:-1] + _gate_sql("hist_c", "mad")
          + "SELECT decision, CAST(count(*) AS BIGINT) AS n FROM rec GROUP BY decision")
def q_zscore_mad_contaminated(spark, sf_dir):
    r = G.validate(FX.f2_current(spark, sf_dir), FX.f2_history_contaminated(spark, sf_dir),
                   params=G.GateParams(method="mad"))
    return r.records.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@register("zscore_masked_contaminated", _F2[:-1] + _gate_sql("hist_c")
          + "SELECT decision, CAST(count(*) AS BIGINT) AS n FROM rec GROUP BY decision")
def q_zscore_masked_contaminated(spark, sf_dir):
    r = G.validate(FX.f2_current(spark, sf_dir), FX.f2_history_contaminated(spark, sf_dir))
    return r.records.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@register("zscore_segmented", _F2_SEG[:-1] + _gate_sql("hist", seg=True)
          + "SELECT record_id, segment, value, z_score, decision, baseline_mean, baseline_std FROM rec")
def q_zscore_segmented(spark, sf_dir):
    return _rec(G.validate_segmented(FX.f2_current(spark, sf_dir), FX.f2_history_cold(spark, sf_dir)), seg=True)


@register("zscore_segmented_mad", _F2_SEG[:-1] + _gate_sql("hist", "mad", seg=True)
          + "SELECT record_id, segment, value, z_score, decision, baseline_mean, baseline_std FROM rec")
def q_zscore_segmented_mad(spark, sf_dir):
    return _rec(G.validate_segmented(FX.f2_current(spark, sf_dir), FX.f2_history_cold(spark, sf_dir),
                                     params=G.GateParams(method="mad")), seg=True)


@register("zscore_verdict_segmented", _F2_SEG[:-1] + _gate_sql("hist", seg=True) + _verdict_sql(False))
def q_zscore_verdict_segmented(spark, sf_dir):
    return _verdict(G.validate_segmented(FX.f2_current(spark, sf_dir), FX.f2_history_cold(spark, sf_dir)))


_F2_COLD = S.with_(cur=S.F2_CURRENT, hist=f"SELECT * FROM ({S.F2_HISTORY_COLD}) WHERE segment = 'signup'")


@register("zscore_insufficient", _F2_COLD[:-1] + _gate_sql("hist") + _verdict_sql(True))
def q_zscore_insufficient(spark, sf_dir):
    h = FX.f2_history_cold(spark, sf_dir).filter(F.col("segment") == "signup")
    return _verdict(G.validate(FX.f2_current(spark, sf_dir), h))


_F2_WIN = S.with_(cur=S.F2_CURRENT, hist=f"""SELECT * FROM ({S.F2_HISTORY})
                  WHERE ts >= timestamp '2024-01-25 00:00:00' - INTERVAL 10 DAY""")


@register("zscore_window_cutoff", _F2_WIN[:-1] + _gate_sql("hist") + _verdict_sql(True))
def q_zscore_window_cutoff(spark, sf_dir):
    r = G.validate(FX.f2_current(spark, sf_dir), FX.f2_history(spark, sf_dir), ts_col="ts",
                   as_of="2024-01-25 00:00:00", params=G.GateParams(window_days=10))
    return _verdict(r)


@register("zscore_deviation_pct", _F2[:-1] + _gate_sql("hist") + """
SELECT record_id, decision,
       round(CASE WHEN baseline_mean = 0 THEN CASE WHEN value <> 0 THEN 'inf'::DOUBLE ELSE 0.0 END
                  ELSE abs(value - baseline_mean) / abs(baseline_mean) * 100 END, 6) AS deviation_pct
FROM rec WHERE decision <> 'pass'""")
def q_zscore_deviation_pct(spark, sf_dir):
    r = G.validate(FX.f2_current(spark, sf_dir), FX.f2_history(spark, sf_dir))
    return r.anomalies.select("record_id", "decision", F.round("deviation_pct", 6).alias("deviation_pct"))


@register("zscore_daily_rates", _F2_SEG[:-1] + _gate_sql("hist", seg=True) + """
SELECT strftime(cur.ts, '%Y-%m-%d') AS observation_date, coalesce(rec.segment, 'GLOBAL') AS segment,
       CAST(count(*) AS BIGINT) AS total_records,
       CAST(count(*) FILTER (WHERE upper(decision) = 'PASS') AS BIGINT) AS passed,
       CAST(count(*) FILTER (WHERE upper(decision) = 'FLAG') AS BIGINT) AS flagged,
       CAST(count(*) FILTER (WHERE upper(decision) = 'BLOCK') AS BIGINT) AS blocked,
       count(*) FILTER (WHERE upper(decision) = 'FLAG') / count(*) AS flag_rate,
       count(*) FILTER (WHERE upper(decision) = 'BLOCK') / count(*) AS block_rate
FROM rec JOIN cur USING (record_id) GROUP BY 1, 2""")
def q_zscore_daily_rates(spark, sf_dir):
    cur = FX.f2_current(spark, sf_dir)
    r = G.validate_segmented(cur, FX.f2_history_cold(spark, sf_dir), keep_cols=["ts"])
    return G.daily_rates(G.anomalies_table(r.records, ts_col="ts"))


@register("zscore_baseline_segments", _F2_SEG[:-1] + _gate_sql("hist", seg=True) + """
SELECT segment, CAST(n AS BIGINT) AS n, round(c, 6) AS center, round(s, 6) AS scale, ok AS is_valid FROM bb""")
def q_zscore_baseline_segments(spark, sf_dir):
    b = G.baseline(FX.f2_history_cold(spark, sf_dir), segment_col="segment")
    return b.select("segment", "n", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"),
                    "is_valid")


# ================================================================= exceptions
from ..operators import exceptions as X  # noqa: E402

_F4 = S.with_(q=S.F4_QUEUE)
_AS_OF = FX.F4_AS_OF
_ROUTE_AS_OF = "2024-02-01 00:00:00"
_CAT_RANK = {c: i for i, c in enumerate(M.THREE_WAY_CATEGORIES)}


def _fmt_ts(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _routed_three_way(spark, sf_dir):
    issues = M.three_way_classify(_f3_stats(spark, sf_dir))
    rank = F.element_at(F.create_map(*[x for c, i in _CAT_RANK.items() for x in (F.lit(c), F.lit(i))]),
                        F.col("category"))
    issues = issues.withColumn("_rank", rank)
    return X.route(issues, source="txn_id",
                   description=F.concat(F.col("category"), F.lit(": "), F.col("evidence")),
                   severity="severity", order_by=["_rank", "txn_id"], as_of=_ROUTE_AS_OF)


_RANK_SQL = ("CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for c, i in _CAT_RANK.items()) + " END")


@register("exceptions_routed", _F3[:-1] + _F3_STATS + f"""
SELECT printf('EXC-%06d', row_number() OVER (ORDER BY {_RANK_SQL}, txn_id)) AS exception_id,
       txn_id AS source, category || ': ' || evidence AS description, severity, 'open' AS status,
       '{_ROUTE_AS_OF}' AS created_at
FROM issues""")
def q_exceptions_routed(spark, sf_dir):
    r = _routed_three_way(spark, sf_dir)
    return r.select("exception_id", "source", "description", "severity", "status", _fmt_ts("created_at"))


@register("exceptions_sla_view", _F4 + f"""
SELECT exception_id, severity, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
       CAST(date_sub('hour', created_at, coalesce(resolved_at, timestamp '{_AS_OF}')) AS BIGINT) AS age_hours,
       CASE upper(severity) WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 24 WHEN 'LOW' THEN 72
            ELSE 24 END AS sla_hours,
       date_sub('hour', created_at, coalesce(resolved_at, timestamp '{_AS_OF}')) >
       CASE upper(severity) WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 24 WHEN 'LOW' THEN 72
            ELSE 24 END AS is_sla_breached
FROM q""")
def q_exceptions_sla_view(spark, sf_dir):
    v = X.sla_view(FX.f4_queue(spark, sf_dir), as_of=_AS_OF)
    return v.select("exception_id", "severity", "status", _fmt_ts("created_at"), "age_hours",
                    "sla_hours", "is_sla_breached")


_PY_SLA = ("CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 4 WHEN 'medium' THEN 24 WHEN 'low' THEN 72 "
           "ELSE 72 END")
_PY_AGE = (f"(epoch_us(coalesce(resolved_at, timestamp '{_AS_OF}')) - epoch_us(created_at)) / 3600000000.0")


@register("exceptions_age", _F4 + f"""
SELECT exception_id, round({_PY_AGE}, 6) AS age_hours, {_PY_SLA} AS sla_hours,
       CASE WHEN status = 'resolved' THEN false ELSE {_PY_AGE} > {_PY_SLA} END AS sla_breached
FROM q""")
def q_exceptions_age(spark, sf_dir):
    q = FX.f4_queue(spark, sf_dir)
    c = [F.col(x) for x in ("status", "severity", "created_at", "resolved_at")]
    return q.select("exception_id", F.round(X.age_hours(c[2], c[3], _AS_OF), 6).alias("age_hours"),
                    X.sla_hours(F.col("severity")).alias("sla_hours"),
                    X.sla_breached(*c, _AS_OF).alias("sla_breached"))


@register("exceptions_escalated", _F4 + f"""
SELECT exception_id, severity, 'escalated' AS status FROM q
WHERE status NOT IN ('resolved', 'escalated') AND {_PY_AGE} > {_PY_SLA}""")
def q_exceptions_escalated(spark, sf_dir):
    e = X.escalate_overdue(FX.f4_queue(spark, sf_dir), as_of=_AS_OF)
    return e.escalated.select("exception_id", "severity", "status")


@register("exceptions_escalate_idempotent", _F4 + "SELECT CAST(0 AS BIGINT) AS n")
def q_exceptions_escalate_idempotent(spark, sf_dir):
    once = X.escalate_overdue(FX.f4_queue(spark, sf_dir), as_of=_AS_OF).queue
    twice = X.escalate_overdue(once, as_of=_AS_OF)
    return twice.escalated.agg(F.count(F.lit(1)).alias("n"))


def _resolutions(spark, sf_dir, queue):
    asked = queue.filter((F.col("status") == "open") & (F.col("severity") == "critical")) \
        .select("exception_id", F.lit("closed by review").alias("resolution_notes"))
    bogus = read_table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 1000 == 0).select(
        F.concat(F.lit("EXC-UNKNOWN-"), F.col("o_orderkey").cast("string")).alias("exception_id"),
        F.lit("n/a").alias("resolution_notes"))
    return asked.unionByName(bogus)


@register("exceptions_resolved", _F4 + f"""
SELECT exception_id,
       CASE WHEN status = 'open' AND severity = 'critical' THEN 'resolved' ELSE status END AS status,
       strftime(CASE WHEN status = 'open' AND severity = 'critical' THEN timestamp '{_AS_OF}' ELSE resolved_at END,
                '%Y-%m-%d %H:%M:%S') AS resolved_at,
       CASE WHEN status = 'open' AND severity = 'critical' THEN 'closed by review'
            ELSE resolution_notes END AS resolution_notes
FROM q""")
def q_exceptions_resolved(spark, sf_dir):
    q = FX.f4_queue(spark, sf_dir)
    r = X.resolve(q, _resolutions(spark, sf_dir, q), as_of=_AS_OF)
    return r.queue.select("exception_id", "status", _fmt_ts("resolved_at"), "resolution_notes")


@register("exceptions_unknown_resolutions", """
SELECT 'EXC-UNKNOWN-' || cast(o_orderkey AS VARCHAR) AS exception_id FROM orders WHERE o_orderkey % 1000 = 0""")
def q_exceptions_unknown_resolutions(spark, sf_dir):
    q = FX.f4_queue(spark, sf_dir)
    return X.resolve(q, _resolutions(spark, sf_dir, q), as_of=_AS_OF).unknown


@register("exceptions_summary", _F4 + """
SELECT 'status' AS dimension, status AS value, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY status
UNION ALL SELECT 'severity', severity, CAST(count(*) AS BIGINT) FROM q GROUP BY severity
UNION ALL SELECT 'total', 'all', CAST(count(*) AS BIGINT) FROM q
UNION ALL SELECT 'open', 'all', CAST(count(*) FILTER (WHERE status <> 'resolved') AS BIGINT) FROM q""")
def q_exceptions_summary(spark, sf_dir):
    return X.queue_summary(FX.f4_queue(spark, sf_dir))


@register("exceptions_open_count", _F4 + "SELECT CAST(count(*) FILTER (WHERE status <> 'resolved') AS BIGINT) AS open FROM q")
def q_exceptions_open_count(spark, sf_dir):
    return X.open_count(FX.f4_queue(spark, sf_dir))


@register("exceptions_mismatch_queue", _F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", True) + """
SELECT printf('EXC-%06d', row_number() OVER (ORDER BY own_txn_id)) AS exception_id, own_txn_id AS source,
       'missing in target: ' || own_txn_id AS description, 'high' AS severity, 'open' AS status
FROM res WHERE status = 'unmatched_source'""")
def q_exceptions_mismatch_queue(spark, sf_dir):
    r = _f1_match(spark, sf_dir).filter(F.col("status") == M.UNMATCHED_SOURCE) \
        .select(F.col("source_record.txn_id").alias("txn_id"))
    q = X.route(r, source="txn_id", description=F.concat(F.lit("missing in target: "), F.col("txn_id")),
                severity=F.lit("high"), order_by=["txn_id"], as_of=_ROUTE_AS_OF)
    return q.select("exception_id", "source", "description", "severity", "status")


# ====================================================================== audit
from ..operators import audit as A  # noqa: E402
from ..operators import audit_tree  # noqa: E402

_F5_ORDER = ["timestamp", "src_id"]


def _f5_log(spark, sf_dir):
    return A.audit_append(FX.f5_events(spark, sf_dir), order_by=_F5_ORDER)


def _f5_tree(log):
    return audit_tree.build(log, block_rows=A.BLOCK_ROWS)


_F5_SEQ = """
WITH ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, ts, 'data_access' AS event_type,
                   'user-' || user_id AS actor, event_type AS action, 'res-' || (event_id % 10) AS resource,
                   props AS details FROM events)
"""


_LINK = f"(CASE WHEN chain.seq % {A.BLOCK_ROWS} = 0 THEN repeat('0', 64) ELSE chain.h END)"


def _linked_sql(anchor: str) -> str:
    """Whether ``prev`` is the hash before in the block, or what a block or the log starts from."""
    b = f"(seq - 1) // {A.BLOCK_ROWS}"
    opens = f"(seq - 1) % {A.BLOCK_ROWS} = 0"
    return (f"(prev IS NOT DISTINCT FROM coalesce(lag(h) OVER (PARTITION BY {b} ORDER BY seq), "
            f"CASE WHEN seq = min(seq) OVER () AND NOT {opens} THEN {anchor} ELSE repeat('0', 64) END) "
            f"AND (NOT {opens} OR seq = min(seq) OVER () OR lag(seq) OVER (ORDER BY seq) IS NOT DISTINCT FROM seq - 1))")


# DuckDB rebuilds the chain independently: bodies as one ordered list, then a
# recursive CTE that hashes one event per step (same canonical text); the first
# event of a block links to the genesis value.
_F5_CHAIN_SQL = f"""
WITH RECURSIVE ev AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, ts, 'data_access' AS event_type,
         'user-' || user_id AS actor, event_type AS action, 'res-' || (event_id % 10) AS resource, props AS details
  FROM events),
b AS (SELECT seq, printf('AUD-%08d', seq) AS event_id, event_type, actor, action, resource,
             concat_ws('|', length(printf('AUD-%08d', seq)) || ':' || printf('AUD-%08d', seq),
                  length(event_type) || ':' || event_type,
                  length(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'),
                  length(actor) || ':' || actor, length(action) || ':' || action,
                  length(resource) || ':' || resource,
                  coalesce(length(json(details)::VARCHAR) || ':' || json(details)::VARCHAR, '~')) AS body
      FROM ev),
arr AS MATERIALIZED (SELECT list(body ORDER BY seq) AS bodies, count(*) AS n FROM b),
chain(seq, prev, h) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), repeat('0', 64)
  UNION ALL
  SELECT chain.seq + 1, {_LINK}, sha256(arr.bodies[chain.seq + 1] || '|64:' || {_LINK})
  FROM chain, arr WHERE chain.seq < arr.n)
"""


@register("audit_chain_built", _F5_CHAIN_SQL + """
SELECT b.seq, b.event_id, b.event_type, b.actor, b.action, b.resource, c.prev AS previous_hash, c.h AS event_hash
FROM b JOIN chain c ON c.seq = b.seq""")
def q_audit_chain_built(spark, sf_dir):
    return _f5_log(spark, sf_dir).select("seq", "event_id", "event_type", "actor", "action", "resource",
                                         "previous_hash", "event_hash")


@register("audit_events_numbered", _F5_SEQ + """
SELECT seq, printf('AUD-%08d', seq) AS event_id, event_type, actor, action, resource, details,
       strftime(ts, '%Y-%m-%d') AS event_date FROM ev""")
def q_audit_events_numbered(spark, sf_dir):
    return _f5_log(spark, sf_dir).select("seq", "event_id", "event_type", "actor", "action", "resource",
                                         "details", "event_date")


def _variants(spark, sf_dir):
    log = A.reliable_log(_f5_log(spark, sf_dir))
    tree = _f5_tree(log)
    p = A.purge(log, retention_days=0, as_of="2024-01-10 00:00:00", tree=tree)
    edited = F.when(F.col("seq") == 500, F.lit('{"k": -1}')).otherwise(F.col("details"))
    linked = F.when(F.col("seq") == 900, F.lit("f" * 64)).otherwise(F.col("previous_hash"))
    verdicts = {
        "a_intact": A.verify(log, tree=tree),
        "b_details_edited": A.verify(log.withColumn("details", edited), tree=tree),
        "c_deleted": A.verify(log.filter(F.col("seq") != 700), tree=tree),
        "d_link_edited": A.verify(log.withColumn("previous_hash", linked), tree=tree),
        "e_purged": A.verify(p.log, anchor_hash=p.anchor.first()[0], tree=p.tree, head=tree.head)}
    return _verdicts(verdicts)


def _verdicts(verdicts):
    out = None
    for name, v in verdicts.items():
        row = v.verdict.select(F.lit(name).alias("variant"), "valid", "event_index", "event_id", "violation")
        out = row if out is None else out.unionByName(row)
    return out


_BODY_SQL = ("concat_ws('|', length(event_id) || ':' || event_id, length(event_type) || ':' || event_type, "
             "length(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), "
             "length(actor) || ':' || actor, length(action) || ':' || action, "
             "length(resource) || ':' || resource, "
             "coalesce(length(json(details)::VARCHAR) || ':' || json(details)::VARCHAR, '~'))")


def _verify_sql(variant: str, rows: str, anchor: str) -> str:
    """Verdict row of ``verify`` for the rows of one variant, in SQL."""
    return f"""
SELECT '{variant}' AS variant, b.seq IS NULL AS valid, CAST(b.idx AS BIGINT) AS event_index, b.event_id,
       CASE WHEN b.seq IS NULL THEN NULL WHEN NOT b.linked THEN 'prev_hash_mismatch' ELSE 'hash_mismatch' END
         AS violation
FROM (SELECT 1) one LEFT JOIN (
  SELECT * FROM (
    SELECT seq, event_id, row_number() OVER (ORDER BY seq) - 1 AS idx,
           {_linked_sql(anchor)} AS linked,
           coalesce(sha256({_BODY_SQL} || '|64:' || prev) = h, false) AS hash_ok
    FROM {rows})
  WHERE NOT linked OR NOT hash_ok ORDER BY seq LIMIT 1) b ON true"""


_F5_STORED = _F5_CHAIN_SQL + """,
stored AS (SELECT b.seq, b.event_id, b.event_type, b.actor, b.action, b.resource, e.details, e.ts, c.prev, c.h
           FROM b JOIN chain c ON c.seq = b.seq JOIN ev e ON e.seq = b.seq),
v_b AS (SELECT * REPLACE (CASE WHEN seq = 500 THEN '{"k": -1}' ELSE details END AS details) FROM stored),
v_c AS (SELECT * FROM stored WHERE seq <> 700),
v_d AS (SELECT * REPLACE (CASE WHEN seq = 900 THEN repeat('f', 64) ELSE prev END AS prev) FROM stored),
first_keep AS (SELECT min(seq) AS s FROM stored WHERE ts >= timestamp '2024-01-10 00:00:00'),
v_e AS (SELECT * FROM stored WHERE seq >= (SELECT s FROM first_keep)),
anchor_e AS (SELECT h FROM stored WHERE seq = (SELECT s FROM first_keep) - 1)
"""


@register("audit_verify_variants", _F5_STORED
          + " UNION ALL ".join([_verify_sql("a_intact", "stored", "repeat('0', 64)"),
                                _verify_sql("b_details_edited", "v_b", "repeat('0', 64)"),
                                _verify_sql("c_deleted", "v_c", "repeat('0', 64)"),
                                _verify_sql("d_link_edited", "v_d", "repeat('0', 64)"),
                                _verify_sql("e_purged", "v_e", "(SELECT h FROM anchor_e)")]))
def q_audit_verify_variants(spark, sf_dir):
    return _variants(spark, sf_dir)


@register("audit_chain_view_broken", _F5_STORED + f"""
SELECT event_id, linked AS is_linked FROM (
  SELECT event_id, {_linked_sql("repeat('0', 64)")} AS linked FROM v_c) WHERE NOT linked""")
def q_audit_chain_view_broken(spark, sf_dir):
    log = A.reliable_log(_f5_log(spark, sf_dir))
    view = A.chain_view(log.filter(F.col("seq") != 700), tree=_f5_tree(log))
    return A.broken_links(view).join(view.select("event_id", "is_linked"), "event_id").select("event_id", "is_linked")


_LEAF_SQL = f"""leaf AS (
  SELECT (seq - 1) // {A.BLOCK_ROWS} AS idx, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS rows,
         arg_max(h, seq) AS block_hash FROM stored GROUP BY 1),
l0 AS (SELECT 0 AS level, idx, first_seq, last_seq, rows,
              sha256(concat_ws('|', 'leaf', idx, first_seq, last_seq, rows, block_hash)) AS node_hash FROM leaf)"""


@register("audit_block_headers", _F5_STORED + f""",
blocks AS (SELECT (seq - 1) // {A.BLOCK_ROWS} AS block, min(seq) AS first_seq, max(seq) AS last_seq,
                  count(*) AS rows, arg_max(h, seq) AS block_hash FROM stored GROUP BY 1),
heads(block, header_hash) AS (
  SELECT CAST(-1 AS BIGINT), repeat('0', 64)
  UNION ALL
  SELECT b.block, sha256(concat_ws('|', b.block, b.first_seq, b.last_seq, b.rows, b.block_hash, heads.header_hash))
  FROM heads JOIN blocks b ON b.block = heads.block + 1)
SELECT b.block, b.first_seq, b.last_seq, b.rows, b.block_hash, heads.header_hash
FROM blocks b JOIN heads ON heads.block = b.block""")
def q_audit_block_headers(spark, sf_dir):
    return A.block_headers(_f5_log(spark, sf_dir)).drop("previous_header", "leaf_hash")


def _tree_sql(fanout: int, top: int) -> str:
    """Nodes of all levels, recomputed level by level (``top`` levels at most)."""
    each = [f"""l{n} AS (
  SELECT {n} AS level, idx // {fanout} AS idx, min(first_seq) AS first_seq, max(last_seq) AS last_seq,
         CAST(sum(rows) AS BIGINT) AS rows,
         sha256(concat_ws('|', 'node', {n}, idx // {fanout}, sum(rows), string_agg(node_hash, '|' ORDER BY idx))) AS node_hash
  FROM l{n - 1} GROUP BY idx // {fanout})""" for n in range(1, top + 1)]
    union = " UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(top + 1))
    return ", ".join([_LEAF_SQL, *each]) + f"""
SELECT CAST(level AS INTEGER) AS level, idx, first_seq, last_seq, rows, node_hash FROM ({union})
WHERE level <= greatest(1, (SELECT ceil(log2(max(idx) + 1) / log2({fanout}) - 1e-9) FROM leaf))"""


_NODES = ("level", "idx", "first_seq", "last_seq", "rows", "node_hash")


@register("audit_tree_nodes", _F5_STORED + ", " + _tree_sql(2, 10))
def q_audit_tree_nodes(spark, sf_dir):
    """The authenticated tree of the log, two nodes to a parent."""
    return audit_tree.build(_f5_log(spark, sf_dir), block_rows=A.BLOCK_ROWS, fanout=2).nodes.select(*_NODES)


@register("audit_tree_extended", _F5_STORED + ", " + _tree_sql(2, 10))
def q_audit_tree_extended(spark, sf_dir):
    """The same tree, grown by three appends (the January days up to the 4th, to the 20th, the rest)."""
    events = FX.f5_events(spark, sf_dir)
    day = F.to_date("timestamp")
    cuts = [F.lit("2024-01-04").cast("date"), F.lit("2024-01-20").cast("date")]
    parts = [events.where(day <= cuts[0]), events.where((day > cuts[0]) & (day <= cuts[1])), events.where(day > cuts[1])]
    log = tree = None
    for part in parts:
        new = A.audit_append_recorded(part, order_by=_F5_ORDER, tail=log, tree=tree, fanout=2)
        rows = A.reliable_log(new.rows)
        log, tree = rows if log is None else log.unionByName(rows), new.tree
    return tree.nodes.select(*_NODES)


def _block_verdict_sql(variant: str, rows: str) -> str:
    """Verdict on rows whose own links and hashes are sound: the first event after
    a block that does not end as recorded, or the last event."""
    ends = f"SELECT (seq - 1) // {A.BLOCK_ROWS} AS b, max(seq) AS s, arg_max(h, seq) AS h FROM {{}} GROUP BY 1"
    return f"""
SELECT '{variant}' AS variant, t.seq IS NULL AS valid, t.idx AS event_index,
       CASE WHEN t.seq IS NOT NULL THEN printf('AUD-%08d', t.seq) END AS event_id,
       CASE WHEN t.seq IS NOT NULL THEN 'block_mismatch' END AS violation
FROM (SELECT 1) one LEFT JOIN (
  SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS idx, seq = max(seq) OVER () AS last FROM {rows}
  QUALIFY (seq - 1) // {A.BLOCK_ROWS} - 1 IN (SELECT b FROM bad_{variant}) AND (seq - 1) % {A.BLOCK_ROWS} = 0
       OR last AND EXISTS (SELECT 1 FROM bad_{variant} WHERE b >= (seq - 1) // {A.BLOCK_ROWS})
  ORDER BY seq LIMIT 1) t ON true""", f"""
bad_{variant} AS (SELECT coalesce(r.b, n.b) AS b FROM ({ends.format("stored")}) r FULL JOIN ({ends.format(rows)}) n
  ON r.b = n.b WHERE r.s IS DISTINCT FROM n.s OR r.h IS DISTINCT FROM n.h)"""


_REHASHED = [("f_block_rehashed", "v_f"), ("g_end_dropped", "v_g"), ("h_intact", "stored")]
_REHASHED_SQL = [_block_verdict_sql(*x) for x in _REHASHED]


@register("audit_verify_rehashed_block", _F5_STORED + f""",
arr_f AS MATERIALIZED (SELECT list(body ORDER BY seq) AS bodies, count(*) AS n FROM (
  SELECT seq, CASE WHEN seq = 500 THEN regexp_replace(body, '[|]([0-9]+:[{{]|~)[^|]*$', '|9:{{"k":-1}}') ELSE body END AS body
  FROM b WHERE seq <= {A.BLOCK_ROWS})),
chain_f(seq, prev, h) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), repeat('0', 64)
  UNION ALL
  SELECT c.seq + 1, c.h, sha256(arr_f.bodies[c.seq + 1] || '|64:' || c.h) FROM chain_f c, arr_f WHERE c.seq < arr_f.n),
v_f AS (SELECT s.seq, coalesce(f.h, s.h) AS h FROM stored s LEFT JOIN chain_f f ON f.seq = s.seq),
v_g AS (SELECT seq, h FROM stored WHERE seq <= (SELECT max(seq) - 100 FROM stored)),
""" + ",".join(x[1] for x in _REHASHED_SQL) + " UNION ALL ".join(x[0] for x in _REHASHED_SQL))
def q_audit_verify_rehashed_block(spark, sf_dir):
    """An event of the first block edited and the block hashed anew, so that its
    own links and hashes are sound; the end of the log dropped; the intact log."""
    log = A.reliable_log(_f5_log(spark, sf_dir)).select(A.LOG_COLUMNS)
    tree = _f5_tree(log)
    forged = A.audit_append(log.select("event_type", "timestamp", "actor", "action", "resource", F.col("seq").alias("_o"),
                                       F.when(F.col("seq") == 500, F.lit('{"k":-1}')).otherwise(F.col("details"))
                                       .alias("details")), order_by=["_o"]).select(A.LOG_COLUMNS)
    first = F.col("seq") <= A.BLOCK_ROWS
    last = log.agg(F.max("seq")).first()[0]
    return _verdicts({
        "f_block_rehashed": A.verify(A.reliable_log(forged.where(first).unionByName(log.where(~first))), tree=tree),
        "g_end_dropped": A.verify(log.where(F.col("seq") <= last - 100), tree=tree),
        "h_intact": A.verify(log, tree=tree, head=tree.head)})


@register("audit_purged_tree", _F5_STORED + f""",
cut AS (SELECT min(seq) AS s, (SELECT max(seq) FROM stored) AS last FROM stored WHERE ts >= timestamp '2024-01-20 00:00:00'),
nodes AS (WITH {_tree_sql(2, 10)}),
opened AS (SELECT level, idx FROM nodes, cut WHERE last_seq >= s OR last_seq = last)
SELECT n.level, n.idx, n.first_seq, n.last_seq, n.rows, n.node_hash, NOT (n.last_seq >= s OR n.last_seq = last) AS pruned
FROM nodes n, cut WHERE n.level = (SELECT max(level) FROM nodes)
   OR EXISTS (SELECT 1 FROM opened o WHERE o.level = n.level + 1 AND o.idx = n.idx // 2)""")
def q_audit_purged_tree(spark, sf_dir):
    """What a purge leaves of the tree: the old head still follows from it."""
    log = A.reliable_log(_f5_log(spark, sf_dir))
    tree = audit_tree.build(log, block_rows=A.BLOCK_ROWS, fanout=2)
    p = A.purge(log, retention_days=0, as_of="2024-01-20 00:00:00", tree=tree)
    sound = audit_tree.broken_nodes(p.tree, tree.head)
    return p.tree.nodes.select(*_NODES, "pruned").join(sound, ["level", "idx"], "left_anti")


@register("audit_verify_null_hash", _F5_STORED + """,
v_n AS (SELECT * REPLACE (CASE WHEN seq = (SELECT max(seq) FROM stored) THEN NULL ELSE h END AS h,
                          CASE WHEN seq = (SELECT max(seq) FROM stored) THEN '{"k": -1}' ELSE details END AS details)
        FROM stored)
""" + _verify_sql("last_hash_null", "v_n", "repeat('0', 64)"))
def q_audit_verify_null_hash(spark, sf_dir):
    log = A.reliable_log(_f5_log(spark, sf_dir))
    last = F.col("seq") == log.agg(F.max("seq")).first()[0]
    t = log.withColumn("event_hash", F.when(~last, F.col("event_hash"))) \
        .withColumn("details", F.when(last, F.lit('{"k": -1}')).otherwise(F.col("details")))
    return A.verify(t, tree=_f5_tree(log)).verdict.select(F.lit("last_hash_null").alias("variant"), "valid", "event_index", "event_id",
                                      "violation")


@register("audit_append_after_full_purge", _F5_STORED + """,
last AS (SELECT seq, h FROM stored ORDER BY seq DESC LIMIT 1)
SELECT printf('AUD-%08d', last.seq + s.seq) AS event_id, last.seq + s.seq AS seq, s.actor,
       CASE WHEN s.seq = 1 THEN last.h END AS first_link
FROM stored s, last""")
def q_audit_append_after_full_purge(spark, sf_dir):
    events = FX.f5_events(spark, sf_dir)
    p = A.purge(A.reliable_log(_f5_log(spark, sf_dir)), retention_days=0, as_of="2030-01-01 00:00:00")
    more = A.audit_append(events, order_by=_F5_ORDER, tail=p.log, anchor=p.anchor)
    start = p.anchor.first()["next_seq"]
    return more.select("event_id", "seq", "actor",
                       F.when(F.col("seq") == start, F.col("previous_hash")).alias("first_link"))


@register("audit_canonical_details", _F5_STORED + """
SELECT event_id, h AS event_hash FROM stored""")
def q_audit_canonical_details(spark, sf_dir):
    """Payloads written with other spacing hash alike."""
    events = FX.f5_events(spark, sf_dir).withColumn(
        "details", F.regexp_replace("details", r"([{:,])\s*", "$1   "))
    return A.audit_append(events, order_by=_F5_ORDER).select("event_id", "event_hash")


@register("audit_chain_valid", _F5_STORED + f"""
SELECT bool_and(linked) AS chain_is_valid FROM (SELECT {_linked_sql("repeat('0', 64)")} AS linked FROM stored)""")
def q_audit_chain_valid(spark, sf_dir):
    log = _f5_log(spark, sf_dir)
    return A.chain_valid(A.chain_view(log, tree=_f5_tree(log)))


@register("audit_purged", _F5_SEQ + """
SELECT printf('AUD-%08d', seq) AS event_id, seq FROM ev
WHERE seq >= (SELECT min(seq) FROM ev WHERE ts >= timestamp '2024-01-10 00:00:00')""")
def q_audit_purged(spark, sf_dir):
    p = A.purge(_f5_log(spark, sf_dir), retention_days=0, as_of="2024-01-10 00:00:00")
    return p.log.select("event_id", "seq")


@register("audit_query", _F5_SEQ + """
SELECT printf('AUD-%08d', seq) AS event_id, actor, action FROM ev
WHERE ts >= timestamp '2024-01-05 00:00:00' AND ts <= timestamp '2024-01-06 12:00:00'
  AND actor = 'user-7' AND event_type = 'data_access'""")
def q_audit_query(spark, sf_dir):
    q = A.query(_f5_log(spark, sf_dir), event_type="data_access", start="2024-01-05 00:00:00",
                end="2024-01-06 12:00:00", actor="user-7")
    return q.select("event_id", "actor", "action")


@register("audit_export", _F5_STORED + """
SELECT to_json({'event_id': event_id, 'event_type': event_type,
                'timestamp': strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 'actor': actor, 'action': action,
                'resource': resource, 'details': json(coalesce(details, '{}')),
                'previous_hash': prev, 'event_hash': h})::VARCHAR AS json
FROM stored""")
def q_audit_export(spark, sf_dir):
    return A.export_json(_f5_log(spark, sf_dir))


@register("audit_access_log", _F5_SEQ + """
SELECT printf('AUD-%08d', seq) AS event_id, actor, action, resource FROM ev""")
def q_audit_access_log(spark, sf_dir):
    return A.access_log(_f5_log(spark, sf_dir)).select("event_id", "actor", "action", "resource")


# =================================================================== registry
from ..operators import registry as R  # noqa: E402

_F6 = S.with_(reg=S.F6_REGISTRY)
_F6_LATEST = _F6[:-1] + """,
lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS rn FROM reg)
        WHERE rn = 1)
"""
_REG_AS_OF = "2024-06-01 00:00:00"


@register("registry_latest", _F6_LATEST + "SELECT name, version, description, formula, owner, sensitivity FROM lat")
def q_registry_latest(spark, sf_dir):
    return R.latest(FX.f6_registry(spark, sf_dir)).select("name", "version", "description", "formula", "owner",
                                                          "sensitivity")


@register("registry_count", _F6 + "SELECT CAST(count(DISTINCT name) AS BIGINT) AS count FROM reg")
def q_registry_count(spark, sf_dir):
    return R.count(FX.f6_registry(spark, sf_dir))


@register("registry_search", _F6_LATEST + """
SELECT name, version FROM lat WHERE contains(lower(name), 'brand#1') OR contains(lower(description), 'brand#1')""")
def q_registry_search(spark, sf_dir):
    return R.search(FX.f6_registry(spark, sf_dir), "BRAND#1").select("name", "version")


@register("registry_search_description", _F6_LATEST + """
SELECT name, version FROM lat WHERE contains(lower(name), 'gizmo') OR contains(lower(description), 'gizmo')""")
def q_registry_search_description(spark, sf_dir):
    return R.search(FX.f6_registry(spark, sf_dir), "Gizmo").select("name", "version")


@register("registry_glossary", _F6_LATEST + """
SELECT name, description, formula, owner, sensitivity, source_system, refresh_frequency, version FROM lat""")
def q_registry_glossary(spark, sf_dir):
    return R.glossary(FX.f6_registry(spark, sf_dir))


def _reg_batch(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    fresh = p.select(F.concat(F.lit("type:"), F.col("p_type")).alias("name"),
                     F.col("p_name").alias("description"), F.lit("SUM(p_retailprice)").alias("formula"),
                     F.lit("finance").alias("owner"), F.lit("internal").alias("sensitivity"))
    again = p.filter(F.col("p_size") == 1).select(F.col("p_brand").alias("name"), F.col("p_name").alias("description"),
                                                  F.lit("x").alias("formula"), F.lit("x").alias("owner"),
                                                  F.lit("public").alias("sensitivity"))
    return fresh.unionByName(again)


@register("registry_register", _F6[:-1] + """,
batch AS (SELECT 'type:' || p_type AS name, p_name AS description FROM part
          UNION ALL SELECT p_brand, p_name FROM part WHERE p_size = 1),
per AS (SELECT name, min(description) AS description, count(*) AS n FROM batch GROUP BY name),
existing AS (SELECT DISTINCT name FROM reg)
SELECT name, description, 'registered' AS outcome, CAST(1 AS BIGINT) AS rows FROM per
WHERE name NOT IN (SELECT name FROM existing)
UNION ALL SELECT name, CAST(NULL AS VARCHAR), 'already registered', CAST(n AS BIGINT) FROM per
          WHERE name IN (SELECT name FROM existing)
UNION ALL SELECT name, CAST(NULL AS VARCHAR), 'duplicate in batch', CAST(n - 1 AS BIGINT) FROM per
          WHERE n > 1 AND name NOT IN (SELECT name FROM existing)""")
def q_registry_register(spark, sf_dir):
    out = R.register(FX.f6_registry(spark, sf_dir), _reg_batch(spark, sf_dir), as_of=_REG_AS_OF)
    return out.registry.select("name", "description", F.lit("registered").alias("outcome"),
                               F.lit(1).cast("long").alias("rows")).unionByName(
        out.rejected.select("name", F.lit(None).cast("string").alias("description"),
                            F.col("reason").alias("outcome"), F.col("rows").cast("long").alias("rows")))


@register("registry_update", _F6_LATEST + """,
patches AS (SELECT name, 'controller' AS owner,
                   CASE WHEN name = 'Brand#55' THEN 'secret' WHEN name LIKE 'Brand#1%' THEN 'restricted' END AS sensitivity
            FROM lat UNION ALL SELECT 'Brand#99', 'x', NULL)
SELECT p.name, CAST(l.version + 1 AS INTEGER) AS version, coalesce(p.owner, l.owner) AS owner,
       coalesce(lower(p.sensitivity), l.sensitivity) AS sensitivity, 'updated' AS outcome
FROM patches p JOIN lat l USING (name) WHERE p.sensitivity IS NULL OR lower(p.sensitivity) IN ('public', 'internal', 'confidential', 'restricted')
UNION ALL
SELECT p.name, NULL, NULL, NULL, CASE WHEN l.name IS NULL THEN 'metric not found' ELSE 'invalid sensitivity' END
FROM patches p LEFT JOIN lat l USING (name)
WHERE l.name IS NULL OR NOT (p.sensitivity IS NULL OR lower(p.sensitivity) IN ('public', 'internal', 'confidential', 'restricted'))""")
def q_registry_update(spark, sf_dir):
    reg = FX.f6_registry(spark, sf_dir)
    lat = R.latest(reg)
    patches = lat.select("name", F.lit("controller").alias("owner"),
                         F.when(F.col("name") == "Brand#55", "secret")
                          .when(F.col("name").startswith("Brand#1"), "restricted").alias("sensitivity"))
    patches = patches.unionByName(spark.range(1).select(F.lit("Brand#99").alias("name"), F.lit("x").alias("owner"),
                                                        F.lit(None).cast("string").alias("sensitivity")))
    out = R.update(reg, patches, as_of=_REG_AS_OF)
    ok = out.registry.select("name", "version", "owner", "sensitivity", F.lit("updated").alias("outcome"))
    bad = out.rejected.select("name", F.lit(None).cast("int").alias("version"), F.lit(None).cast("string").alias("owner"),
                              F.lit(None).cast("string").alias("sensitivity"), F.col("reason").alias("outcome"))
    return ok.unionByName(bad)


@register("registry_conformance", _F6_LATEST + """
SELECT p_brand AS metric_name, p_retailprice AS value,
       coalesce(length(owner), 0) > 0 AND coalesce(length(formula), 0) > 0 AND coalesce(len(lineage), 0) > 0
         AND p_retailprice IS NOT NULL AS is_valid,
       version AS metric_version, sensitivity, CAST(NULL AS VARCHAR) AS error
FROM part JOIN lat ON p_brand = lat.name
UNION ALL
SELECT 'unknown:' || p_type, p_retailprice, false, NULL, NULL, 'Metric ''unknown:' || p_type || ''' not found in registry'
FROM part WHERE p_size = 2""")
def q_registry_conformance(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    obs = p.select(F.col("p_brand").alias("metric_name"), F.col("p_retailprice").alias("value")).unionByName(
        p.filter(F.col("p_size") == 2).select(F.concat(F.lit("unknown:"), F.col("p_type")).alias("metric_name"),
                                              F.col("p_retailprice").alias("value")))
    c = R.conformance(obs, FX.f6_registry(spark, sf_dir))
    return c.select("metric_name", "value", "is_valid", "metric_version", "sensitivity", "error")


# ===================================================================== policy
from ..operators import policy as P  # noqa: E402


_RECON_AT = "2024-03-01 06:00:00"


def _recon_rows(spark, sf_dir):
    r = _f1_match(spark, sf_dir)
    key = F.coalesce("source_key.txn_id", "target_key.txn_id")
    num = F.regexp_extract(key, r"(\d+)$", 1)
    lvl = F.when(num != "", FX.f7_sensitivity(num.cast("long")))
    return P.recon_results(r, None, record_id=key, source_system="erp", target_system="ledger",
                           created_at=_RECON_AT, sensitivity=lvl)


_F7_SQL = _F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", True) + """,
rr AS (SELECT upper(status) AS match_status,
              CASE WHEN regexp_extract(match_key, '(\\d+)$', 1) = '' THEN NULL
                   ELSE CASE CAST(regexp_extract(match_key, '(\\d+)$', 1) AS BIGINT) % 5
                        WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' WHEN 3 THEN 'RESTRICTED'
                        END END AS sensitivity_level
       FROM res)
"""


def _policy_query(role):
    def q(spark, sf_dir):
        v = P.visible_rows(_recon_rows(spark, sf_dir), role)
        return v.groupBy("sensitivity_level", "match_status").agg(F.count(F.lit(1)).alias("n"))
    return q


_ROLE_SQL = {
    "analyst": "upper(sensitivity_level) IN ('PUBLIC', 'INTERNAL')",
    "finance_lead": "upper(sensitivity_level) IN ('PUBLIC', 'INTERNAL', 'CONFIDENTIAL')",
    "data_engineer": "upper(sensitivity_level) IN ('PUBLIC', 'INTERNAL', 'CONFIDENTIAL')",
    "auditor": "true",
    "pipeline": "true",
    "no_role": "false",
}
for _role, _pred in _ROLE_SQL.items():
    register(f"policy_visible_rows_{_role}", _F7_SQL + f"""
SELECT sensitivity_level, match_status, CAST(count(*) AS BIGINT) AS n FROM rr WHERE {_pred}
GROUP BY sensitivity_level, match_status""")(_policy_query(None if _role == "no_role" else _role))


@register("policy_dynamic", _F7_SQL + """
SELECT sensitivity_level, match_status, CAST(count(*) AS BIGINT) AS n FROM rr
WHERE upper(sensitivity_level) IN ('PUBLIC', 'INTERNAL', 'CONFIDENTIAL') GROUP BY sensitivity_level, match_status""")
def q_policy_dynamic(spark, sf_dir):
    users = spark.createDataFrame(
        [("ana@corp", "analyst", "INTERNAL"), ("fin@corp", "finance_lead", "CONFIDENTIAL"),
         ("eng@corp", "data_engineer", "CONFIDENTIAL"), ("aud@corp", "auditor", "RESTRICTED")],
        "user_email string, role string, sensitivity_clearance string")
    v = P.visible_rows_for_user(_recon_rows(spark, sf_dir), users, "fin@corp")
    return v.groupBy("sensitivity_level", "match_status").agg(F.count(F.lit(1)).alias("n"))


_RECON_COLS = ("record_id, source_system, target_system, match_status, amount_difference, gate_decision, z_score, "
               "sensitivity_level, created_at, created_date").split(", ")
_RECON_SQL = f"""
       'erp' AS source_system, 'ledger' AS target_system, upper(status) AS match_status,
       CAST(s1.amount - t1.amount AS DOUBLE) AS amount_difference,
       CASE WHEN regexp_extract(match_key, '(\\d+)$', 1) <> '' THEN
            CASE CAST(regexp_extract(match_key, '(\\d+)$', 1) AS BIGINT) % 5
            WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' WHEN 3 THEN 'RESTRICTED' END
       END AS sensitivity_level,
       '{_RECON_AT}' AS created_at, '{_RECON_AT[:10]}' AS created_date"""


def _recon_cols(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).select(*_RECON_COLS)


@register("recon_results_sink", _F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", True) + f"""
SELECT match_key AS record_id, {_RECON_SQL}, CAST(NULL AS VARCHAR) AS gate_decision, CAST(NULL AS DOUBLE) AS z_score
FROM res""")
def q_recon_results_sink(spark, sf_dir):
    return _recon_cols(_recon_rows(spark, sf_dir))


@register("zscore_trailing_daily", """
WITH d AS (SELECT DISTINCT event_type AS segment, CAST(ts AS DATE) AS day FROM events),
j AS (SELECT d.segment, d.day, e.value FROM d LEFT JOIN events e
        ON e.event_type = d.segment AND CAST(e.ts AS DATE) >= d.day - INTERVAL 7 DAY AND CAST(e.ts AS DATE) < d.day)
SELECT segment, strftime(day, '%Y-%m-%d') AS day, CAST(count(value) AS BIGINT) AS n,
       round(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total,
       round(stddev_samp(value), 4) AS std, count(value) >= 30 AS is_valid
FROM j GROUP BY segment, day""")
def q_zscore_trailing_daily(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    b = G.trailing_daily_baseline(e, ts_col="ts", segment_col="event_type", window_days=7, money_scale=2)
    return b.select(F.col("event_type").alias("segment"), F.date_format("day", "yyyy-MM-dd").alias("day"),
                    # mean x n back to cents: exact and free of rounding ties across engines
                    F.col("n").cast("bigint").alias("n"), F.round(F.col("mean") * F.col("n"), 2).alias("total"),
                    F.round("std", 4).alias("std"), "is_valid")


@register("zscore_default_record_ids", _F2[:-1] + """,
cur2 AS (SELECT 'record-' || CAST(row_number() OVER (ORDER BY ts, record_id) - 1 AS VARCHAR) AS rid, * FROM cur)
SELECT rid AS record_id, value FROM cur2""")
def q_zscore_default_record_ids(spark, sf_dir):
    c = FX.f2_current(spark, sf_dir).withColumn("_eid", F.col("record_id"))
    r = G.validate(c.drop("record_id"), FX.f2_history(spark, sf_dir), record_id_col=None, order_by=["ts", "_eid"])
    return r.records.select("record_id", "value")


# ====================================================================== flows
from . import flows as FL  # noqa: E402

_FLOW_AS_OF = "2024-02-01 00:00:00"


def _orders_history(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("value"))


def _sub(sql: str) -> str:
    return f"({sql})"


_FLOW_GATE = S.with_(cur=f"SELECT txn_id AS record_id, amount AS value FROM ({S.F1_SOURCE})",
                     hist="SELECT o_totalprice AS value FROM orders")[:-1] + _gate_sql("hist")

_FLOW_TWO = f"""
SELECT m.match_rate, m.is_fully_reconciled, c.overall_status, g.gate_decision, g.blocked,
       CAST(2 AS BIGINT) AS audit_events, true AS chain_valid
FROM {_sub(_F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", True) + '''
SELECT round(CASE WHEN count(*) FILTER (WHERE origin IN ('source', 'pair')) > 0
             THEN count(*) FILTER (WHERE status IN ('matched', 'conflict'))
                  / count(*) FILTER (WHERE origin IN ('source', 'pair')) ELSE 0.0 END, 9) AS match_rate,
       count(*) FILTER (WHERE status = 'matched') = count(*) AS is_fully_reconciled FROM res''')} m,
     {_sub(_F1_TOTALS + '''SELECT CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END
                             AS overall_status FROM checks''')} c,
     {_sub(_FLOW_GATE + _verdict_sql(True))} g"""


@register("flow_two_source_summary", _FLOW_TWO)
def q_flow_two_source_summary(spark, sf_dir):
    out = FL.two_source(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir), _orders_history(spark, sf_dir),
                        key="txn_id", amount="amount", as_of=_FLOW_AS_OF)
    return out["summary"].select(F.round("match_rate", 9).alias("match_rate"), "is_fully_reconciled",
                                 "overall_status", "gate_decision", "blocked", "audit_events", "chain_valid")


@register("flow_mismatch_summary", _F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", True) + """
SELECT CAST(count(*) AS BIGINT) AS open, CAST(count(*) + 1 AS BIGINT) AS audit_events, true AS chain_valid
FROM res WHERE status = 'unmatched_source'""")
def q_flow_mismatch_summary(spark, sf_dir):
    out = FL.mismatch_to_queue(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir), key="txn_id",
                               value_fields=["amount"], as_of=_FLOW_AS_OF)
    return out["summary"]


_FLOW_GATE_GL = S.with_(cur=f"SELECT txn_id AS record_id, amount AS value FROM ({S.F3_GL})",
                        hist="SELECT o_totalprice AS value FROM orders")[:-1] + _gate_sql("hist", block=5.0)

_FLOW_THREE = f"""
SELECT i.exceptions, i.high, i.medium, i.low, g.gate_decision, g.passed, g.flagged, g.blocked,
       CAST(i.exceptions + 4 AS BIGINT) AS audit_events, true AS chain_valid
FROM {_sub(_F3[:-1] + _F3_STATS + '''
SELECT CAST(count(*) AS BIGINT) AS exceptions, CAST(count(*) FILTER (WHERE severity = 'high') AS BIGINT) AS high,
       CAST(count(*) FILTER (WHERE severity = 'medium') AS BIGINT) AS medium,
       CAST(count(*) FILTER (WHERE severity = 'low') AS BIGINT) AS low FROM issues''')} i,
     {_sub(_FLOW_GATE_GL + _verdict_sql(True))} g"""


@register("flow_three_way_summary", _FLOW_THREE)
def q_flow_three_way_summary(spark, sf_dir):
    gl, proc, wh = FX.f3_sources(spark, sf_dir)
    out = FL.three_way(gl, proc, wh, _orders_history(spark, sf_dir), as_of=_FLOW_AS_OF)
    return out["summary"]


@register("flow_three_way_audit_actions", _F3[:-1] + _F3_STATS + """
SELECT action, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'pair_GL_PROC' AS action UNION ALL SELECT 'pair_GL_WH' UNION ALL SELECT 'pair_PROC_WH'
  UNION ALL SELECT 'three_way_exception' FROM issues) GROUP BY action""")
def q_flow_three_way_audit_actions(spark, sf_dir):
    gl, proc, wh = FX.f3_sources(spark, sf_dir)
    log = FL.three_way(gl, proc, wh, _orders_history(spark, sf_dir), as_of=_FLOW_AS_OF)["audit_log"]
    return log.filter(F.col("event_type") != "gate_decision").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# ============================================================ more operators
@register("match_duplicate_keys", _F1[:-1] + """
SELECT k AS txn_id, CAST(ns AS BIGINT) AS n_source, CAST(nt AS BIGINT) AS n_target
FROM (SELECT lower(trim(txn_id)) AS k, count(*) FILTER (WHERE s) AS ns, count(*) FILTER (WHERE NOT s) AS nt
      FROM (SELECT txn_id, true AS s FROM f1_source UNION ALL SELECT txn_id, false FROM f1_target) GROUP BY 1)
WHERE ns > 1 OR nt > 1""")
def q_match_duplicate_keys(spark, sf_dir):
    k = M.key_side_counts(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir), ["txn_id"])
    return k.filter("is_duplicate").select("txn_id", "n_source", "n_target")


@register("check_audit_record", _F1_TOTALS + """
SELECT to_json({'overall_status': CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END,
                'check_count': count(*),
                'checks': list({'name': check_name, 'status': status, 'message': message} ORDER BY check_order)})
       ::VARCHAR AS details
FROM checks""")
def q_check_audit_record(spark, sf_dir):
    return C.audit_record_json(_f1_checks(spark, sf_dir))


@register("audit_event_count", "SELECT CAST(count(*) AS BIGINT) AS event_count FROM events")
def q_audit_event_count(spark, sf_dir):
    return _f5_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("event_count"))


@register("audit_gate_decisions", f"""
SELECT printf('AUD-%08d', i.exceptions + 4) AS event_id, 'zscore_gl_amounts' AS gate_name,
       g.gate_decision AS decision, g.blocked
FROM {_sub(_F3[:-1] + _F3_STATS + "SELECT CAST(count(*) AS BIGINT) AS exceptions FROM issues")} i,
     {_sub(_FLOW_GATE_GL + _verdict_sql(True))} g""")
def q_audit_gate_decisions(spark, sf_dir):
    gl, proc, wh = FX.f3_sources(spark, sf_dir)
    log = FL.three_way(gl, proc, wh, _orders_history(spark, sf_dir), as_of=_FLOW_AS_OF)["audit_log"]
    g = log.filter(F.col("event_type") == "gate_decision")
    return g.select("event_id", F.col("resource").alias("gate_name"),
                    F.regexp_replace("action", "^gate_", "").alias("decision"),
                    F.get_json_object("details", "$.blocked").cast("bigint").alias("blocked"))


@register("audit_verify_tampered_rows", _F5_CHAIN_SQL + """,
stored AS (SELECT b.seq, b.event_id, b.event_type, b.actor, b.action, b.resource, c.prev, c.h,
                  CASE WHEN b.seq = 500 THEN '{"k": -1}' ELSE e.details END AS details, e.ts
           FROM b JOIN chain c ON c.seq = b.seq JOIN ev e ON e.seq = b.seq),
checked AS (
  SELECT seq, event_id,
         """ + _linked_sql("repeat('0', 64)") + """ AS is_linked,
         sha256(""" + _BODY_SQL + """ || '|64:' || prev) = h AS hash_ok
  FROM stored)
SELECT seq, event_id, is_linked, hash_ok FROM checked WHERE NOT is_linked OR NOT hash_ok""")
def q_audit_verify_tampered_rows(spark, sf_dir):
    log = A.reliable_log(_f5_log(spark, sf_dir))
    t = log.withColumn("details", F.when(F.col("seq") == 500, F.lit('{"k": -1}')).otherwise(F.col("details")))
    rows = A.verify(t, tree=_f5_tree(log)).rows
    return rows.filter(~F.col("is_linked") | ~F.col("hash_ok")).select("seq", "event_id", "is_linked", "hash_ok")


@register("audit_gate_decisions_table", f"""
SELECT 'zscore_gl_amounts' AS gate_name, g.gate_decision AS decision, g.total_records AS record_count,
       g.flagged + g.blocked AS anomaly_count, g.batch_anomaly_rate AS anomaly_rate, g.baseline_mean, g.baseline_std
FROM {_sub(_FLOW_GATE_GL + _verdict_sql(True))} g""")
def q_audit_gate_decisions_table(spark, sf_dir):
    gl, proc, wh = FX.f3_sources(spark, sf_dir)
    log = FL.three_way(gl, proc, wh, _orders_history(spark, sf_dir), as_of=_FLOW_AS_OF)["audit_log"]
    t = A.gate_decisions_table(log)
    return t.select("gate_name", "decision", "record_count", "anomaly_count", "anomaly_rate",
                    F.round("baseline_mean", 6).alias("baseline_mean"), F.round("baseline_std", 6).alias("baseline_std"))


@register("registry_get", _F6_LATEST + "SELECT name, version, owner, sensitivity FROM lat WHERE name = 'Brand#13'")
def q_registry_get(spark, sf_dir):
    return R.get(FX.f6_registry(spark, sf_dir), "Brand#13").select("name", "version", "owner", "sensitivity")


@register("check_missing_keys_sample", S.with_(f1_source=S.F1_SOURCE, f1_target=S.F1_TARGET) + """,
m AS (SELECT txn_id FROM (SELECT DISTINCT txn_id FROM f1_source) s
      WHERE NOT EXISTS (SELECT 1 FROM f1_target t WHERE t.txn_id IS NOT DISTINCT FROM s.txn_id))
SELECT CAST((SELECT count(*) FROM m) AS BIGINT) AS missing_count,
       (SELECT list(txn_id ORDER BY txn_id) FROM (SELECT txn_id FROM m ORDER BY txn_id NULLS FIRST LIMIT 20)) AS sample""")
def q_check_missing_keys_sample(spark, sf_dir):
    return C.missing_keys_sample(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir), ["txn_id"], n=20)


@register("recon_results_with_gate", _F1[:-1] + "," + _match_sql_core("f1_source", "f1_target", True)[:-1] + """,
cur AS (SELECT match_key AS record_id, own_amount AS value FROM res),
hist AS (SELECT o_totalprice AS value FROM orders)""" + _gate_sql("hist") + f""",
worst AS (SELECT record_id, arg_max({{'d': decision, 'z': z_score}},
                 {{'r': CASE decision WHEN 'block' THEN 2 WHEN 'flag' THEN 1 ELSE 0 END, 'z': z_score}}) AS w
          FROM rec GROUP BY record_id)
SELECT match_key AS record_id, {_RECON_SQL}, upper(w.d) AS gate_decision, w.z AS z_score
FROM res LEFT JOIN worst ON worst.record_id IS NOT DISTINCT FROM res.match_key""")
def q_recon_results_with_gate(spark, sf_dir):
    """Every row has a decision: that of its record id's most severe gated amount."""
    r = _f1_match(spark, sf_dir)
    key = F.coalesce("source_key.txn_id", "target_key.txn_id")
    own = F.when(F.col("origin") == "target", F.col("target_record.amount")).otherwise(F.col("source_record.amount"))
    gate = G.validate(r.select(key.alias("record_id"), own.alias("value")), _orders_history(spark, sf_dir)).records
    num = F.regexp_extract(key, r"(\d+)$", 1)
    lvl = F.when(num != "", FX.f7_sensitivity(num.cast("long")))
    return _recon_cols(P.recon_results(r, gate, record_id=key, source_system="erp", target_system="ledger",
                                       created_at=_RECON_AT, sensitivity=lvl))


# ================================================== inputs that only edge cases have
@register("match_null_date_key", """
WITH src AS (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS d, o_totalprice AS v FROM orders
             WHERE o_orderkey % 3 <> 0),
tgt AS (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS d, o_totalprice AS v FROM orders
        WHERE o_orderkey % 3 <> 1),
k AS (SELECT d, sum(s) AS ns, sum(1 - s) AS nt FROM (SELECT d, 1 AS s FROM src UNION ALL SELECT d, 0 FROM tgt) GROUP BY d)
SELECT d IS NULL AS null_key, CASE WHEN ns > 1 OR nt > 1 THEN 'duplicate' WHEN ns = 1 AND nt = 1 THEN 'pair'
            WHEN ns = 1 THEN 'unmatched_source' ELSE 'unmatched_target' END AS status,
       CAST(sum(CASE WHEN ns > 1 OR nt > 1 THEN ns + nt ELSE 1 END) AS BIGINT) AS n
FROM k GROUP BY 1, 2""")
def q_match_null_date_key(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("d"), F.col("o_totalprice").alias("v"),
        (F.col("o_orderkey") % 3).alias("m"))
    r = M.match(o.filter("m <> 0").drop("m"), o.filter("m <> 1").drop("m"), ["d"], ["v"])
    status = F.when(F.col("status").isin("matched", "conflict"), "pair").otherwise(F.col("status"))
    key = F.coalesce("source_key.d", "target_key.d")
    return r.groupBy(key.isNull().alias("null_key"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("match_widened_key", """
SELECT k, CAST(sum(s) AS BIGINT) AS n_source, CAST(sum(1 - s) AS BIGINT) AS n_target
FROM (SELECT CAST(l_linenumber AS DOUBLE) AS k, 1 AS s FROM lineitem
      UNION ALL SELECT l_linenumber + l_quantity % 2 / 2, 0 FROM lineitem) GROUP BY k""")
def q_match_widened_key(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_linenumber").cast("int").alias("k"))
    t = li.select((F.col("l_linenumber") + F.col("l_quantity") % 2 / 2).cast("double").alias("k"))
    return M.key_side_counts(s, t, ["k"]).select(F.col("k").cast("double").alias("k"), "n_source", "n_target")


_EMPTY_HIST = S.with_(cur=S.F2_CURRENT, hist=f"SELECT * FROM ({S.F2_HISTORY}) WHERE false")


@register("zscore_mad_empty_history", _EMPTY_HIST[:-1] + """
SELECT decision, count(*) AS n, 1.0::DOUBLE AS batch_anomaly_rate, 'flag' AS gate_decision
FROM (SELECT CASE WHEN (SELECT count(*) FROM hist) >= 30 THEN 'pass' ELSE 'flag' END AS decision FROM cur)
GROUP BY decision""")
def q_zscore_mad_empty_history(spark, sf_dir):
    r = G.validate(FX.f2_current(spark, sf_dir), FX.f2_history(spark, sf_dir).filter(F.lit(False)),
                   params=G.GateParams(method="mad"))
    return r.records.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).crossJoin(  # one row each
        r.verdict.select("batch_anomaly_rate", "gate_decision"))


@register("zscore_mad_insufficient", _F2_COLD[:-1] + _gate_sql("hist", "mad") + _verdict_sql(True))
def q_zscore_mad_insufficient(spark, sf_dir):
    h = FX.f2_history_cold(spark, sf_dir).filter(F.col("segment") == "signup")
    return _verdict(G.validate(FX.f2_current(spark, sf_dir), h, params=G.GateParams(method="mad")))


_NULL_SEG = S.with_(
    cur=f"SELECT record_id, value, CASE WHEN segment = 'click' THEN '~' ELSE segment END AS segment FROM ({S.F2_CURRENT})",
    hist=f"SELECT value, CASE WHEN segment = 'click' THEN '~' ELSE segment END AS segment FROM ({S.F2_HISTORY})")


@register("zscore_mad_null_segment", _NULL_SEG[:-1] + _gate_sql("hist", "mad", seg=True) + """
SELECT record_id, nullif(segment, '~') AS segment, z_score, decision FROM rec""")
def q_zscore_mad_null_segment(spark, sf_dir):
    seg = F.when(F.col("segment") != "click", F.col("segment"))
    r = G.validate_segmented(FX.f2_current(spark, sf_dir).withColumn("segment", seg),
                             FX.f2_history(spark, sf_dir).withColumn("segment", seg),
                             params=G.GateParams(method="mad"))
    return r.records.select("record_id", "segment", "z_score", "decision")


@register("zscore_run_custom_rate", _F2[:-1] + _gate_sql("hist", sigma=0.5, block=40.0) + _verdict_sql(True, 0.9))
def q_zscore_run_custom_rate(spark, sf_dir):
    """``run`` decides by the result's own parameters."""
    params = G.GateParams(sigma_threshold=0.5, block_threshold=40.0, batch_anomaly_rate_limit=0.9)
    r = G.validate(FX.f2_current(spark, sf_dir), FX.f2_history(spark, sf_dir), params=params)
    v = G.run(r, lambda rows: rows.write.format("noop").mode("overwrite").save())
    return v.withColumn("baseline_mean", F.round("baseline_mean", 6)).withColumn("baseline_std",
                                                                                 F.round("baseline_std", 6))


@register("registry_update_twice", _F6_LATEST + """
SELECT name, CAST(version + p.n AS INTEGER) AS version, 'owner-' || p.n AS owner,
       CASE WHEN p.n < 2 THEN formula ELSE 'f2' END AS formula
FROM lat, (SELECT unnest([1, 2, 3]) AS n) p""")
def q_registry_update_twice(spark, sf_dir):
    """Three patches of every name: consecutive versions, each on top of the one before."""
    reg = FX.f6_registry(spark, sf_dir)
    step = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    patches = R.latest(reg).select("name", step.alias("step")).select(
        "name", "step", F.concat(F.lit("owner-"), F.col("step")).alias("owner"),
        F.when(F.col("step") == 2, "f2").alias("formula"))
    out = R.update(reg, patches, as_of=_REG_AS_OF, order_by=["step"])
    return out.registry.select("name", "version", "owner", "formula")


@register("audit_export_non_finite", _F5_SEQ + """
SELECT printf('AUD-%08d', seq) AS event_id,
       CASE WHEN seq % 3 = 0 THEN '{"a":["Infinity",1],"t":"NaN, NaN","z":"NaN"}' WHEN seq % 3 = 1 THEN '"no json"'
            ELSE json(details)::VARCHAR END AS details FROM ev""")
def q_audit_export_non_finite(spark, sf_dir):
    ev = FX.f5_events(spark, sf_dir)
    log = A.audit_append(ev, order_by=_F5_ORDER)
    log = log.withColumn("details", F.when(F.col("seq") % 3 == 0, '{"z": NaN, "a": [Infinity, 1], "t": "NaN, NaN"}')
                         .when(F.col("seq") % 3 == 1, "no json").otherwise(F.col("details")))
    j = A.export_json(log).select(F.parse_json("json").alias("v"))
    return j.select(F.variant_get("v", "$.event_id", "string").alias("event_id"),
                    F.to_json(F.variant_get("v", "$.details", "variant")).alias("details"))


@register("check_missing_keys_sorted", S.with_(f1_source=S.F1_SOURCE, f1_target=S.F1_TARGET) + """
SELECT txn_id, row_number() OVER (ORDER BY txn_id NULLS FIRST) - 1 AS position FROM (
  SELECT DISTINCT txn_id FROM f1_source s
  WHERE NOT EXISTS (SELECT 1 FROM f1_target t WHERE t.txn_id IS NOT DISTINCT FROM s.txn_id))""")
def q_check_missing_keys_sorted(spark, sf_dir):
    """The full sorted list, as positions (dense, distributed)."""
    from .seq import dense_sequence
    missing = C.missing_keys(FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir), ["txn_id"])
    return dense_sequence(missing, ["txn_id"], name="position", start=0)


# ================================================== sinks written and read back, orders as positions
def _round_trip(df: DataFrame, write) -> DataFrame:
    """Write to a folder of its own in the checkpoint folder and read back what is there."""
    from uuid import uuid4

    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/sink-{uuid4().hex}"
    write(df, path)
    return df.sparkSession.read.parquet(path)


def _sink(table: str):
    from ..sources.sinks import write_table
    return lambda df, path: write_table(table, df, path)


@register("sink_audit_log", _F5_STORED + """
SELECT seq, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, actor, action, resource, details,
       prev AS previous_hash, h AS event_hash, strftime(ts, '%Y-%m-%d') AS event_date, 2 AS hash_version FROM stored""")
def q_sink_audit_log(spark, sf_dir):
    back = _round_trip(_f5_log(spark, sf_dir), _sink("audit_log"))
    return back.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")) \
        .withColumn("event_date", F.col("event_date").cast("string"))


@register("sink_exceptions_queue", _F4 + """
SELECT exception_id, source, description, severity, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
       assigned_to, strftime(resolved_at, '%Y-%m-%d %H:%M:%S') AS resolved_at, resolution_notes,
       strftime(created_at, '%Y-%m-%d') AS created_date FROM q""")
def q_sink_exceptions_queue(spark, sf_dir):
    back = _round_trip(FX.f4_queue(spark, sf_dir), _sink("exceptions_queue"))
    return back.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "resolved_at")}) \
        .withColumn("created_date", F.col("created_date").cast("string"))


@register("sink_anomalies", _F2_SEG[:-1] + _gate_sql("hist", seg=True) + """
SELECT rec.record_id, rec.value, z_score, upper(decision) AS decision, baseline_mean, baseline_std, rec.segment,
       strftime(cur.ts, '%Y-%m-%d') AS observation_date
FROM rec JOIN cur USING (record_id) WHERE decision <> 'pass'""")
def q_sink_anomalies(spark, sf_dir):
    r = G.validate_segmented(FX.f2_current(spark, sf_dir), FX.f2_history_cold(spark, sf_dir), keep_cols=["ts"])
    back = _round_trip(G.anomalies_table(r.anomalies, ts_col="ts"), _sink("zscore_anomalies"))
    return back.select("record_id", "value", "z_score", "decision", "baseline_mean", "baseline_std", "segment",
                       F.col("observation_date").cast("string").alias("observation_date"))


@register("sink_registry", _F6 + """
SELECT name, version, description, formula, owner, sensitivity, source_system, refresh_frequency,
       CAST(sla_hours AS DOUBLE) AS sla_hours FROM reg""")
def q_sink_registry(spark, sf_dir):
    back = _round_trip(FX.f6_registry(spark, sf_dir), R.write_registry)
    return back.select("name", "version", "description", "formula", "owner", "sensitivity", "source_system",
                       "refresh_frequency", "sla_hours")


@register("audit_access_events", """
SELECT printf('AUD-%08d', row_number() OVER (ORDER BY ts, event_id)) AS event_id,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'user-' || user_id AS actor, 'read' AS action,
       'res-' || (event_id % 10) AS resource, CASE event_id % 10 WHEN 0 THEN 'RESTRICTED' ELSE 'INTERNAL' END
         AS sensitivity_level, '10.0.0.' || (user_id % 256) AS ip_address FROM events""")
def q_audit_access_events(spark, sf_dir):
    """``log_access`` in bulk, then the access log with its level and address columns."""
    e = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("src_id"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"),
        F.concat(F.lit("res-"), (F.col("event_id") % 10).cast("string")).alias("resource"))
    events = A.access_events(e, keep_cols=["src_id"])
    log = A.audit_append(events, order_by=["timestamp", "src_id"])
    user = F.regexp_extract("actor", "([0-9]+)$", 1).cast("long")
    t = A.access_log(log, sensitivity=F.when(F.col("resource") == "res-0", "RESTRICTED").otherwise("INTERNAL"),
                     ip=F.concat(F.lit("10.0.0."), (user % 256).cast("string")))
    return t.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).drop("event_hash")


@register("exceptions_fifo", _F4 + """
SELECT exception_id, row_number() OVER (ORDER BY created_at, CAST(regexp_extract(exception_id, '([0-9]+)$', 1) AS BIGINT))
       - 1 AS position FROM q""")
def q_exceptions_fifo(spark, sf_dir):
    """The queue's order as positions, from the distributed sort."""
    from .seq import dense_sequence
    q = FX.f4_queue(spark, sf_dir).withColumn("_n", F.regexp_extract("exception_id", "([0-9]+)$", 1).cast("long"))
    return dense_sequence(q, ["created_at", "_n"], name="position", start=0).select("exception_id", "position")


@register("exceptions_summary_maps", _F4 + """
SELECT (SELECT count(*) FROM q) AS total, (SELECT count(*) FROM q WHERE status <> 'resolved') AS open,
       (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM q GROUP BY 1))
         AS by_status,
       (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity)
        FROM (SELECT severity, count(*) AS n FROM q GROUP BY 1)) AS by_severity""")
def q_exceptions_summary_maps(spark, sf_dir):
    m = X.summary_maps(X.queue_summary(FX.f4_queue(spark, sf_dir)))

    def text(c):
        return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(
            "=", e["key"], e["value"].cast("string"))), ",")
    return m.select("total", "open", text("by_status").alias("by_status"), text("by_severity").alias("by_severity"))


@register("three_way_categories_sorted", _F3[:-1] + _F3_STATS + """
SELECT category, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY category) - 1 AS position
FROM issues GROUP BY category""")
def q_three_way_categories_sorted(spark, sf_dir):
    """Category order, as positions over the few counts."""
    from .seq import dense_sequence
    return dense_sequence(q_three_way_category_counts(spark, sf_dir), ["category"], name="position", start=0)


@register("audit_broken_links_sorted", _F5_STORED + f"""
SELECT event_id, row_number() OVER (ORDER BY seq) - 1 AS position FROM (
  SELECT seq, event_id, {_linked_sql("repeat('0', 64)")} AS linked FROM stored WHERE seq % 100 <> 50) WHERE NOT linked""")
def q_audit_broken_links_sorted(spark, sf_dir):
    from .seq import dense_sequence
    log = A.reliable_log(_f5_log(spark, sf_dir))
    view = A.chain_view(log.filter(F.col("seq") % 100 != 50), tree=_f5_tree(log))
    return dense_sequence(A.broken_links(view), ["seq"], name="position", start=0).select(
        "event_id", "position")


@register("controls_evidence_rollup", """
WITH c AS (SELECT 'CTL-' || (event_id % 10) AS control_id, ['Identify', 'Protect', 'Detect'][event_id % 3 + 1] AS function_name,
                  list(DISTINCT 'res-' || (user_id % 15)) AS evidence FROM events GROUP BY 1, 2),
e AS (SELECT control_id, function_name, unnest(evidence) AS artifact FROM c),
n AS (SELECT 'res-' || (event_id % 10) AS artifact, count(*) AS events FROM events GROUP BY 1)
SELECT control_id, function_name, count(artifact) AS artifacts, count(events) AS artifacts_with_events,
       CAST(coalesce(sum(events), 0) AS BIGINT) AS evidence_events FROM e LEFT JOIN n USING (artifact) GROUP BY 1, 2""")
def q_controls_evidence_rollup(spark, sf_dir):
    from ..operators import controls as CT
    e = read_table(spark, sf_dir, "events")
    name = F.element_at(F.array(*map(F.lit, ("Identify", "Protect", "Detect"))), (F.col("event_id") % 3 + 1).cast("int"))
    controls = e.groupBy(F.concat(F.lit("CTL-"), (F.col("event_id") % 10).cast("string")).alias("control_id"),
                         name.alias("function_name")).agg(
        F.collect_set(F.concat(F.lit("res-"), (F.col("user_id") % 15).cast("string"))).alias("evidence"))
    return CT.evidence_rollup(controls, _f5_log(spark, sf_dir))


def _controls(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    name = F.element_at(F.array(*map(F.lit, ("Identify", "Protect", "Detect"))), (F.col("event_id") % 3 + 1).cast("int"))
    return e.groupBy(F.concat(F.lit("CTL-"), (F.col("event_id") % 30).cast("string")).alias("control_id"),
                     name.alias("function_name"), F.col("event_type").alias("category")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("res-"), (F.col("user_id") % 15).cast("string")))).alias("evidence"))


_CONTROLS_SQL = """
WITH c AS (SELECT 'CTL-' || (event_id % 30) AS id, ['Identify', 'Protect', 'Detect'][event_id % 3 + 1] AS function,
                  event_type AS category, list_sort(list(DISTINCT 'res-' || (user_id % 15))) AS evidence
           FROM events GROUP BY 1, 2, 3)
"""


@register("controls_lookup", _CONTROLS_SQL + """
SELECT id, function, category, 'mapped' AS evidence_status, array_to_string(evidence, ', ') AS evidence
FROM c WHERE id = 'CTL-7'""")
def q_controls_lookup(spark, sf_dir):
    from ..operators import controls as CT
    return CT.control_rows(CT.get_control(_controls(spark, sf_dir), "CTL-7"))


@register("controls_summary", _CONTROLS_SQL + """
SELECT 'NIST CSF 2.0' AS framework, count(*) AS total_controls_mapped,
       array_to_string(list_sort(list(DISTINCT function)), ',') AS functions_covered, 100.0::DOUBLE AS mapping_coverage_pct,
       'engineering_control_mapping_not_certification' AS assessment_scope,
       array_to_string(list_sort(list(id || '|' || function || '|' || category || '|mapped')), ';') AS controls FROM c""")
def q_controls_summary(spark, sf_dir):
    from ..operators import controls as CT
    s = CT.control_summary(_controls(spark, sf_dir))
    lines = F.transform("controls", lambda x: F.concat_ws("|", x["id"], x["function"], x["category"],
                                                          x["evidence_status"]))
    return s.withColumn("functions_covered", F.array_join("functions_covered", ",")).withColumn(
        "controls", F.array_join(F.array_sort(lines), ";"))


def _f5_indexed(spark, sf_dir):
    """The audit log as an indexed table, appended in two halves."""
    from ..operators import audit_index as AI
    from ..session import ensure_checkpoint_dir
    from uuid import uuid4
    at = AI.IndexedLog(f"{ensure_checkpoint_dir(spark)}/tieout-extents-{uuid4().hex}", extent_rows=A.BLOCK_ROWS // 16)
    log = A.reliable_log(_f5_log(spark, sf_dir))
    half = log.agg(F.max("seq")).first()[0] // 2
    AI.append(at, log.where(F.col("seq") <= half))
    AI.append(at, log.where(F.col("seq") > half))
    return AI, at


@register("audit_query_indexed", _F5_SEQ + """
SELECT printf('AUD-%08d', seq) AS event_id, actor, action FROM ev
WHERE ts >= timestamp '2024-01-05 00:00:00' AND ts <= timestamp '2024-01-06 12:00:00'
  AND actor = 'user-7' AND event_type = 'data_access'""")
def q_audit_query_indexed(spark, sf_dir):
    AI, at = _f5_indexed(spark, sf_dir)
    return AI.query(spark, at, event_type="data_access", start="2024-01-05 00:00:00", end="2024-01-06 12:00:00",
                    actor="user-7").select("event_id", "actor", "action")


@register("audit_retained_indexed", _F5_SEQ + """
SELECT printf('AUD-%08d', seq) AS event_id, seq FROM ev
WHERE seq >= (SELECT min(seq) FROM ev WHERE ts >= timestamp '2024-01-10 00:00:00')""")
def q_audit_retained_indexed(spark, sf_dir):
    AI, at = _f5_indexed(spark, sf_dir)
    return AI.retained(spark, at, retention_days=0, as_of="2024-01-10 00:00:00").select("event_id", "seq")


@register("zscore_trailing_shifted", """
WITH d AS (SELECT DISTINCT event_type AS segment, CAST(ts AS DATE) AS day FROM events),
j AS (SELECT d.segment, d.day, e.value + 1e9 AS value FROM d LEFT JOIN events e
        ON e.event_type = d.segment AND CAST(e.ts AS DATE) >= d.day - INTERVAL 7 DAY AND CAST(e.ts AS DATE) < d.day)
SELECT segment, strftime(day, '%Y-%m-%d') AS day, CAST(count(value) AS BIGINT) AS n,
       round(stddev_samp(value), 3) AS std FROM j GROUP BY segment, day""")
def q_zscore_trailing_shifted(spark, sf_dir):
    """Values far from zero: a variance from sums of squares would have no digit left."""
    e = read_table(spark, sf_dir, "events").withColumn("value", F.col("value") + F.lit(1e9))
    b = G.trailing_daily_baseline(e, ts_col="ts", segment_col="event_type", window_days=7)
    return b.select(F.col("event_type").alias("segment"), F.date_format("day", "yyyy-MM-dd").alias("day"),
                    F.col("n").cast("bigint").alias("n"), F.round("std", 3).alias("std"))


@register("zscore_state_by_day", """
WITH last AS (SELECT max(CAST(ts AS DATE)) AS day FROM events)
SELECT event_type AS segment, count(value) AS n,
       CASE WHEN count(value) >= 30 THEN round(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(value), 6)
            ELSE 0 END AS center,
       CASE WHEN count(value) >= 30 THEN round(stddev_samp(value), 6) ELSE 0 END AS scale, count(value) >= 30 AS is_valid
FROM events, last WHERE CAST(ts AS DATE) < last.day AND CAST(ts AS DATE) >= last.day - INTERVAL 10 DAY GROUP BY 1""")
def q_zscore_state_by_day(spark, sf_dir):
    """States of all days but the last two; these two come later, one of them twice."""
    from uuid import uuid4
    from ..operators import daily_state as DS
    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark)}/tieout-days-{uuid4().hex}"
    e = read_table(spark, sf_dir, "events")
    days = [r[0] for r in e.select(F.date_format("ts", "yyyy-MM-dd").alias("d")).distinct().orderBy("d").collect()]
    how = {"segment_col": "event_type", "money_scale": 2}
    DS.update_days(path, e, days[:-2], **how)
    DS.update_days(path, e.where(F.col("event_id") % 2 == 0), days[-2:-1], **how)  # a day whose late rows are missing
    DS.update_days(path, e, days[-2:], **how)
    b = DS.state_baseline(DS.read_states(spark, path), day=days[-1], segment_col="event_type", window_days=10)
    return b.select(F.col("event_type").alias("segment"), "n", F.round("center", 6).alias("center"),
                    F.round("scale", 6).alias("scale"), "is_valid")


_F1_HASH = _F1_FP[_F1_FP.index("sha256("):_F1_FP.index(" AS h FROM")]


@register("check_differences", S.with_(f1_source=S.F1_SOURCE, f1_target=S.F1_TARGET) + f"""
SELECT txn_id, h AS row_hash, CAST(sum(side) AS BIGINT) AS surplus
FROM (SELECT txn_id, {_F1_HASH} AS h, 1 AS side FROM f1_source
      UNION ALL SELECT txn_id, {_F1_HASH} AS h, -1 AS side FROM f1_target)
GROUP BY txn_id, h HAVING sum(side) <> 0""")
def q_check_differences(spark, sf_dir):
    """The rows that the two sides do not share, found through their hash trees."""
    from uuid import uuid4
    from ..operators import hash_ranges as HR
    from ..session import ensure_checkpoint_dir
    kept = []
    for df in (FX.f1_source(spark, sf_dir), FX.f1_target(spark, sf_dir)):
        at = HR.Kept(f"{ensure_checkpoint_dir(spark)}/tieout-hashes-{uuid4().hex}", ("txn_id",), buckets=256)
        HR.keep(df, at, ["txn_id", "amount", "dept"], double_format="%.6f")
        kept.append(at)
    return HR.differences(spark, *kept, key_schema="txn_id string")
