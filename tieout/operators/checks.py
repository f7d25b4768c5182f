"""Layer 2 deterministic checks: count, amount, key completeness, overall
status, hash integrity, dataset fingerprint and period variance.

Check results are rows with a fixed schema::

    check_order int, check_name string, status string (PASS|FAIL|WARN),
    message string, source_value double, target_value double,
    difference double, tolerance_used double

All per-side reductions happen inside Spark; nothing is collected. The
three standard checks come out of ONE shuffle: a per-key partial aggregate
over the tagged union of both sides, followed by a global aggregate of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import pct_diff, pct_text, require_columns

# fixed values: check statuses
PASS, FAIL, WARN = "PASS", "FAIL", "WARN"

CHECK_COLUMNS = ["check_order", "check_name", "status", "message", "source_value",
                 "target_value", "difference", "tolerance_used"]


def _check_row(order: int, name: Column, status: Column, message: Column, src: Column,
               tgt: Column, diff: Column, tol: Column) -> Column:
    return F.struct(F.lit(order).alias("check_order"), name.alias("check_name"),
                    status.alias("status"), message.alias("message"),
                    src.cast("double").alias("source_value"), tgt.cast("double").alias("target_value"),
                    diff.cast("double").alias("difference"), tol.cast("double").alias("tolerance_used"))


def side_totals(source: DataFrame, target: DataFrame, key_cols: list[str], amount_col: str | None,
                *, money_scale: int | None = None) -> DataFrame:
    """One row: counts, amount sums, distinct raw key counts per side and
    the number of source keys missing in target.

    Plan: tagged union -> groupBy(raw key) partial/final aggregate (a hot
    key collapses map-side) -> global aggregate of the per-key rows.
    """
    amt_type = f"DECIMAL(18, {int(money_scale)})" if money_scale is not None else "DOUBLE"
    keys = [f"`{k}`" for k in key_cols]

    def side(df: DataFrame, is_src: bool) -> DataFrame:
        amt = f"CAST(`{amount_col}` AS {amt_type})" if amount_col else f"CAST(NULL AS {amt_type})"
        return df.selectExpr(*keys, f"{str(is_src).lower()} AS _s", f"{amt} AS _a")

    u = side(source, True).unionByName(side(target, False))
    # SQL expressions: one JVM call per aggregate instead of one per function
    per_key = u.groupBy(*key_cols).agg(
        F.expr("count_if(_s) AS ns"), F.expr("count_if(NOT _s) AS nt"),
        F.expr("sum(CASE WHEN _s THEN _a END) AS sa"), F.expr("sum(CASE WHEN NOT _s THEN _a END) AS ta"))
    return per_key.agg(
        F.expr("coalesce(sum(ns), 0) AS source_count"), F.expr("coalesce(sum(nt), 0) AS target_count"),
        F.expr("coalesce(CAST(sum(sa) AS DOUBLE), 0.0D) AS source_amount"),
        F.expr("coalesce(CAST(sum(ta) AS DOUBLE), 0.0D) AS target_amount"),
        F.expr("count_if(ns > 0) AS source_keys"), F.expr("count_if(nt > 0) AS target_keys"),
        F.expr("count_if(ns > 0 AND nt = 0) AS missing_keys"))


def count_check(src: Column, tgt: Column, order: int = 1) -> Column:
    diff = tgt - src
    ok = diff == 0
    msg = F.when(ok, F.format_string("Counts match: %d records", src)) \
        .otherwise(F.format_string("Count mismatch: %+d records", diff))
    return _check_row(order, F.lit("record_count"), F.when(ok, PASS).otherwise(FAIL), msg, src, tgt,
                      diff, F.lit(None))


def amount_check(src: Column, tgt: Column, tolerance: float = 0.01, label: str = "amount",
                 order: int = 2) -> Column:
    diff = tgt - src
    pct = pct_diff(diff, src, tgt)
    ok = pct <= F.lit(tolerance)
    msg = F.when(ok, F.lit(f"{label} balanced within {tolerance * 100:.2f}% tolerance")) \
        .otherwise(F.concat(F.lit(f"{label} mismatch: "), F.format_string("%,.2f", diff),
                            F.lit(" ("), pct_text(pct, 4), F.lit(" of source)")))
    return _check_row(order, F.lit(f"amount_balance_{label}"), F.when(ok, PASS).otherwise(FAIL), msg,
                      src, tgt, diff, F.lit(tolerance))


def completeness_check(src_keys: Column, tgt_keys: Column, missing: Column, order: int = 3) -> Column:
    ok = missing == 0
    msg = F.when(ok, F.format_string("All %d source keys present in target", src_keys)) \
        .otherwise(F.format_string("%d source keys missing in target", missing))
    return _check_row(order, F.lit("key_completeness"), F.when(ok, PASS).otherwise(FAIL), msg,
                      src_keys, tgt_keys, F.when(~ok, missing), F.lit(None))


def run_all(source: DataFrame, target: DataFrame, key_cols: list[str], amount_col: str, *,
            tolerance: float = 0.01, label: str = "amount",
            money_scale: int | None = None) -> DataFrame:
    """count + amount + completeness check rows, in that order, from one
    aggregate over both inputs."""
    require_columns(source, [*key_cols, amount_col], "the source")
    require_columns(target, [*key_cols, amount_col], "the target")
    t = side_totals(source, target, key_cols, amount_col, money_scale=money_scale)
    rows = F.array(
        count_check(F.col("source_count"), F.col("target_count")),
        amount_check(F.col("source_amount"), F.col("target_amount"), tolerance, label),
        completeness_check(F.col("source_keys"), F.col("target_keys"), F.col("missing_keys")))
    return t.select(F.explode(rows).alias("c")).select("c.*")


def missing_keys(source: DataFrame, target: DataFrame, key_cols: list[str]) -> DataFrame:
    """Source keys absent from target, as a DataFrame (never a driver list).
    Raw keys, NULL-safe: one partial aggregate over the union; the caller
    sorts (``orderBy``) if it needs the reference's sorted list."""
    u = source.select(*key_cols, F.lit(True).alias("_s")) \
        .unionByName(target.select(*key_cols, F.lit(False).alias("_s")))
    return u.groupBy(*key_cols).agg(F.max(F.col("_s").cast("int")).alias("_in_s"),
                                    F.min(F.col("_s").cast("int")).alias("_only_s")) \
        .filter(F.col("_only_s") == 1).select(*key_cols)


def missing_keys_sample(source: DataFrame, target: DataFrame, key_cols: list[str], n: int = 100) -> DataFrame:
    """One row: how many source keys are missing in target and the first
    ``n`` of them in sorted order (the report row of the completeness check).
    The sample is a top-n (per-task top-n, then a merge of n rows per
    task), so no task holds more than ``n`` keys; the full list stays the
    ``missing_keys`` DataFrame."""
    missing = missing_keys(source, target, key_cols)
    k = F.struct(*key_cols) if len(key_cols) > 1 else F.col(key_cols[0])
    top = missing.orderBy(*key_cols).limit(n).agg(F.array_sort(F.collect_list(k)).alias("sample"))
    return missing.agg(F.count(F.lit(1)).alias("missing_count")).crossJoin(top)  # 1 x 1 rows


def overall_status(checks: DataFrame) -> DataFrame:
    """Worst status (FAIL > WARN > PASS; empty -> PASS), the check count and
    the ordered (name, status, message) list: the audit-record payload."""
    rank = F.when(F.col("status") == FAIL, 2).when(F.col("status") == WARN, 1).otherwise(0)
    agg = checks.agg(
        F.max(rank).alias("_r"), F.count(F.lit(1)).alias("check_count"),
        F.array_sort(F.collect_list(F.struct("check_order", F.col("check_name").alias("name"),
                                             "status", "message"))).alias("_c"))
    return agg.select(
        F.when(F.col("_r") == 2, FAIL).when(F.col("_r") == 1, WARN).otherwise(PASS).alias("overall_status"),
        "check_count",
        F.transform("_c", lambda x: F.struct(x["name"].alias("name"), x["status"].alias("status"),
                                              x["message"].alias("message"))).alias("checks"))


def audit_record_json(checks: DataFrame) -> DataFrame:
    """``to_audit_record()`` as one JSON string (feeds the audit append)."""
    return overall_status(checks).select(F.to_json(F.struct("overall_status", "check_count", "checks"))
                                         .alias("details"))


# ------------------------------------------------------------------- hashing
def canonical_text(df: DataFrame, cols: list[str], double_format: str | None = None) -> Column:
    """Order-fixed, length-prefixed text of a row's fields: ``len:value``
    per field, ``~`` for NULL of any type, joined by ``|``. Length prefixes
    stop field boundary collisions. Doubles are rendered in full (the
    shortest text that reads back as the same double), so any drift shows;
    ``double_format`` (such as ``%.6f``) rounds them for texts that another
    engine has to reproduce."""
    parts = []
    for c in cols:
        dt = df.schema[c].dataType
        v = F.col(f"`{c}`")
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            # format_string renders NULL as the text "null"; keep it NULL
            s = F.when(v.isNotNull(), F.format_string(double_format, v)) if double_format else v.cast("string")
        elif isinstance(dt, T.BooleanType):
            s = F.when(v, "true").when(~v, "false")  # NULL stays NULL
        else:
            s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("~")))
    return F.concat_ws("|", *parts)


def row_hash(df: DataFrame, cols: list[str], **kw) -> Column:
    return F.sha2(canonical_text(df, cols, **kw), 256)


def hash_integrity(data: DataFrame, expected: DataFrame, key_cols: list[str], value_cols: list[str],
                   *, expected_col: str = "expected_hash", **kw) -> DataFrame:
    """Per-row integrity check: recompute SHA-256 over ``value_cols`` and
    compare with the expected-hash table joined on the key."""
    h = data.select(*key_cols, row_hash(data, value_cols, **kw).alias("actual_hash"))
    j = h.join(expected.select(*key_cols, expected_col), on=key_cols, how="left")
    ok = F.col("actual_hash") == F.col(expected_col)
    return j.select(
        *key_cols, F.lit("hash_integrity").alias("check_name"),
        F.when(F.coalesce(ok, F.lit(False)), PASS).otherwise(FAIL).alias("status"),
        F.when(F.coalesce(ok, F.lit(False)), "Hash integrity verified")
         .otherwise("Hash mismatch — possible data tampering").alias("message"),
        F.concat(F.substring(F.col(expected_col), 1, 16), F.lit("...")).alias("source_value"),
        F.concat(F.substring("actual_hash", 1, 16), F.lit("...")).alias("target_value"))


def fingerprint(df: DataFrame, cols: list[str], **kw) -> DataFrame:
    """Order-insensitive dataset fingerprint: row count plus the sums of two
    60-bit lanes of every row's SHA-256. Sums (not XOR) so that two equal
    rows do not cancel. One partial aggregate."""
    h = df.select(row_hash(df, cols, **kw).alias("h"))
    lane = lambda a: F.conv(F.substring("h", a, 15), 16, 10).cast("decimal(20,0)")
    return h.agg(F.count(F.lit(1)).alias("row_count"),
                 F.coalesce(F.sum(lane(1)), F.lit(0)).cast("decimal(38,0)").cast("string").alias("lane1_sum"),
                 F.coalesce(F.sum(lane(16)), F.lit(0)).cast("decimal(38,0)").cast("string").alias("lane2_sum"))


def fingerprint_check(source: DataFrame, target: DataFrame, cols: list[str], **kw) -> DataFrame:
    fs = fingerprint(source, cols, **kw)
    ft = fingerprint(target, cols, **kw)
    j = fs.crossJoin(ft.select(*[F.col(c).alias("t_" + c) for c in ft.columns]))  # 1 x 1 rows
    ok = ((F.col("row_count") == F.col("t_row_count")) & (F.col("lane1_sum") == F.col("t_lane1_sum"))
          & (F.col("lane2_sum") == F.col("t_lane2_sum")))
    return j.select(F.lit("dataset_fingerprint").alias("check_name"),
                    F.when(ok, PASS).otherwise(FAIL).alias("status"),
                    F.col("row_count").alias("source_rows"), F.col("t_row_count").alias("target_rows"))


# ------------------------------------------------------------------ variance
def _variance_row(metric: Column, current: Column, prior: Column, threshold: float,
                  name_prefix: str = "period_variance_") -> Column:
    pct = pct_diff(current - prior, prior, current)
    ok = pct <= F.lit(threshold)
    thr = f"{threshold * 100:.0f}%"
    msg = F.concat(metric, F.lit(" variance "), pct_text(pct, 2),
                   F.when(ok, F.lit(f" within {thr} threshold")).otherwise(F.lit(f" exceeds {thr} threshold")))
    return F.struct(F.concat(F.lit(name_prefix), metric).alias("check_name"),
                    F.when(ok, PASS).otherwise(FAIL).alias("status"), msg.alias("message"),
                    prior.cast("double").alias("source_value"), current.cast("double").alias("target_value"),
                    (current - prior).cast("double").alias("difference"),
                    F.lit(threshold).cast("double").alias("tolerance_used"))


def period_variance(series: DataFrame, *, metric_col: str = "metric", period_col: str = "period",
                    value_col: str = "value", threshold: float = 0.15) -> DataFrame:
    """Period-over-period check for every (metric, period) that has a prior
    period: ``lag`` over each metric's ordered periods. The series is one
    row per (metric, period), i.e. already aggregated, so a metric's window
    holds its periods only."""
    w = Window.partitionBy(metric_col).orderBy(period_col)
    lagged = series.select(metric_col, period_col, F.col(value_col).alias("_cur"),
                           F.lag(value_col).over(w).alias("_prior"),
                           F.lag(period_col).over(w).alias("prior_period"))
    return lagged.filter(F.col("prior_period").isNotNull()).select(
        F.col(metric_col).alias("metric"), F.col(period_col).alias("period"), "prior_period",
        _variance_row(F.col(metric_col), F.col("_cur"), F.col("_prior"), threshold).alias("c")) \
        .select("metric", "period", "prior_period", "c.*")


def historical_variance(current: DataFrame, history: DataFrame, *, metric_col: str = "metric",
                        value_col: str = "value", threshold: float = 0.15) -> DataFrame:
    """Current value per metric against the mean of its history. A metric
    with no history PASSes as ``historical_variance_<m>``."""
    hist = history.groupBy(metric_col).agg(F.avg(value_col).alias("_avg"), F.count(value_col).alias("_n"))
    j = current.select(metric_col, F.col(value_col).alias("_cur")).join(hist, metric_col, "left")
    has = F.coalesce(F.col("_n"), F.lit(0)) > 0
    m = F.col(metric_col)
    row = F.when(has, _variance_row(m, F.col("_cur"), F.col("_avg"), threshold)).otherwise(
        F.struct(F.concat(F.lit("historical_variance_"), m).alias("check_name"), F.lit(PASS).alias("status"),
                 F.lit("No historical data for comparison").alias("message"),
                 F.lit(None).cast("double").alias("source_value"), F.lit(None).cast("double").alias("target_value"),
                 F.lit(None).cast("double").alias("difference"), F.lit(None).cast("double").alias("tolerance_used")))
    return j.select(m.alias("metric"), row.alias("c")).select("metric", "c.*")
