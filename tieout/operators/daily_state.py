"""Daily state of a history: what a trailing baseline needs, kept and merged by day.

One row per (segment, day): ``n``, ``mean`` and ``m2`` (the squared distances from
the mean), ``total`` (an exact decimal sum, when ``money_scale`` is given) and, on
request, a KLL quantile ``sketch``. States merge pairwise,

    m2 = m2_a + m2_b + (mean_b - mean_a)^2 * n_a * n_b / (n_a + n_b),

which subtracts neighbouring means only: a history whose values lie far from zero
keeps its digits, unlike a formula over sums of squares.

``update_days`` keeps the states as a table partitioned by day. It reads the rows
of the named days alone and replaces those partitions, so it can be repeated after
a failure or when late rows come in. ``state_baseline`` reads the days of one
trailing window (partition pruning) and gives what ``gate.baseline`` gives.

Plans: rows meet one partial aggregate on (segment, day), so a hot segment costs a
row per day and map task; a merge takes at most ``window_days`` states per segment.

Defined results: NULL values are left out; a NULL time is a day of its own that
no window holds; NULL segments are a segment; a day without rows keeps no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Relative rank error of the sketch is about 1.65 % at this size.
SKETCH_K = 200
_EMPTY = "named_struct('n', 0L, 'mean', 0.0D, 'm2', 0.0D)"


def day_states(history: DataFrame, *, ts_col: str = "ts", value_col: str = "value", segment_col: str | None = None,
               money_scale: int | None = None, sketch: bool = False) -> DataFrame:
    """State of every (segment, day) of ``history``."""
    v = F.col(value_col).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"),
            (F.var_pop(v) * F.count(F.lit(1))).alias("m2")]
    if money_scale is not None:
        aggs.append(F.sum(F.col(value_col).cast(f"decimal(18,{money_scale})")).alias("total"))
    if sketch:
        aggs.append(F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("sketch"))
    keys = [*([F.col(segment_col)] if segment_col else []), F.to_date(F.col(ts_col)).alias("day")]
    return history.where(v.isNotNull()).groupBy(*keys).agg(*aggs)


def _merged(states: Column) -> Column:
    """The state of an array of (n, mean, m2)."""
    def step(a, b):
        n = a["n"] + b["n"]
        apart = b["mean"] - a["mean"]
        share = b["n"].cast("double") / n
        return F.when(a["n"] == 0, b).otherwise(F.struct(
            n.alias("n"), (a["mean"] + apart * share).alias("mean"),
            (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2")))
    return F.aggregate(states, F.expr(_EMPTY), step)


def _listed() -> Column:
    return F.struct("n", "mean", "m2")


def _result(merged: DataFrame, keys: list[str], exact: bool, min_observations: int) -> DataFrame:
    """n, mean, std and is_valid from a merged state ``_s`` and, if exact, a sum ``_t``."""
    n = F.col("_s.n")
    mean = F.try_divide(F.col("_t").cast("double"), n) if exact else F.when(n > 0, F.col("_s.mean"))
    return merged.select(*keys, n.alias("n"), mean.alias("mean"),
                         F.when(n > 1, F.sqrt(F.col("_s.m2") / (n - 1))).alias("std"),
                         (n >= min_observations).alias("is_valid"))


def trailing(states: DataFrame, *, segment_col: str | None = None, window_days: int = 90,
             min_observations: int = 30) -> DataFrame:
    """Per (segment, day): n, mean, sample std and is_valid of the ``window_days`` days before it."""
    seg = [segment_col] if segment_col else []
    w = Window.partitionBy(*seg).orderBy("_dn").rangeBetween(-window_days, -1)
    exact = "total" in states.columns
    merged = states.withColumn("_dn", F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))).select(
        *seg, "day", F.when(F.col("day").isNull(), F.array().cast("array<struct<n:bigint,mean:double,m2:double>>"))
        .otherwise(F.collect_list(_listed()).over(w)).alias("_l"),
        *([F.sum("total").over(w).alias("_t")] if exact else []))
    return _result(merged.withColumn("_s", _merged(F.col("_l"))), [*seg, "day"], exact, min_observations)


# ------------------------------------------------------------------ the table
def update_days(path: str, history: DataFrame, days: list[str], *, ts_col: str = "ts", value_col: str = "value",
                segment_col: str | None = None, money_scale: int | None = None, sketch: bool = False) -> None:
    """Replace the states of ``days`` (dates as text) by those of ``history``'s rows of these days.
    A day that has no rows any more gets a row with n = 0, which ``read_states`` leaves out."""
    if not days:
        return
    ts = F.col(ts_col)
    wanted = F.lit(False)
    for first, after in _stretches(days):  # plain bounds on the time column reach the scan
        wanted = wanted | ((ts >= F.lit(first).cast("timestamp_ntz")) & (ts < F.lit(after).cast("timestamp_ntz")))
    made = day_states(history.where(wanted), ts_col=ts_col, value_col=value_col, segment_col=segment_col,
                      money_scale=money_scale, sketch=sketch)
    named = made.sparkSession.createDataFrame([(d,) for d in sorted(set(days))], "day string") \
        .select(F.col("day").cast("date").alias("day"), F.lit(0).cast("long").alias("n"))
    every = made.unionByName(named, allowMissingColumns=True)
    every.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("day").parquet(path)


def _stretches(days: list[str]) -> list[tuple[str, str]]:
    """(first day, day after the last) of each stretch of consecutive days."""
    from datetime import date, timedelta
    out: list[list[date]] = []
    for d in sorted({date.fromisoformat(d) for d in days}):
        if out and out[-1][1] == d:
            out[-1][1] = d + timedelta(days=1)
        else:
            out.append([d, d + timedelta(days=1)])
    return [(a.isoformat(), b.isoformat()) for a, b in out]


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("n > 0").withColumn("day", F.col("day").cast("date"))


def _window(states: DataFrame, day: str, window_days: int) -> DataFrame:
    end = F.lit(day).cast("date")
    return states.where((F.col("day") < end) & (F.col("day") >= F.date_sub(end, window_days)))


def state_baseline(states: DataFrame, *, day: str, segment_col: str | None = None, window_days: int = 90,
                   min_observations: int = 30) -> DataFrame:
    """(segment), n, center, scale, is_valid of the ``window_days`` days before ``day``, as ``gate.baseline``
    gives them for a z-score; invalid ones are 0, 0 and one row comes out without a segment."""
    seg = [segment_col] if segment_col else []
    exact = "total" in states.columns
    aggs = [F.collect_list(_listed()).alias("_l"), *([F.sum("total").alias("_t")] if exact else [])]
    merged = _window(states, day, window_days).groupBy(*seg).agg(*aggs).withColumn("_s", _merged(F.col("_l")))
    r = _result(merged, seg, exact, min_observations)
    return r.select(*seg, "n", F.when(F.col("is_valid"), F.col("mean")).otherwise(0.0).alias("center"),
                    F.when(F.col("is_valid"), F.coalesce("std", F.lit(float("nan")))).otherwise(0.0).alias("scale"),
                    "is_valid")


def state_quantiles(states: DataFrame, *, day: str, probabilities: list[float], segment_col: str | None = None,
                    window_days: int = 90) -> DataFrame:
    """(segment), quantiles: approximate quantiles of the trailing window, from the merged sketches."""
    seg = [segment_col] if segment_col else []
    merged = _window(states, day, window_days).where("sketch IS NOT NULL").groupBy(*seg).agg(
        F.kll_merge_agg_double("sketch").alias("_k"))
    return merged.select(*seg, F.kll_sketch_get_quantile_double(
        "_k", F.array(*[F.lit(float(p)) for p in probabilities])).alias("quantiles"))
