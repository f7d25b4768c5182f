"""Exact medians by distributed radix selection.

A double is read by digits that keep its order: first sign and binary logarithm in
steps of 1/32 (any two doubles of one such bin have their sign in common and lie
within 2.2 per cent), then 16 bits at a time of the place between the bin's least
and greatest value. Each pass counts the rows of the bin that holds the wanted
position by the next digit and goes on into one of the new bins. All steps of a
digit's formula are monotone in floating point, so a bin is a range of values:
the next pass filters by its two ends before it computes anything.

A pass is one aggregation with partial counts on the map side: a group sends at
most a bounded number of bins per task, however many rows it has and however
often a value repeats. Nothing is sorted, copied or joined on one key.

A bin whose least and greatest value agree is settled. Bins of at most ``SMALL``
rows are not split any further: their rows are listed and the wanted one is
taken. Every other bin is split, and its ends fall into different new bins, so
the passes end (after four at most: a first bin holds under 2**48 doubles). Their
number follows from the data, the result does not.

The state between passes is two rows a group (the two middle positions). Without
groups it is two rows in all and is broadcast; with groups it is stored and
joined by group, left to the optimizer since their number is open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows that may be listed in one cell.
SMALL = 65536
#: New bins of a split.
_SPLIT = 65536
_NAN = 1 << 40  # first digit of NaN: after all numbers


def first_digit(value: str) -> Column:
    """Sign and binary logarithm in steps of 1/32, as one number in the order of the doubles."""
    a = f"abs(`{value}`)"
    size = (f"CASE WHEN {a} = 0 THEN 0L WHEN {a} = CAST('Infinity' AS DOUBLE) THEN 99999L "
            f"ELSE CAST(floor(log2({a}) * 32) AS BIGINT) + 34400L END")  # the least double has -1074 * 32
    return F.expr(f"CASE WHEN isnan(`{value}`) THEN {_NAN}L WHEN `{value}` < 0 THEN -({size}) ELSE {size} END")


def _same(columns: list[str]) -> Column:
    """Group columns of the rows equal those (``_s`` in front) of the state, NULL groups included."""
    return reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_s{c}`")) for c in columns], F.lit(True))


class _Selection:
    def __init__(self, df: DataFrame, group_cols: list[str], value_col: str):
        self.groups = group_cols
        v = df.select(*[F.col(f"`{c}`") for c in group_cols], F.col(value_col).cast("double").alias("_v"))
        self.rows = v.where(F.col("_v").isNotNull())
        self.by = [F.col(f"`{c}`") for c in group_cols]

    def _keep(self, state: DataFrame) -> tuple[DataFrame, bool]:
        """The state, computed, and whether a bin is still open."""
        if self.groups:
            state = stored(state, "radix")
            return state, not state.where(self.open_()).isEmpty()
        two = state.collect()
        more = any(not r["_nan"] and r["_lo"] < r["_hi"] and r["_c"] > SMALL for r in two)
        return F.broadcast(self.rows.sparkSession.createDataFrame(two, state.schema)), more

    def _bins(self, rows: DataFrame, by: list[Column], bin_: Column) -> DataFrame:
        return rows.groupBy(*by, bin_.alias("_bin")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    def first(self) -> tuple[DataFrame, bool]:
        """State: per group and target (0, 1: the two middle positions) the bin that
        holds it, the position inside, and the bin's rows, least and greatest value."""
        bins = self._bins(self.rows, self.by, first_digit("_v"))
        w = Window.partitionBy(*(self.by or [F.lit(0)]))  # over bins, whose number per group is bounded
        bins = bins.withColumns({"_n": F.sum("_c").over(w), "_nan": F.max("_bin").over(w) == _NAN,
                                 "_cum": F.sum("_c").over(w.orderBy("_bin"))})
        both = bins.withColumn("_x", F.explode(F.array(*(
            F.struct(F.lit(t).alias("_t"), p.cast("long").alias("_rank")) for t, p in enumerate(
                (F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))))))
        both = both.select("*", "_x.*").where((F.col("_cum") - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < F.col("_cum")))
        return self._keep(both.select(
            *self.by, "_t", "_n", "_nan", (F.col("_rank") - F.col("_cum") + F.col("_c")).alias("_rank"), "_c", "_lo", "_hi"))

    def _inside(self, state: DataFrame) -> DataFrame:
        """Rows in the bins of a state, with the bin's ends ``_l``, ``_h``."""
        some = state.select(*[F.col(f"`{c}`").alias(f"_s{c}") for c in self.groups], "_t", "_rank",
                            F.col("_lo").alias("_l"), F.col("_hi").alias("_h"))
        return self.rows.join(some, _same(self.groups) & F.col("_v").between(F.col("_l"), F.col("_h")))

    def refine(self, state: DataFrame) -> tuple[DataFrame, bool]:
        """The open bins split by the next digit; the others as they were."""
        digit = F.floor((F.col("_v") - F.col("_l")) / (F.col("_h") - F.col("_l")) * _SPLIT)
        bins = self._bins(self._inside(state.where(self.open_())), [*self.by, F.col("_t"), F.col("_rank")], digit)
        w = Window.partitionBy(*self.by, "_t").orderBy("_bin")
        bins = bins.withColumn("_cum", F.sum("_c").over(w))
        hit = bins.where((F.col("_cum") - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < F.col("_cum"))).select(
            *[F.col(f"`{c}`").alias(f"_s{c}") for c in self.groups], F.col("_t").alias("_t1"),
            F.struct((F.col("_rank") - F.col("_cum") + F.col("_c")).alias("_rank"), "_c", "_lo", "_hi").alias("_new"))
        j = state.join(hit, _same(self.groups) & (F.col("_t") == F.col("_t1")), "left")
        new = [F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) for c in ("_rank", "_c", "_lo", "_hi")]
        return self._keep(j.select(*self.by, "_t", "_n", "_nan", *new))

    @staticmethod
    def open_() -> Column:
        return ~F.col("_nan") & (F.col("_lo") < F.col("_hi")) & (F.col("_c") > SMALL)

    def median(self, state: DataFrame, out: str) -> DataFrame:
        small = ~F.col("_nan") & (F.col("_lo") < F.col("_hi"))
        rows = self._inside(state.where(small))
        listed = rows.groupBy(*self.by, "_t", "_rank").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        listed = listed.select(*[F.col(f"`{c}`").alias(f"_s{c}") for c in self.groups], F.col("_t").alias("_t1"),
                               F.element_at("_all", (F.col("_rank") + 1).cast("int")).alias("_at"))
        j = state.join(listed, _same(self.groups) & (F.col("_t") == F.col("_t1")), "left").withColumn(
            "_at", F.coalesce("_at", "_lo"))
        one = F.max(F.when(F.col("_t") == 0, F.col("_at")))
        two = F.max(F.when(F.col("_t") == 1, F.col("_at")))
        return j.groupBy(*self.by).agg(
            F.when(F.max("_nan"), F.lit(float("nan"))).otherwise((one + two) / 2).alias(out), F.max("_n").alias("n"))


def exact_group_median(df: DataFrame, group_cols: list[str], value_col: str, out: str = "median") -> DataFrame:
    """Exact (interpolated) median per group, or of all rows without
    ``group_cols``. NULL values are ignored; NaN anywhere in a group gives NaN
    (numpy semantics); a NULL group is a group. Output: group columns, ``out``,
    ``n`` (a group without values has no row; no rows at all: one row with NULLs
    only without ``group_cols``)."""
    s = _Selection(df, group_cols, value_col)
    state, more = s.first()
    while more:
        state, more = s.refine(state)
    return s.median(state, out)
