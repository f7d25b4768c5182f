"""Edge cases of the positional primitives in their distributed forms."""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tieout.plans import radix, seq


def test_lag_over_with_more_partitions_than_rows(spark):
    df = spark.createDataFrame([(5, "e"), (1, "a"), (3, "c")], "k long, v string")
    got = {r.k: r.lag_value for r in seq.lag_over(df, "k", "v", num_partitions=8).collect()}
    assert got == {1: None, 3: "a", 5: "c"}


def test_lag_over_empty_input(spark):
    df = spark.createDataFrame([], "k long, v string")
    assert seq.lag_over(df, "k", "v", num_partitions=4).count() == 0


def test_dense_sequence_start_and_empty(spark):
    df = spark.range(0, 50).select((F.col("id") * 7 % 50).alias("k"))
    rows = seq.dense_sequence(df, ["k"], start=1000, num_partitions=6).orderBy("k").collect()
    assert [r.seq for r in rows] == list(range(1000, 1050))
    assert seq.dense_sequence(spark.createDataFrame([], "k long"), ["k"], num_partitions=3).count() == 0


def test_exact_median_distributed_matches_numpy_with_nan_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(10, 2, 101)] + [("b", float(x)) for x in rng.normal(0, 1, 64)] + \
           [("c", 1.0), ("c", float("nan")), ("c", 3.0)] + [("d", None)] + [(None, 2.0), (None, 4.0)] + \
           [("e", 7.0)] * 50 + [("e", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.m, r.n) for r in radix.exact_group_median(df, ["g"], "v", out="m").collect()}
    for g in ("a", "b"):
        vals = np.array([v for k, v in rows if k == g])
        assert got[g][1] == len(vals) and abs(got[g][0] - float(np.median(vals))) < 1e-12
    assert math.isnan(got["c"][0]) and got["c"][1] == 3
    assert got[None] == (3.0, 2) and got["e"] == (7.0, 51)
    assert "d" not in got  # NULLs are ignored; an all-NULL group has no median


def test_group_row_number_distributed_equals_window(spark):
    df = spark.range(0, 300).select((F.col("id") % 4).alias("g"), ((F.col("id") * 37) % 1009).alias("o"))
    got = {(r.g, r.o): r.rn for r in seq.group_row_number(df, ["g"], ["o"], name="rn", num_partitions=6).collect()}
    want = {(r.g, r.o): r.rn for r in
            df.select("g", "o", F.row_number().over(Window.partitionBy("g").orderBy("o")).alias("rn")).collect()}
    assert got == want


def test_first_digit_keeps_the_order_of_doubles(spark):
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * 2 + rng.integers(0, 2, 4000).astype(np.uint64)
    v = np.concatenate([bits.view(np.float64), [0.0, 1.0, 2.0, 0.5, 4.9e-324, 2.2250738585072014e-308, 1.7976931348623157e308,
                                                float("inf"), 3.0, 1 - 2 ** -53, 1 + 2 ** -52, 2 ** 0.5] * 2])
    v[-12:] *= -1
    v = v[~np.isnan(v)]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = sorted((r.v, r.d) for r in df.select("v", radix.first_digit("v").alias("d")).collect())
    assert [d for _, d in got] == sorted(d for _, d in got) and len({d for _, d in got}) > 1000


def test_median_by_radix_passes_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(radix, "SMALL", 3)  # so that bins are refined down to the last bits
    rng = np.random.default_rng(5)
    sets = {"near": 1.0 + rng.integers(0, 200, 301) * 2.0 ** -50, "wide": np.exp(rng.normal(0, 200, 400)) * rng.choice([-1, 1], 400),
            "hot": np.concatenate([np.full(500, -7.25), rng.normal(-7.25, 1e-9, 400)]), "two": np.array([-1.5, 4.0]),
            "zero": np.array([0.0, -0.0, 0.0, 1e-320]), "inf": np.array([-np.inf, np.inf, 5.0]), "int": rng.integers(-50, 50, 999) * 1.0}
    rows = [(g, float(x)) for g, vs in sets.items() for x in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: (r.m, r.n) for r in radix.exact_group_median(df, ["g"], "v", out="m").collect()}
    for g, vs in sets.items():
        assert got[g] == (float(np.median(vs)), len(vs)), g
    finite = df.where("g <> 'inf'")
    every = np.concatenate([vs for g, vs in sets.items() if g != "inf"])
    r = radix.exact_group_median(finite, [], "v").first()
    assert (r["median"], r["n"]) == (float(np.median(every)), len(every))
    r = radix.exact_group_median(finite.where("false"), [], "v").first()
    assert r["median"] is None and r["n"] is None


def test_median_neither_sorts_nor_copies_rows(spark):
    df = spark.range(20000).select((F.col("id") % 3).alias("g"), (F.col("id") * 0.37 % 1000).alias("v"))
    for groups in ([], ["g"]):
        s = radix._Selection(df, groups, "v")
        plan = s._bins(s.rows, s.by, radix.first_digit("_v"))._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Sort " not in plan and "partial_count" in plan
