from pyspark.sql import functions as F

from tieout.operators import checks as C


def one(spark, col):
    return spark.range(1).select(col.alias("c")).select("c.*").first()


def test_count_check(spark):
    r = one(spark, C.count_check(F.lit(100), F.lit(99)))
    assert r.status == "FAIL" and r.message == "Count mismatch: -1 records" and r.difference == -1
    r = one(spark, C.count_check(F.lit(5), F.lit(5)))
    assert r.status == "PASS" and r.message == "Counts match: 5 records"


def test_amount_check(spark):
    r = one(spark, C.amount_check(F.lit(10000.0), F.lit(10050.0)))
    assert r.status == "PASS" and r.message == "amount balanced within 1.00% tolerance"
    r = one(spark, C.amount_check(F.lit(10000.0), F.lit(10200.0)))
    assert r.status == "FAIL" and r.message == "amount mismatch: 200.00 (2.0000% of source)"
    r = one(spark, C.amount_check(F.lit(0.0), F.lit(5.0)))
    assert r.status == "FAIL" and r.message.endswith("(inf% of source)")
    r = one(spark, C.amount_check(F.lit(1000.0), F.lit(-1234567.5)))
    assert "-1,235,567.50" in r.message


def test_run_all_and_missing_keys(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, amount double")
    t = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, amount double")
    rows = C.run_all(s, t, ["k"], "amount").orderBy("check_order").collect()
    assert [r.check_name for r in rows] == ["record_count", "amount_balance_amount", "key_completeness"]
    assert rows[2].status == "FAIL" and rows[2].message == "1 source keys missing in target"
    assert [r.k for r in C.missing_keys(s, t, ["k"]).collect()] == ["c"]
    o = C.overall_status(C.run_all(s, t, ["k"], "amount")).first()
    assert o.overall_status == "FAIL" and o.check_count == 3


def test_overall_status_empty_is_pass(spark):
    empty = spark.createDataFrame([], "check_order int, check_name string, status string, message string")
    assert C.overall_status(empty).first().overall_status == "PASS"


def test_period_variance(spark):
    s = spark.createDataFrame([("m", "p1", 1000.0), ("m", "p2", 1100.0), ("m", "p3", 1320.0)],
                              "metric string, period string, value double")
    rows = C.period_variance(s).orderBy("period").collect()
    assert [r.status for r in rows] == ["PASS", "FAIL"]
    assert rows[0].message == "m variance 10.00% within 15% threshold"
    assert rows[1].message == "m variance 20.00% exceeds 15% threshold"


def test_historical_variance_empty_history(spark):
    cur = spark.createDataFrame([("m", 5.0)], "metric string, value double")
    hist = spark.createDataFrame([], "metric string, value double")
    r = C.historical_variance(cur, hist).first()
    assert r.check_name == "historical_variance_m" and r.status == "PASS"


def test_fingerprint_is_order_insensitive_and_counts_duplicates(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("y", 2.0), ("x", 1.0)], "k string, v double")
    c = spark.createDataFrame([("y", 2.0), ("y", 2.0)], "k string, v double")
    assert C.fingerprint_check(a, b, ["k", "v"]).first().status == "PASS"
    assert C.fingerprint_check(a, c, ["k", "v"]).first().status == "FAIL"
