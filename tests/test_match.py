
import pytest
from pyspark.sql import functions as F

from tieout.operators import match as M


def df(spark, rows, schema="id string, amount double"):
    return spark.createDataFrame(rows, schema)


def statuses(r):
    return sorted(x.status for x in r.collect())


def report(r):
    return M.match_report(r).first().asDict()


@pytest.mark.parametrize("strategy", ["aggregate", "window"])
def test_exact_match_and_conflict(spark, strategy):
    s = df(spark, [("A", 100.0), ("B", 200.0)])
    t = df(spark, [("A", 100.0), ("B", -200.0)])  # sign flip is a conflict
    r = M.match(s, t, ["id"], ["amount"], strategy=strategy)
    assert statuses(r) == ["conflict", "matched"]
    c = r.filter(F.col("status") == "conflict").first().conflicts
    assert [(x.field, float(x.source_value), float(x.target_value)) for x in c] == [("amount", 200.0, -200.0)]
    rep = report(r)
    assert rep["matched_count"] == 2 and rep["conflict_count"] == 1 and rep["is_fully_reconciled"] is False


def test_both_empty_is_reconciled(spark):
    r = M.match(df(spark, []), df(spark, []), ["id"], ["amount"])
    rep = report(r)
    assert rep["result_count"] == 0 and rep["is_fully_reconciled"] is True and rep["match_rate"] == 0.0


@pytest.mark.parametrize("normalize,expected", [(True, ["matched"]), (False, ["unmatched_source", "unmatched_target"])])
def test_key_normalisation(spark, normalize, expected):
    r = M.match(df(spark, [(" ABC ", 1.0)]), df(spark, [("abc", 1.0)]), ["id"], ["amount"], normalize_keys=normalize)
    assert statuses(r) == expected


def test_unicode_whitespace_is_stripped_like_python(spark):
    key = "  Abc\x1f\t"
    assert key.strip().lower() == "abc"
    r = M.match(df(spark, [(key, 1.0)]), df(spark, [("ABC", 1.0)]), ["id"], ["amount"])
    assert statuses(r) == ["matched"]


@pytest.mark.parametrize("strategy", ["aggregate", "window"])
def test_one_source_two_targets_are_duplicates(spark, strategy):
    r = M.match(df(spark, [("A", 1.0)]), df(spark, [("A", 1.0), ("A", 1.0)]), ["id"], ["amount"], strategy=strategy)
    assert statuses(r) == ["duplicate"] * 3
    assert report(r)["matched_count"] == 0


def test_two_sources_one_target(spark):
    r = M.match(df(spark, [("A", 1.0), ("A", 2.0)]), df(spark, [("A", 1.0)]), ["id"], ["amount"])
    rep = report(r)
    assert rep["matched_count"] == 0 and rep["duplicate_count"] >= 2


def test_match_rate_denominator_is_source_rows(spark):
    s = df(spark, [("1", 1.0), ("2", 2.0)])
    t = df(spark, [("1", 1.0), ("1", 1.0), ("2", 2.0)])
    rep = report(M.match(s, t, ["id"], ["amount"]))
    assert rep["source_count"] == 2 and rep["match_rate"] == 0.5


def test_duplicate_rows_carry_first_sample_of_other_side(spark):
    s = df(spark, [("A", 5.0)])
    t = df(spark, [("A", 2.0), ("A", 1.0)])
    r = M.match(s, t, ["id"], ["amount"], order_by=["amount"]).collect()
    src_row = [x for x in r if x.origin == "source"][0]
    assert src_row.target_record.amount == 1.0  # first by the explicit order
    assert all(x.source_key.id == "a" and x.target_key.id == "a" for x in r)


def test_null_keys_match_each_other_and_none_amounts(spark):
    s = df(spark, [(None, None), ("B", 1.0)])
    t = df(spark, [(None, None), ("B", None)])
    r = M.match(s, t, ["id"], ["amount"])
    assert statuses(r) == ["conflict", "matched"]  # None vs 1.0 conflicts, None == None matches


def test_nan_is_a_conflict_like_python(spark):
    nan = float("nan")
    assert nan != nan
    r = M.match(df(spark, [("A", nan)]), df(spark, [("A", nan)]), ["id"], ["amount"])
    assert statuses(r) == ["conflict"]


def test_composite_key(spark):
    schema = "dept string, id string, amount double"
    s = spark.createDataFrame([("X", "1", 1.0), ("Y", "1", 2.0)], schema)
    t = spark.createDataFrame([("x", "1", 1.0), ("Y", "2", 2.0)], schema)
    r = M.match(s, t, ["dept", "id"], ["amount"])
    assert statuses(r) == ["matched", "unmatched_source", "unmatched_target"]


def test_missing_key_field_reads_as_empty_string(spark):
    s = spark.createDataFrame([("A", 1.0)], "id string, amount double")
    t = spark.createDataFrame([("A", 1.0, "z")], "id string, amount double, dept string")
    r = M.match(s, t, ["id", "dept"], ["amount"])
    assert statuses(r) == ["unmatched_source", "unmatched_target"]


def test_validation(spark):
    with pytest.raises(ValueError):
        M.match(df(spark, []), df(spark, []), [], ["amount"])
    s = spark.createDataFrame([(1, 1.0)], "id long, amount double")
    with pytest.raises(ValueError):
        M.match(s, df(spark, []), ["id"], ["amount"])


def test_three_way_classification(spark):
    gl = df(spark, [("T1", 10.0), ("T2", 20.0), ("T3", 30.0), ("T4", 40.0), ("T5", 50.0)], "txn_id string, amount double")
    proc = df(spark, [("T2", 20.0), ("T4", 40.0), ("T5", 55.0)], "txn_id string, amount double")
    wh = df(spark, [("T3", 30.0), ("T4", 40.01), ("T5", 50.0)], "txn_id string, amount double")
    issues = M.three_way_classify(M.three_way_key_stats(gl, proc, wh)).collect()
    got = sorted((i.txn_id, i.category, i.severity) for i in issues)
    assert got == [("T1", "LEDGER_ONLY_TRUTH", "high"), ("T2", "WAREHOUSE_MISSING", "medium"),
                   ("T3", "PROCESSOR_MISSING", "high"), ("T4", "WAREHOUSE_DRIFT", "low"),
                   ("T5", "PROCESSOR_DRIFT", "high")]
    ev = [i.evidence for i in issues if i.category == "PROCESSOR_DRIFT"][0]
    assert ev == "GL=50.00 vs PROC=55.00 (Δ=+5.00)"


def test_key_side_counts(spark):
    s = df(spark, [("A", 1.0), ("A", 1.0), ("B", 1.0)])
    t = df(spark, [("b", 1.0)])
    rows = {r.id: (r.n_source, r.n_target, r.is_duplicate) for r in M.key_side_counts(s, t, ["id"]).collect()}
    assert rows == {"a": (2, 0, True), "b": (1, 1, False)}


@pytest.mark.parametrize("hot", [None, "   "])
def test_hot_key_holding_a_third_of_rows(spark, hot):
    n = 3000
    rows = [(hot if i % 3 == 0 else f"K{i}", float(i)) for i in range(n)]
    s = spark.createDataFrame(rows, "id string, amount double").repartition(7)
    t = spark.createDataFrame(rows[: n // 2], "id string, amount double").repartition(5)
    agg = M.match(s, t, ["id"], ["amount"], order_by=["amount"], strategy="aggregate")
    win = M.match(s, t, ["id"], ["amount"], order_by=["amount"], strategy="window")
    cols = ["status", "origin", "source_record", "target_record"]
    assert sorted(map(tuple, agg.select(*cols).collect())) == sorted(map(tuple, win.select(*cols).collect()))
    rep = report(agg)
    hot_rows = n // 3 + (n // 2 + 2) // 3
    assert rep["duplicate_count"] == hot_rows
    assert rep["matched_count"] == (n // 2) - (n // 2 + 2) // 3
    assert rep["source_count"] == n
    # every hot-key duplicate carries the same first sample of each side
    samples = {(r.source_record.amount if r.origin == "target" else r.target_record.amount)
               for r in agg.filter(F.col("status") == "duplicate").collect()}
    assert samples == {0.0}


def test_summary_equals_report_of_rows(spark):
    s = df(spark, [("A", 1.0), ("B", 2.0), ("B", 2.0), (None, 3.0), ("C", 4.0), ("D", 5.0)])
    t = df(spark, [("a", 1.0), ("b", 2.0), (None, 3.0), ("C", 4.5), ("E", 6.0), ("E", 6.0)])
    for a, b in ((s, t), (df(spark, []), t), (s, df(spark, []))):
        want = report(M.match(a, b, ["id"], ["amount"]))
        got = M.match_summary(a, b, ["id"], ["amount"]).first().asDict()
        assert got == want
