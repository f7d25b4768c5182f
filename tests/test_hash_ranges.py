"""Difference location by hash trees."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tieout.operators import checks as C
from tieout.operators import hash_ranges as HR

SCHEMA = "k string, amount double, note string"


def data(n=2000):
    return [(None if i % 401 == 0 else f"k{i // 2 if i % 50 == 0 else i}", i * 0.25, None if i % 7 == 0 else f"n{i % 5}")
            for i in range(n)] + [("hot", 1.0, "same")] * 700


def kept(spark, tmp_path, name, rows, buckets=64, fanout=4):
    at = HR.Kept(str(tmp_path / name), ("k",), buckets, fanout)
    df = spark.createDataFrame(rows, SCHEMA)
    HR.keep(df, at, ["k", "amount", "note"])
    return at, df


def test_named_rows_are_the_multiset_difference(spark, tmp_path):
    rows = data()
    other = [r for i, r in enumerate(rows) if i not in (3, 700, 2100)]  # two rows and one copy of the hot one lost
    other[10] = (other[10][0], other[10][1] + 1, other[10][2])
    other += [(None, 9.0, "new"), rows[20]]
    a, da = kept(spark, tmp_path, "a", rows)
    b, db = kept(spark, tmp_path, "b", other)
    want = Counter(rows)
    want.subtract(other)
    hashes = {tuple(r)[:3]: r.h for d in (da, db) for r in d.withColumn("h", C.row_hash(d, ["k", "amount", "note"])).collect()}
    want = {(r[0], hashes[r]): n for r, n in want.items() if n}
    got = {(r.k, r.row_hash): r.surplus for r in HR.differences(spark, a, b, "k string").collect()}
    assert got == want and len(got) == 7
    top = HR.tree(spark, a).where(F.col("level") == a.levels).collect()
    fp = C.fingerprint(da, ["k", "amount", "note"]).first()
    assert [(t.n, str(t.lane1), str(t.lane2)) for t in top] == [(fp.row_count, fp.lane1_sum, fp.lane2_sum)]


def test_equal_buckets_are_not_opened(spark, tmp_path):
    rows = data()
    a, _ = kept(spark, tmp_path, "a", rows)
    b, _ = kept(spark, tmp_path, "b", [*rows[:5], ("k5", -1.0, "edited"), *rows[6:]])
    wrong = HR.differing_buckets(spark, a, b)
    assert len(wrong) == 1
    for at in (a, b):
        for folder in os.listdir(f"{at.path}/rows"):
            if folder.startswith("bucket=") and folder != f"bucket={wrong[0]}":
                for name in os.listdir(f"{at.path}/rows/{folder}"):
                    with open(f"{at.path}/rows/{folder}/{name}", "wb") as f:
                        f.write(b"no parquet")
    assert sorted((r.k, r.surplus) for r in HR.differences(spark, a, b, "k string").collect()) == [("k5", -1), ("k5", 1)]


@pytest.mark.parametrize("buckets,fanout", [(1, 4), (10, 3), (64, 4)])
def test_empty_and_equal_data(spark, tmp_path, buckets, fanout):
    rows = data(40)[:40]
    a, _ = kept(spark, tmp_path, "a", rows, buckets, fanout)
    b, _ = kept(spark, tmp_path, "b", rows[::-1], buckets, fanout)
    c, _ = kept(spark, tmp_path, "c", [], buckets, fanout)
    assert HR.differing_buckets(spark, a, b) == [] and HR.differences(spark, a, b, "k string").count() == 0
    assert sum(r.surplus for r in HR.differences(spark, a, c, "k string").collect()) == 40
    assert sum(r.surplus for r in HR.differences(spark, c, a, "k string").collect()) == -40


def test_other_trees_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        HR.differing_buckets(spark, HR.Kept("a", ("k",), 64), HR.Kept("b", ("k",), 128))
    with pytest.raises(ValueError):
        HR.differences(spark, HR.Kept("a", ("k",)), HR.Kept("b", ("j",)), "k string")
