"""Daily states and the audit log's extent index."""

import os
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tieout.operators import audit as A
from tieout.operators import audit_index as AI
from tieout.operators import daily_state as DS
from tieout.operators import gate as G

T0 = datetime(2024, 1, 1)
HISTORY = "ts timestamp_ntz, value double, segment string"


def history(n=600, shift=0.0):
    return [(T0 + timedelta(hours=i * 2 + i % 3), shift + (i * 37 % 101) / 7, ("a", "b", None)[i % 3]) for i in range(n)]


def window(rows, day, days, segment):
    lo = day - timedelta(days=days)
    return [v for t, v, s in rows if lo <= t < day and s == segment and v is not None]


@pytest.mark.parametrize("shift", [0.0, 1e9, -3e12])
def test_states_merge_without_losing_digits(spark, shift):
    rows = history(shift=shift)
    got = DS.trailing(DS.day_states(spark.createDataFrame(rows, HISTORY), segment_col="segment"),
                      segment_col="segment", window_days=9).collect()
    assert len(got) > 100
    for r in got:
        want = window(rows, datetime.combine(r.day, T0.time()), 9, r.segment)
        assert r.n == len(want)
        if len(want) > 1:
            assert r.std == pytest.approx(statistics.stdev(want), rel=2e-3 if abs(shift) > 1e10 else 1e-6)
            assert r["mean"] == pytest.approx(statistics.fmean(want), rel=1e-12)


def test_update_replaces_named_days_and_reads_them_only(spark, tmp_path):
    rows = history()
    path = str(tmp_path / "states")
    days = sorted({t.date().isoformat() for t, _, _ in rows})
    df = spark.createDataFrame(rows, HISTORY)
    DS.update_days(path, df, days[:-1], segment_col="segment", sketch=True)
    DS.update_days(path, df, days[3:5], segment_col="segment", sketch=True)  # again: nothing is counted twice
    states = DS.read_states(spark, path)
    want = {r.segment: r for r in G.baseline(df.where(F.col("ts") < days[-1]), segment_col="segment",
                                             ts_col="ts", as_of=days[-1], params=G.GateParams(window_days=12)).collect()}
    got = {r.segment: r for r in DS.state_baseline(states, day=days[-1], segment_col="segment", window_days=12).collect()}
    assert set(got) == set(want) == {"a", "b", None}
    for s, r in got.items():
        assert r.n == want[s].n and r.is_valid == want[s].is_valid
        assert r.center == pytest.approx(want[s].center) and r.scale == pytest.approx(want[s].scale)
    # a day outside the window may be unreadable: it is not opened
    for name in os.listdir(f"{path}/day={days[0]}"):
        with open(f"{path}/day={days[0]}/{name}", "wb") as f:
            f.write(b"no parquet")
    schema = states.schema
    pruned = spark.read.schema(schema).parquet(path).where("n > 0")
    assert DS.state_baseline(pruned, day=days[-1], segment_col="segment", window_days=12).count() == 3


def test_an_emptied_day_leaves_no_state(spark, tmp_path):
    path, rows = str(tmp_path / "states"), history(60)
    df = spark.createDataFrame(rows, HISTORY)
    days = sorted({t.date().isoformat() for t, _, _ in rows})
    DS.update_days(path, df, days)
    DS.update_days(path, df.where("false"), days[:1])
    left = {r.day.isoformat() for r in DS.read_states(spark, path).select("day").distinct().collect()}
    assert left == set(days[1:])
    none, = DS.state_baseline(DS.read_states(spark, path), day=days[0]).collect()
    assert (none.n, none.center, none.scale, none.is_valid) == (0, 0.0, 0.0, False)


def test_sketches_merge(spark):
    rows = history(3000)
    states = DS.day_states(spark.createDataFrame(rows, HISTORY), sketch=True)
    day = (T0 + timedelta(days=100)).date().isoformat()
    got = DS.state_quantiles(states, day=day, probabilities=[0.1, 0.5, 0.9], window_days=60).first()["quantiles"]
    values = sorted(v for t, v, _ in rows if T0 + timedelta(days=40) <= t < T0 + timedelta(days=100))
    for p, q in zip((0.1, 0.5, 0.9), got):
        low, high = (sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values))
        assert low - 0.03 <= p <= high + 0.03


# ------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    events = spark.createDataFrame(
        [("data_access" if i % 4 else "change", T0 + timedelta(minutes=i * 7 - (i % 5) * 3), None if i % 97 == 0 else
          f"user-{i // 50}" if i % 3 else f"user-{i}", "read", f"res-{i % 6}", "{}", i) for i in range(2000)],
        "event_type string, timestamp timestamp_ntz, actor string, action string, resource string, details string, n int")
    log = A.reliable_log(A.audit_append(events, order_by=["n"]))
    at = AI.IndexedLog(str(tmp_path_factory.mktemp("log")), extent_rows=100)
    AI.append(at, log.where("seq <= 1250"))  # extent 12 is filled by two appends
    AI.append(at, log.where("seq > 1250"))
    return at, log


FILTERS = [dict(actor="user-3"), dict(actor="user-700", event_type="data_access"), dict(actor="nobody"),
           dict(start="2024-01-03 00:00:00", end="2024-01-04 12:00:00"), dict(end="2024-01-02 03:00:00", actor="user-1"),
           dict(start="2030-01-01 00:00:00"), dict(event_type="change"), {}]


@pytest.mark.parametrize("filters", FILTERS, ids=str)
@pytest.mark.parametrize("listed", [AI.LISTED, 0])
def test_the_index_gives_the_same_rows(spark, indexed, filters, listed):
    at, log = indexed
    want = sorted(r.event_id for r in A.query(log, **filters).collect())
    rows = AI.query(spark, at, listed=listed, **filters)
    assert sorted(r.event_id for r in rows.collect()) == want
    assert set(rows.columns) == set(log.columns)


def test_an_actor_is_sought_in_few_extents(spark, indexed):
    at, log = indexed
    for actor in ("user-3", "user-1200", "user-39"):
        held = {(r.seq - 1) // 100 for r in log.where(F.col("actor") == actor).collect()}
        found = {r.extent for r in AI.candidate_extents(spark, at, actor=actor).collect()}
        assert held <= found and len(found) <= len(held) + 1
    assert AI.candidate_extents(spark, at, actor="nobody").count() <= 1


@pytest.mark.parametrize("as_of", ["2024-01-01 00:00:00", "2024-01-05 06:00:00", "2024-01-10 17:00:00",
                                   "2030-01-01 00:00:00"])
def test_retained_rows_are_those_of_a_purge(spark, indexed, as_of):
    at, log = indexed
    want = sorted(r.seq for r in A.purge(log, retention_days=0, as_of=as_of).log.collect())
    assert sorted(r.seq for r in AI.retained(spark, at, retention_days=0, as_of=as_of).collect()) == want


def test_other_extents_are_not_opened(spark, indexed, tmp_path):
    import shutil
    at, log = indexed
    copy = AI.IndexedLog(str(tmp_path / "copy"), extent_rows=100)
    shutil.copytree(at.path, copy.path)
    keep = {r.extent for r in AI.candidate_extents(spark, copy, actor="user-3", end="2024-01-03 00:00:00").collect()}
    broken = 0
    for folder in os.listdir(f"{copy.path}/log"):
        if folder.startswith("extent=") and int(folder[7:]) not in keep:
            for name in os.listdir(f"{copy.path}/log/{folder}"):
                with open(f"{copy.path}/log/{folder}/{name}", "wb") as f:
                    f.write(b"no parquet")
            broken += 1
    assert broken >= 15
    rows = AI.query(spark, copy, actor="user-3", end="2024-01-03 00:00:00", schema=log.schema)
    assert rows.count() == A.query(log, actor="user-3", end="2024-01-03 00:00:00").count() > 0


def test_small_extents_of_a_large_append_share_folders(spark, indexed, tmp_path, monkeypatch):
    """Folders and files stay few; an append of another size meets them in the extent that was open."""
    _, log = indexed
    monkeypatch.setattr(AI, "FOLDERS", 20)
    at = AI.IndexedLog(str(tmp_path / "log"), extent_rows=4)
    AI.append(at, log.where("seq <= 1801"))
    AI.append(at, log.where("seq > 1801"))
    folders = [f for f in os.listdir(f"{at.path}/log") if f.startswith("extent=")]
    files = [n for f in folders for n in os.listdir(f"{at.path}/log/{f}") if n.endswith(".parquet")]
    assert len(folders) <= 42 and len(files) <= 84  # 500 extents
    assert AI.ranges(spark, at).count() == 500
    for filters in FILTERS:
        for listed in (AI.LISTED, 0):
            got = sorted(r.seq for r in AI.query(spark, at, listed=listed, **filters).collect())
            assert got == sorted(r.seq for r in A.query(log, **filters).collect()), filters
    for as_of in ("2024-01-01 00:00:00", "2024-01-09 17:45:00", "2024-01-10 07:00:00", "2030-01-01 00:00:00"):
        want = sorted(r.seq for r in A.purge(log, retention_days=0, as_of=as_of).log.collect())
        assert sorted(r.seq for r in AI.retained(spark, at, retention_days=0, as_of=as_of).collect()) == want


def test_a_shared_folder_holds_the_rows_of_a_file(spark, indexed, tmp_path, monkeypatch):
    """Folders are listed one by one, so small ones cost more than they save."""
    _, log = indexed
    monkeypatch.setattr(AI, "FOLDERS", 20)
    monkeypatch.setattr(AI, "FILE_ROWS", 400)
    at = AI.IndexedLog(str(tmp_path / "log"), extent_rows=4)
    AI.append(at, log)  # 500 extents: 25 in a folder would do to have 20 folders
    folders = [f for f in os.listdir(f"{at.path}/log") if f.startswith("extent=")]
    assert sorted(int(f[7:]) for f in folders) == [0, 100, 200, 300, 400]
    for as_of in ("2024-01-01 00:00:00", "2024-01-09 17:45:00", "2030-01-01 00:00:00"):
        want = sorted(r.seq for r in A.purge(log, retention_days=0, as_of=as_of).log.collect())
        assert sorted(r.seq for r in AI.retained(spark, at, retention_days=0, as_of=as_of).collect()) == want


def test_an_appended_log_is_stored_once(spark, indexed):
    """Rows that ``audit_append`` has stored are not copied; what is derived from them is."""
    events = spark.createDataFrame([(i, "x", T0 + timedelta(hours=i), "a", "b", None, None) for i in range(30)],
                                   "n int, event_type string, timestamp timestamp_ntz, actor string, action string, "
                                   "resource string, details string")
    log = A.audit_append(events, order_by=["n"], block_rows=8)
    stored = set(log.inputFiles())
    assert stored and set(A.reliable_log(log).inputFiles()) == stored
    assert not stored & set(A.reliable_log(log.where("seq > 3")).inputFiles())
    names = set(spark.read.parquet(*stored).columns)
    assert names == {*A.LOG_COLUMNS, "n"} - {"hash_version"}  # nothing that only the fold needs


def test_an_empty_log_has_no_extents(spark, indexed, tmp_path):
    _, log = indexed
    at = AI.IndexedLog(str(tmp_path / "none"))
    AI.append(at, log.where("false"))
    assert AI.query(spark, at, actor="x", schema=log.schema).count() == 0
    assert AI.retained(spark, at, as_of="2024-01-01 00:00:00", schema=log.schema).count() == 0
