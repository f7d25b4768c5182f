"""Property tests: Spark operators against brute-force Python models of the
documented semantics, on random small inputs."""

import math
from collections import Counter, defaultdict

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tieout.operators import gate as G
from tieout.operators import match as M

KEYS = st.sampled_from(["A", "a", " A ", "B", "b\t", "C", "", None])
AMOUNTS = st.one_of(st.none(), st.sampled_from([1.0, 2.0, -2.0, float("nan")]))
ROWS = st.lists(st.tuples(KEYS, AMOUNTS), max_size=8)


def norm(k):
    return k.strip().lower() if isinstance(k, str) else k


def differs(a, b):
    if a is None and b is None:
        return False
    if a is None or b is None:
        return True
    return a != b  # NaN != NaN, as in Python


def model(src, tgt):
    """Status multiset of the documented matching semantics."""
    s_idx, t_idx = defaultdict(list), defaultdict(list)
    for k, a in src:
        s_idx[norm(k)].append(a)
    for k, a in tgt:
        t_idx[norm(k)].append(a)
    out = Counter()
    for key in set(s_idx) | set(t_idx):
        ns, nt = len(s_idx.get(key, [])), len(t_idx.get(key, []))
        if ns > 1 or nt > 1:
            out["duplicate"] += ns + nt
        elif ns == 1 and nt == 1:
            out["conflict" if differs(s_idx[key][0], t_idx[key][0]) else "matched"] += 1
        elif ns == 1:
            out["unmatched_source"] += 1
        else:
            out["unmatched_target"] += 1
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(src=ROWS, tgt=ROWS)
def test_match_statuses_equal_the_model(spark, src, tgt):
    schema = "id string, amount double"
    s, t = spark.createDataFrame(src, schema), spark.createDataFrame(tgt, schema)
    want = model(src, tgt)
    for strategy in ("aggregate", "window"):
        got = Counter({r.status: r.n for r in
                       M.match(s, t, ["id"], ["amount"], strategy=strategy).groupBy("status").count()
                       .withColumnRenamed("count", "n").collect()})
        assert got == want, strategy
    rep = M.match_summary(s, t, ["id"], ["amount"]).first()
    assert rep.source_count == len(src) and rep.duplicate_count == want["duplicate"]
    assert rep.matched_count == want["matched"] + want["conflict"]


def gate_model(values, history, sigma=2.5, block=4.0, min_obs=5):
    if len(history) < min_obs:
        return ["flag"] * len(values)
    mean, std = float(np.mean(history)), float(np.std(history, ddof=1))
    out = []
    for v in values:
        if std == 0:
            z = 0.0 if v == mean else math.inf
        else:
            z = abs(v - mean) / std
        out.append("block" if z >= block else "flag" if z >= sigma else "pass")
    return out


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=10),
       history=st.lists(st.integers(-10, 10), max_size=12))
def test_gate_decisions_equal_the_model(spark, values, history):
    cur = spark.createDataFrame([(f"r{i:02d}", float(v)) for i, v in enumerate(values)], "record_id string, value double")
    hist = spark.createDataFrame([(float(v),) for v in history], "value double")
    got = [r.decision for r in G.validate(cur, hist, params=G.GateParams(min_observations=5))
           .records.orderBy("record_id").collect()]
    assert got == gate_model([float(v) for v in values], [float(v) for v in history])
