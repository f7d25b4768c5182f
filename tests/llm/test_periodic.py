"""Periodic runs against brute force."""

import hashlib
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_inputs import SF, odd_rows
from pyspark.sql import functions as F

from tieout.llm import periodic, queries
from tieout.llm.common import read


def brute_runs(w):
    """(start, length, period) of every run: all periods, all stretches."""
    ids, out = np.unique(np.array(w, dtype=object), return_inverse=True)[1] if w else np.empty(0, int), []
    for q in range(1, len(w) // 4 + 1):
        edges = np.concatenate([[-1], np.flatnonzero(ids[:-q] != ids[q:]), [len(w) - q]])
        for k in np.flatnonzero(np.diff(edges) - 1 + q >= max(6, 4 * q)):
            s, size = int(edges[k]) + 1, int(edges[k + 1] - edges[k]) - 1 + q
            if not any((ids[s:s + size - r] == ids[s + r:s + size]).all() for r in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc, text):
    w = brute.words(text)
    n = len(w)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *one, hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def rows_of(docs):
    return sorted((tuple(r) for r in periodic.longest_run(periodic.periodic_runs(docs, repeat_tails=True)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()),
        key=str)


words = st.integers(1, 12).flatmap(lambda k: st.lists(st.integers(0, k), max_size=120))


@settings(max_examples=300, deadline=None)
@given(words, st.integers(0, 100), st.integers(1, 25), st.integers(0, 100))
def test_runs_equal_brute_force(w, at, period, reps):
    w = w[:at] + [w[at + i % period] for i in range(min(reps, 100)) if at + i % period < len(w)] + w[at:]
    found = periodic.find_runs(np.array(w, np.uint64), len(w))
    assert [tuple(r) for r in found.tolist()] == brute_runs(w)


def test_sums_of_squared_differences_are_exact():
    rng = np.random.default_rng(3)
    for length in (1, 2, 4, 8, 64, 512):
        low, high = -(-2 * length // 3), -(-4 * length // 3) - 1
        top = 1 << ((29 - (length.bit_length() - 1)) // 2)
        codes = rng.integers(1, top, 6 * length + 10).astype(np.uint64)
        blocks = np.array([0, length, 2 * length])
        found = periodic.squared_differences(codes, blocks, length, low, high)
        plain = [[sum((int(codes[b + i]) - int(codes[b + d + i])) ** 2 for i in range(length))
                  for d in range(low, high + 1)] for b in blocks]
        assert found.tolist() == plain


def test_large_periods_and_constant_texts():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 7001).astype(np.uint64)
    w = np.concatenate([rng.integers(0, 1 << 40, 123).astype(np.uint64), np.tile(base, 5)[:4 * 7001 + 17],
                        rng.integers(0, 1 << 40, 55).astype(np.uint64)])
    assert periodic.find_runs(w, len(w)).tolist() == [[123, 4 * 7001 + 17, 7001]]
    assert periodic.find_runs(np.zeros(1 << 18, np.uint64), 1 << 18).tolist() == [[0, 1 << 18, 1]]


def test_query_on_odd_rows(odd):
    assert rows_of(odd) == sorted((brute_row(r[0], r[1]) for r in odd_rows()), key=str)


@pytest.mark.parametrize("table", [SF])
def test_query_on_test_data(spark, table):
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, table).collect()), key=str)
    docs = read(spark, table, "documents").select("doc_id", "text").collect()
    assert got == sorted((brute_row(d, t) for d, t in docs), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_empty_table_and_columns(none, odd):
    assert periodic.periodic_runs(none).count() == 0
    plain = periodic.periodic_runs(odd).where(F.size("starts") > 0).select("doc_id").collect()
    assert 52 in {r[0] for r in plain}
