"""Removal of repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from odd_inputs import SF, odd_rows

from tieout.llm import queries, suffix_dedup
from tieout.llm.common import read


def brute(rows, span=100):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - span + 1):
            s, place = b[p:p + span], (doc is None, doc or 0, p)
            if s not in first or place < first[s]:
                first[s] = place
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - span + 1):
            if first[b[p:p + span]] < (doc is None, doc or 0, p):
                gone[p] += 1
                gone[p + span] -= 1
        flags = np.cumsum(gone[:-1]) > 0 if len(b) else np.zeros(0, bool)
        runs = int((flags & ~np.concatenate([[False], flags[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~flags])
        out.append((doc, len(b), int(flags.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.selectExpr("doc_id", "n_bytes", "n_removed", "size(starts)", "kept_sha256").collect()),
                  key=str)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 5000, "stretch": 4096, "hot": 1, "chunk": 50, "look_chunk": 9},
                                     {"shard_bytes": 3000, "hot": 0, "chunk": 7}])
def test_odd_rows(odd, options):
    assert found(suffix_dedup.drop_repeated_spans(odd, **options)) == brute([(r[0], r[1]) for r in odd_rows()])


def pool_rows(seed):
    """Texts of passages cut, joined, edited and repeated at random."""
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "abcdefgh \n", "abcdefghijklmnopqrstuvwxyz é漢 "])
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 700))) for _ in range(12)]
    pool += ["x" * rng.randint(50, 400), "xy" * 120, "0123456789" * 30]
    rows = []
    for doc in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(pool)
            i = rng.randint(0, len(s) // 2)
            s = s[i:rng.randint(i, len(s))]
            if rng.random() < 0.3 and s:
                k = rng.randrange(len(s))
                s = s[:k] + rng.choice("QZ") + s[k + 1:]
            parts.append(s)
        rows.append((doc // 2 if rng.random() < 0.1 else doc, rng.choice(["", " ", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("seed,options", [(i, o) for i in range(4) for o in (
    {}, {"shard_bytes": 2000, "hot": 2, "chunk": 20, "stretch": 600, "look_chunk": 5})])
def test_spliced_passages(spark, seed, options):
    rows = pool_rows(seed)
    assert found(suffix_dedup.drop_repeated_spans(table(spark, rows), **options)) == brute(rows)


def test_query_on_test_data(spark):
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_suffix_dedup(spark, SF).collect()), key=str)
    assert got == brute(rows) and sum(r[2] for r in got) > 1000


def test_empty_table(none):
    assert suffix_dedup.drop_repeated_spans(none).count() == 0


def test_long_text_in_stretches(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    text = " ".join(rng.choice(words) for _ in range(60000))
    rows = [(1, text), (2, text[:150000] + "!" + text[150001:]), (3, text[70000:70400])]
    got = found(suffix_dedup.drop_repeated_spans(table(spark, rows), stretch=1 << 15))
    assert got == found(suffix_dedup.drop_repeated_spans(table(spark, rows))) == brute(rows)


def test_interleave_equals_a_sort_of_all_rows():
    rng = np.random.default_rng(4)
    n = 3000
    cols = [rng.integers(0, 4, n) for _ in range(5)]
    whole = rng.integers(0, 3, n)
    order, block, shared = suffix_dedup._interleave(cols[0], cols[1:], whole)
    rows = [tuple(int(c[i]) for c in (*cols, whole)) for i in order]
    assert rows == sorted(rows)
    assert [len(set(rows[:k + 1])) - 1 for k in range(0, n, 500)] == block[::500].tolist()
    classes = set(rows)
    for k in range(0, n, 37):
        most = max(next((j for j in range(5) if rows[k][j] != o[j]), 5) for o in classes if o != rows[k])
        assert shared[k] == most - 1


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(2)
    text = "".join(rng.choice("abcd ") for _ in range(3000)).encode()
    hasher = suffix_dedup.WordHasher()
    whole = suffix_dedup._anchors(suffix_dedup._Prefix(hasher, np.frombuffer(text, np.uint8)))
    for p in range(0, 2900, 50):
        alone = suffix_dedup._anchors(suffix_dedup._Prefix(hasher, np.frombuffer(text[p:p + 100], np.uint8)))
        assert alone.tolist() == [whole[p] - p] and 0 <= alone[0] <= suffix_dedup.REACH
