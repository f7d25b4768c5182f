"""Ranked lexical search against brute force."""

import collections
import math
import re

import numpy as np
import pytest
from odd_inputs import SF, odd_rows

from tieout.llm import queries, ranked_search
from tieout.llm.common import read

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    """Sorted (item_id, rank, doc_id, score)."""
    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (d, bag), size in zip(bags, sizes):
            s = 0
            for t in set(terms(text)):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    s += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * (50 + (50 * size * n) // total)))
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (*x[:2], x[2] or 0))[:top])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_on_test_data(spark):
    docs = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert found(queries.op13_ranked_search(spark, SF)) == brute(docs, items)


@pytest.mark.parametrize("top,shard_terms,block_bytes", [(50, 1 << 21, 8 << 20), (3, 200, 300)])
def test_odd_rows_items_and_small_shards(spark, odd, top, shard_terms, block_bytes):
    docs = [(r[0], r[1]) for r in odd_rows()]
    items = [(1, "one two THREE four"), (2, None), (3, ""), (3, "again and again the same"), (None, "mail é token"),
             (4, "one two THREE four"), (4, "one two THREE four"), (5, "ikea " * 40 + "licensed under public license")]
    items += [(10 + i, docs[-1 - i][1]) for i in range(4)]
    table = spark.createDataFrame([(*x, "clash", "clash") for x in items], "item_id long, text string, key string, q string")
    got = ranked_search.ranked_search(odd, table, top=top, shard_terms=shard_terms, block_bytes=block_bytes)
    assert found(got) == brute(docs, items, top)


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert ranked_search.ranked_search(none, items).count() == 0
    empty = ranked_search.ranked_search(odd, items.where("false"))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
    blank = spark.createDataFrame([(1, None), (2, " .")], "doc_id long, text string")
    assert ranked_search.ranked_search(blank, items).count() == 0


def shard_of(rng, n_docs, n_terms):
    key = np.unique(rng.integers(0, n_terms, 6 * n_docs) ** 2 // n_terms * n_docs + rng.integers(0, n_docs, 6 * n_docs))
    terms_, docs = key // n_docs, key % n_docs
    impacts = rng.integers(1, 1000, len(key)) * (1 + terms_)
    return ranked_search.Shard(n_docs, terms_, docs, impacts, n_terms), (terms_, docs, impacts)


def test_shard_search_is_exact_and_pair_bounds_skip_more():
    rng = np.random.default_rng(2)
    with_pairs = without = 0
    for _ in range(30):
        shard, (t, d, s) = shard_of(rng, 3000, 60)
        q = np.sort(rng.choice(60, 12, replace=False))
        chain = shard.chain(q)
        for a, b in zip(chain, chain[1:]):
            shard.add_pair(a, b)
            joint = max((s[(t == a) & (d == x)].sum() + s[(t == b) & (d == x)].sum() for x in
                         np.intersect1d(d[t == a], d[t == b])), default=0)
            assert shard.pairs[a, b][2] == max(joint, shard.top[a], shard.top[b])  # the bound of the pair is attained
            assert list(shard.pairs[a, b][0]) == list(np.intersect1d(d[t == a], d[t == b]))
        score = np.zeros(3000, np.int64)
        hit = np.isin(t, q)
        np.add.at(score, d[hit], s[hit])
        found_, scores, read_ = shard.search(q, 10)
        least = np.sort(score)[-10]
        assert sorted(found_) == list(np.flatnonzero(score >= max(least, 1)))
        assert (score[found_] == scores).all()
        with_pairs += read_
        assert shard.bounds(chain)[0] >= score.max()
        shard.pairs.clear()  # single maxima only
        again, _, read_ = shard.search(q, 10)
        assert sorted(again) == sorted(found_)
        without += read_
    assert with_pairs < without


def test_blocks_without_any_item(spark):
    """Items are dealt to blocks by their hash, so a block may stay empty."""
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(5)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word3 " * 40)], "item_id long, text string")
    got = ranked_search.ranked_search(docs, items, block_bytes=10)  # 24 blocks for one item
    assert [tuple(r)[:3] for r in got.collect()] == [(1, 1, 3)]
