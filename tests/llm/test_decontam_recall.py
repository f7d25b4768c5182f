"""Decontamination: planted leaks that a screen, an alignment or a share can miss."""
import itertools
import random

import numpy as np
import pytest

from tieout.llm import decontam

WORDS = random.Random(4)
VOCABULARY = ["".join(WORDS.choice("abcdefghiklm") for _ in range(WORDS.randint(3, 9))) for _ in range(3000)]
CUMULATED = list(itertools.accumulate(1 / (rank + 10) for rank in range(len(VOCABULARY))))


def prose(rng, n, end=""):
    """Common words first, as in a language; ``end`` makes the words of another one."""
    return [w + end for w in rng.choices(VOCABULARY, cum_weights=CUMULATED, k=n)]


def found(spark, docs, items):
    rows = decontam.find_leaks(
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


@pytest.mark.parametrize("low, high, kept", [(24, 60, (0.5, 0.67)), (4, 12, (1.0, 1.0))])
def test_planted_leaks_are_found(spark, low, high, kept):
    """Paraphrases that keep half to two thirds of the words (the answer whole), and short items word for word."""
    rng = random.Random(8)
    items = [prose(rng, rng.randint(low, high)) for _ in range(150)]
    docs = []
    for item in items:
        answer = len(item) - max(1, len(item) // 4)
        lost = rng.sample(range(answer), int((1 - rng.uniform(*kept)) * len(item)))
        altered = [f"other{rng.randint(0, 10 ** 9)}" if i in lost else w for i, w in enumerate(item)]
        docs.append(prose(rng, rng.randint(30, 90), "z") + altered + prose(rng, 60, "z"))
    got = found(spark, docs, items)
    assert sum((i, i) in got for i in range(len(items))) >= 0.95 * len(items)


def leaking(text, item, answer=10):
    """Whether ``text`` leaks ``item``, whose last ``answer`` words are its answer, by verification alone."""
    number = {w: k for k, w in enumerate(dict.fromkeys(text + item))}
    h = [np.array([number[w] for w in words], np.uint64) for words in (text, item)]
    return decontam.verify(decontam.Item(0, h[1], len(item) - answer), h[0], 0, len(text))


ITEM = [f"i{k}" for k in range(40)]
REST = [f"r{k}" for k in range(200)]


@pytest.mark.parametrize("text", [
    REST[:30] + ITEM + REST[30:50] + ITEM[-tail:] + REST[50:90] for tail in (10, 14, 20)] + [
    REST[:30] + ITEM + REST[30:50] + ITEM[:25] + REST[50:90],
    REST[:30] + ITEM[15:] + REST[30:50] + ITEM + REST[50:90],
    REST[:30] + ITEM[:20] + REST[30:45] + ITEM[20:] + REST[50:90],
    REST[:30] + ITEM[:29] + REST[30:31] + ITEM[30:] + REST[30:50] + ITEM[-14:] + REST[50:90],
    ITEM[:16] + REST[:30] + ITEM + REST[30:44] + ITEM[-12:]])
def test_leak_beside_a_second_part_of_itself(text):
    leak, share, answer, first, last = leaking(text, ITEM)
    assert leak and share == 1.0 and answer == 1.0
    assert text[first] in ITEM and text[last] in ITEM


def test_verbatim_runs_are_leaks_whatever_their_share(spark):
    rng = random.Random(2)
    question = prose(rng, 39, "q")
    long = prose(rng, 150, "l")
    items = [question + ["."] + prose(rng, 10, "a"), long, prose(rng, 6, "s"), prose(rng, 40, "n")]
    around = lambda words: prose(rng, 60, "z") + words + prose(rng, 60, "z")
    gap = items[3][5:12] + ["zzz"] + items[3][13:20]
    docs = [around(question[:30]), around(long[20:90]), around(items[2]), around(gap), around(items[3][4:17]),
            around(items[3][4:13]), around(long[:6] + prose(rng, 30, "z") + long[70:77])]
    assert set(found(spark, docs, items)) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3)}


def test_longest_run():
    a = np.arange(40)
    other = np.arange(100, 160)
    join = lambda *parts: np.concatenate(parts)
    assert decontam.longest_run(a, join(other[:9], a[3:20], other[9:]))[:1] == (17,)
    assert decontam.longest_run(a, join(other[:9], a[:7], other[9:10], a[8:20]))[:3] == (19, 9, 28)
    assert decontam.longest_run(a, join(a[:7], a[8:20]))[:3] == (19, 0, 18)
    assert decontam.longest_run(a, join(a[:7], other[:2], a[7:20]))[:1] == (13,)
    assert decontam.longest_run(a, other)[:1] == (0,) and decontam.longest_run(a, a[:0])[:1] == (0,)


def test_texts_that_come_near_no_item(spark):
    docs = spark.createDataFrame([(1, "zzz yyy xxx"), (2, None), (3, ""), (4, "qqq " * 50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, " . ")],
                                  "item_id long, text string")
    assert decontam.find_leaks(docs, items).count() == 0 and decontam.keep_clean(docs, items).count() == 4


def test_the_driver_decomposes_the_rows_that_are_there(spark):
    """Most features stand in no benchmark item; their zeros were decomposed with the rest."""
    import tracemalloc
    rng = random.Random(4)
    items = spark.createDataFrame([(" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(60)),)
                                   for _ in range(30)], "text string")
    idf = np.ones(1 << decontam.DF_BITS)
    tracemalloc.start()
    basis = decontam.latent_space(items, idf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert basis.shape[0] == 1 << decontam.FEATURE_BITS and basis.shape[1] > 20
    assert peak < 5 * 4 * decontam.RANK << decontam.FEATURE_BITS  # five bases; all rows in doubles took more
    held = np.flatnonzero(np.abs(basis).sum(1))
    assert 0 < len(held) < 1000
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)


def test_vectors_of_the_rows_are_those_of_the_whole_matrix():
    rng = np.random.default_rng(1)
    features, rows = rng.permutation(500)[:40], rng.normal(size=(40, 6))
    rows[:, 5] = rows[:, 4]  # a direction without weight goes
    whole = np.zeros((500, 6))
    whole[features] = rows
    u, s, _ = np.linalg.svd(whole, full_matrices=False)
    u = u[:, s > 1e-6 * s[0]]
    got = decontam._orthonormal(features, rows.ravel(), 500)
    assert got.shape == (500, 5) == u.shape and np.allclose(got @ got.T, u @ u.T, atol=1e-5)
