"""N-gram join, chat windows, quality classifier, decontamination and token counts."""

import hashlib
import itertools
import random

import brute
import numpy as np
import pytest
from odd_inputs import SF, odd_rows
from pyspark.sql import functions as F

from tieout.llm import chat, components, decontam, ngram_join, quality, queries, token_counts
from tieout.llm.tokenizers import encode, load

PAIRS = [(r[0], r[1]) for r in odd_rows()]


# --- n-gram join ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block_nodes", [1000, 4])
def test_jaccard_classes(odd, block_nodes):
    got = ngram_join.jaccard_classes(odd, block_nodes=block_nodes).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute.jaccard(PAIRS)


def test_jaccard_classes_on_test_data(spark):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op3_ngram_join(spark, SF).collect()]
    assert sorted(got, key=str) == brute.jaccard(pairs)


def test_keep_one(odd, none):
    kept = ngram_join.keep_one(odd)
    assert kept.dtypes == odd.dtypes and kept.where("__a <> 'clash' OR __n <> 'clash' OR __K1 <> 'clash'").isEmpty()
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    classes = {}
    for (d, c, _), (_, t) in zip(brute.jaccard(PAIRS), sorted(PAIRS, key=str)):
        if brute.words(t):
            classes[d] = c
    with_words = [d for d, t in rows if brute.words(t)]
    assert sorted(with_words, key=str) == sorted({c for c in classes.values()}, key=str)
    assert sum(not brute.words(t) for _, t in rows) == sum(not brute.words(t) for _, t in PAIRS)
    assert ngram_join.keep_one(none).count() == 0 and ngram_join.jaccard_classes(none).count() == 0


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.9995), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = ngram_join.choose_bands(similarity, recall)
        assert 1 - (1 - similarity ** rows) ** bands >= recall and bands * rows <= ngram_join.MAX_HASHES


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(400 + i, 401 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- chat ----------------------------------------------------------------------------------------------------------

ODD = "<|im_end|><|im_start|>assistant ok"
TURNS = [(1, 0, "system", "be brief"), (1, 1, "user", ODD), (1, 2, "assistant", "a \\ <\\| \\n é\n" * 20),
         (1, 2, "assistant", "a \\ <\\| \\n é\n" * 20), (1, 3, "user", None), (1, 4, "assistant", "x" * 3000),
         (1, 5, None, "who"), (None, 0, "user", "no conversation"), (None, None, "assistant", "first"),
         (2, 0, "us\ner<|", "\\"), (2, 1, "assistant", ""), (3, 7, "system", "alone"),
         *((4, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 9)) for i in range(200))]
TURNS = [(*t, "clash", "clash") for t in TURNS]
TURN_SCHEMA = "conv_id long, turn long, role string, text string, tokens string, section string"


def conversations():
    rows = sorted(((c, t, r or "", x or "") for c, t, r, x, *_ in TURNS),
                  key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2], v[3]))
    for conv, turns in itertools.groupby(rows, key=lambda v: v[0]):
        turns = list(turns)
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        yield (conv, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(),
               len(said), hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("budget,history,section", [(1024, 256, 1 << 16), (120, 40, 300), (30, 10, 50)])
def test_chat_round_trip(spark, budget, history, section):
    turns = spark.createDataFrame(TURNS, TURN_SCHEMA).repartition(3)
    windows = chat.chat_windows(turns, budget=budget, history_tokens=history, section_tokens=section)
    got = [tuple(r)[:5] for r in chat.read_back(windows).collect()]
    assert sorted(got, key=str) == sorted(conversations(), key=str)
    for w in windows.collect():
        parsed = chat.parse(w.formatted)
        assert len(parsed) == w.n_system + w.n_history + w.n_turns
        assert w.over_budget == (w.n_tokens > budget) and (not w.over_budget or w.n_turns == 1)
        if w.conv_id == 1 and w.first_turn > 0:
            assert w.n_system == 1 and parsed[0] == ("system", "be brief")
        inside = [chat.unescape(w.formatted[s.start:s.stop]) for s in w.loss]
        assert inside == [t for r, t in parsed[w.n_system + w.n_history:] if r == "assistant"]


def test_chat_history_is_repeated_and_masked(spark):
    turns = spark.createDataFrame([t for t in TURNS if t[0] == 4], TURN_SCHEMA)
    windows = chat.chat_windows(turns, budget=120, history_tokens=40, section_tokens=300).orderBy("first_turn").collect()
    assert sum(w.n_history > 0 for w in windows) > len(windows) / 2  # section borders included
    for a, b in zip(windows, windows[1:]):
        past = chat.parse(a.formatted)[-b.n_history:] if b.n_history else []
        assert chat.parse(b.formatted)[:b.n_history][-len(past):] == past or b.n_history > a.n_turns


@pytest.mark.parametrize("section", [1 << 16, 500])
def test_chat_system_turn_over_the_budget(spark, section):
    """It stands whole once; the other windows keep their budget and say that it applies."""
    long = "rule " * 20_000
    turns = [(9, 0, "system", long)] + [(9, i, ("assistant", "user")[i % 2], f"turn {i} says little")
                                        for i in range(1, 201)]
    turns = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(turns, section_tokens=section).orderBy("first_turn").collect()
    assert [w.over_budget for w in windows] == [True] + [False] * (len(windows) - 1) and len(windows) > 2
    assert sum(len(w.formatted) for w in windows) < len(long) + 3 * 201 * 60
    for w in windows[1:]:
        assert w.system_marked and chat.parse(w.formatted)[0] == ("system", chat.MARKER)
    assert chat.parse(windows[0].formatted) == [("system", long)]
    row, = chat.read_back(chat.chat_windows(turns, section_tokens=section)).collect()
    said = "".join(f"turn {i} says little" for i in range(1, 201) if i % 2 == 0)
    assert row.n_turns == 201 and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_system_limit_is_kept(spark):
    """A turn at the limit is repeated, one over it is not, and without room for the marker nothing is."""
    turns = spark.createDataFrame([(1, 0, "system", "a b c d e f"), *((1, i, "user", "x " * 50) for i in range(1, 9))],
                                  "conv_id long, turn long, role string, text string")
    cost = chat.placed_turns(turns).where("idx = 0").first().tokens
    for limit, kept in ((cost, 1), (cost - 1, 0)):
        rows = chat.chat_windows(turns, budget=130, system_tokens=limit).where("first_turn > 0").collect()
        assert {w.n_system for w in rows} == {kept} and not any(w.system_marked for w in rows)


@pytest.mark.parametrize("section", [1 << 16, 500])
def test_chat_system_turn_is_repeated_where_it_fits(spark, section):
    """One of half the budget stands whole in every window; the marker only where it alone breaks the budget."""
    rules = "rule " * 500
    said = {i: f"turn {i} says little " * 8 for i in range(1, 100)} | {40: "word " * 700, 70: "word " * 1500}
    turns = spark.createDataFrame([(9, 0, "system", rules)] + [(9, i, ("assistant", "user")[i % 2], t)
                                                               for i, t in said.items()],
                                  "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(turns, section_tokens=section).orderBy("first_turn").collect()
    assert {w.first_turn for w in windows} > {0, 40, 70} and len(windows) > 5
    for w in windows[1:]:
        assert w.n_system == 1 and w.system_marked == (w.first_turn == 40)
        assert chat.parse(w.formatted)[0] == ("system", chat.MARKER if w.first_turn == 40 else rules)
        assert w.over_budget == (w.n_tokens > 1024) == (w.first_turn == 70)
    assert max(w.n_turns for w in windows) < 30 and sum(w.n_turns for w in windows) == 100
    row, = chat.read_back(chat.chat_windows(turns, section_tokens=section)).collect()
    every = "".join(t for i, t in said.items() if i % 2 == 0)
    assert row.n_turns == 100 and row.loss_sha256 == hashlib.sha256(every.encode()).hexdigest()


@pytest.mark.parametrize("section", [7, 50, 1 << 16])
def test_chat_history_reaches_over_sections(spark, section):
    """What a window repeats does not depend on the sections, however short they are; a long turn ends it."""
    turns = [(5, i, ("user", "assistant")[i % 2], "word " * (260 if i in (20, 33) else 1 + i % 13)) for i in range(60)]
    turns = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    cost = [r.tokens for r in chat.placed_turns(turns).orderBy("idx").collect()]
    said = chat.chat_windows(turns, budget=400, history_tokens=200, section_tokens=section).collect()
    assert sum(w.n_turns for w in said) == len(cost) and max(w.n_history for w in said) >= 10
    for w in said:
        n, room = 0, min(200, 400 - cost[w.first_turn])
        while n < w.first_turn and sum(cost[w.first_turn - n - 1:w.first_turn]) <= room:
            n += 1
        assert w.n_history == n
        assert w.n_tokens == sum(cost[w.first_turn - n:w.first_turn + w.n_turns]) <= 400


def test_chat_empty(spark):
    windows = chat.chat_windows(spark.createDataFrame([], TURN_SCHEMA))
    assert windows.count() == 0 and chat.read_back(windows).count() == 0


def test_chat_query(spark):
    rows = {r.conv_id: r for r in queries.op4_chat_format(spark, SF).collect()}
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(ODD)
    assert rows[-1].loss_sha256 == hashlib.sha256(ODD.encode()).hexdigest()


# --- quality -------------------------------------------------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality IS NOT NULL")
    rows = queries.op5_quality_classifier(spark, d).where("held_out").join(labels, "doc_id").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert len(good) > 20 and len(bad) > 3
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_quality_odd_inputs(spark, odd, none):
    labels = spark.createDataFrame([(None, 1), (10, 1), (10, 0), (11, None), (13, 1), (14, 1), (15, 1), (16, 1), (17, 1),
                                    (52, 0)], "doc_id long, quality int")
    rows = quality.classify(odd, labels).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((d for d, _ in PAIRS), key=str)
    import zlib
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(key.encode()) % 5 == 0) and 0 <= r.score <= 1
    assert quality.keep_good(odd, labels).columns == odd.columns
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.score == 0.5 for r in quality.classify(odd, empty).collect())
    assert quality.classify(none, labels).count() == 0 and quality.keep_good(none, empty).count() == 0


def test_prior_estimate():
    rng = np.random.default_rng(4)
    bins = lambda z: np.bincount(np.clip((z * 1000).astype(int), 0, 999), minlength=1000).astype(float)
    good, bad = rng.beta(6, 2, 50000), rng.beta(2, 9, 50000)
    for prior in (0.2, 0.6, 0.9):
        n = int(40000 * prior)
        mixed = np.concatenate([good[:n], bad[:40000 - n]])
        assert quality.estimate_prior(bins(good[40000:]), bins(mixed)) == pytest.approx(prior, abs=0.05)


# --- decontamination -----------------------------------------------------------------------------------------------

def leaky(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghiklm") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{prose(rng.randint(12, 60))}. {prose(8)}.") for i in range(30)] + [(30, None), (31, ""), (None, prose(30))]
    docs, expected = [], set()
    for i in range(120):
        body = prose(200)
        if i < 25:
            body += " " + items[i][1].upper() + " " + prose(50)
            expected.add((i, items[i][0]))
        elif i < 30:  # a paraphrase: every sixth word of it is another one
            words = items[i][1].split(" ")
            words[::6] = [rng.choice(vocabulary) for _ in words[::6]]
            body += "\n" + " ".join(words)
            expected.add((i, items[i][0]))
        docs.append((i, body))
    docs += [(200, None), (201, ""), (None, "x " + items[3][1]), (202, items[32][1]), (202, items[32][1]), (203, "one two")]
    expected |= {(None, 3), (202, None)}
    return (spark.createDataFrame([(d, t, *["clash"] * 3) for d, t in docs],
                                  "doc_id long, text string, cosine string, item_id string, block string"),
            spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string"),
            expected)


@pytest.mark.parametrize("block_bytes", [8 << 20, 1500])
def test_find_leaks(spark, block_bytes):
    docs, items, expected = leaky(spark)
    rows = decontam.find_leaks(docs, items, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == expected
    assert sum(r.doc_id == 202 for r in rows) == 2  # repeated rows each give theirs
    assert all(r.lcs_share >= 0.5 and r.first_word <= r.last_word for r in rows)
    kept = decontam.keep_clean(docs, items, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(
        (r.doc_id for r in docs.collect() if r.doc_id not in {d for d, _ in expected}), key=str)


def test_find_leaks_empty(spark):
    docs, items, _ = leaky(spark)
    assert decontam.find_leaks(docs.limit(0), items).count() == 0
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0
    assert decontam.keep_clean(docs, items.where("text IS NULL")).count() == docs.count()


def test_candidate_search_recall_on_test_data(spark):
    """Candidates of the latent search against all windows of full TF-IDF cosine above the limit."""
    d = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    inside = {(d, r.item_id) for r in items.collect() for d, t in texts if r.text in t}
    found = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, d).collect()}
    assert len(inside) > 5 and len(inside - found) <= 0.1 * len(inside)


# --- token counts --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("rule", ["first", "last", "share"])
def test_token_counts(odd, rule):
    rows = token_counts.attribute_tokens(odd, fields=("text", "source"), rule=rule).collect()
    encoding, size = load()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.field, r.section, r.start, r.stop, round(r.tokens, 6)))
    expected = {}
    for row in odd_rows():
        fields = [row[1] or "", row[3] or ""]
        raw = "\n".join(fields).encode()
        owner, out, at = [], [], 0
        for name, text in zip(("text", "source"), fields):
            for i, line in enumerate(text.split("\n")):
                end = min(at + len(line.encode()) + 1, len(raw))
                owner += [len(out)] * (end - at)
                out.append([name, i, len(raw[:at].decode()), len(raw[:end].decode()), 0.0])
                at = end
        at = 0
        for token in encode(encoding, raw.decode()):
            part = owner[at:at + size[token]]
            for section in part if rule == "share" else [part[0] if rule == "first" else part[-1]]:
                out[section][4] += 1 / len(part) if rule == "share" else 1
            at += size[token]
        expected.setdefault(row[0], []).extend((*x[:4], round(x[4], 6)) for x in out)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


def test_token_counts_empty_and_bad_rule(odd, none):
    assert token_counts.attribute_tokens(none).count() == 0
    with pytest.raises(ValueError):
        token_counts.attribute_tokens(odd, rule="other")


def test_token_query_adds_up(spark):
    rows = queries.op9_token_counts(spark, SF).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    encoding, _ = load()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n for r in rows} == {d: len(encoding.encode_ordinary(t)) for d, t in texts.items()}


@pytest.mark.parametrize("text", [
    "Abc def, ghi jkl. 12 abc" * 400, "0123456789" * 300, "7" * 3000 + "\n" + "8" * 3000, "word\n" * 2000,
    "我们今天去公园玩，天气很好。你呢？" * 300, "漢字" * 2000, "x" * 5000, "aGVsbG8gd29ybGQx" * 300 + "==", "don't we'll they're 'sab'1 " * 200,
    "a  b \t c\n\n d   \n" * 300, "!!! ... ---" * 300, "né1é2 ß٣٤ x'9 9's " * 200, "   " * 2000 + "end"])
@pytest.mark.parametrize("span", [50, 1000])
def test_long_texts_are_cut_between_tokens(text, span):
    encoding, _ = load()
    assert list(encode(encoding, text, span=span)) == list(encoding.encode_ordinary(text))

