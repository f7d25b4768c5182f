"""Every stage of the corpus pipeline against a brute-force version on its own input."""

import brute
import pytest
from odd_inputs import SF
from pyspark.sql import functions as F

import corpus_pipeline as P
from tieout.llm import quality
from tieout.llm.common import read, written


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read(spark, SF, "documents"), {}
    for name, stage in P.STAGES:
        after = written(stage(spark, docs, SF), name)
        out[name] = (docs, after)
        docs = after
    return out


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns_of_documents_stay(spark, stages):
    want = read(spark, SF, "documents").dtypes
    assert all(after.dtypes == want for name, (_, after) in stages.items() if name != P.STAGES[-1][0])
    assert [n for n, _ in P.STAGES] == list(stages)


def test_quality_filter(spark, stages):
    before, after = stages["quality_filter"]
    labels = read(spark, SF, "labels")
    scores = {r.doc_id: r.predicted for r in quality.classify(before, labels).collect()}
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    assert kept == {d for d, p in scores.items() if p == 1}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & kept) >= 0.95 * len(good & set(scores))


def test_dedup_lines(stages):
    before, after = stages["dedup_lines"]
    assert sorted(pairs(after), key=str) == sorted(((x[0], x[4]) for x in brute.dedup(pairs(before))), key=str)
    assert after.where("n_chars <> length(text)").count() == 0


def test_drop_near_copies(stages):
    before, after = stages["drop_near_copies"]
    texts = dict(pairs(before))
    classes = {d: c for d, c, _ in brute.jaccard(pairs(before))}
    want = {c for d, c in classes.items() if brute.words(texts[d])} | {d for d, t in texts.items() if not brute.words(t)}
    assert {d for d, _ in pairs(after)} == want


def test_drop_leaks(spark, stages):
    before, after = stages["drop_leaks"]
    items = [r.text for r in read(spark, SF, "benchmark").collect() if r.text]
    rows = pairs(before)
    leaking = {d for d, t in rows if any(x in (t or "") for x in items)}
    kept = {d for d, _ in pairs(after)}
    assert not leaking & kept
    gone = {d for d, _ in rows} - kept
    words = {d: set(brute.words((t or "").lower())) for d, t in rows}
    for d in gone - leaking:  # any other that goes shares most words with an item
        assert max(len(words[d] & set(brute.words(x.lower()))) / len(set(brute.words(x.lower()))) for x in items) > 0.4


def test_mix_sources(stages):
    before, after = stages["mix_sources"]
    sizes = {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, brute.mix_targets([sizes[s] for s in order])))
    taken = {r.source: r.n for r in after.groupBy("source").agg(F.sum("n_words").alias("n")).collect()}
    assert taken == {s: int(t) for s, t in goal.items() if int(t)}
    assert all(len(brute.words(r.text)) == r.n_words for r in after.collect())


def test_run_gives_the_last_stage(spark, stages):
    _, after = stages["mix_sources"]
    got = P.run(spark, SF)
    assert got.columns == after.columns
    cols = ["shard", "slot", "at", "doc_id", "n_words"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, after.select(cols).collect()))
