"""Line dedup, mixing, compression rules, license scan and personal data against brute force."""

import hashlib

import brute
import numpy as np
import pytest
from odd_inputs import SF, odd_rows
from pyspark.sql import functions as F

from tieout.llm import compression, license_scan, line_dedup, mixing, pii, queries

PAIRS = [(r[0], r[1]) for r in odd_rows()]


def same(found, expected):
    assert sorted(found, key=str) == sorted(expected, key=str)


def sf_pairs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("shard_keys,block_bytes", [(1 << 14, 2 << 20), (7, 3000)])
def test_line_dedup(odd, shard_keys, block_bytes):
    got = line_dedup.dedup_lines(odd, shard_keys=shard_keys, block_bytes=block_bytes).select(
        "row.doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text").collect()
    same([tuple(r) for r in got], brute.dedup(PAIRS))


def test_line_dedup_keeps_columns_and_empty(odd, none):
    out = line_dedup.dedup_lines(none)
    assert out.count() == 0
    assert [f.name for f in out.schema["row"].dataType] == [c for c in odd.columns if c != "text"]


def test_minimal_perfect_hash_is_a_bijection_and_rejects_most_strangers():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    blob, slots = line_dedup.mphf_build(keys)
    assert sorted(slots) == list(range(5000))
    f = line_dedup.Mphf(blob)
    assert (f(keys) == slots).all()
    blob, slots = line_dedup.mphf_build(np.array([5, 5, 9], np.uint64))  # equal keys are listed, none is lost
    assert sorted(slots) == [0, 1, 2] and line_dedup.Mphf(line_dedup.mphf_build(np.empty(0, np.uint64))[0])(
        np.array([3], np.uint64))[0] == -1


@pytest.mark.parametrize("block_words,shard_slots", [(512, 1 << 14), (16, 10)])
def test_mixing(odd, block_words, shard_slots):
    mix = mixing.Mix(odd, block_words=block_words, shard_slots=shard_slots)
    rows = mix.taken().collect()
    again = mixing.mix_sources(odd, block_words=block_words, shard_slots=shard_slots).collect()
    same([tuple(r) for r in rows], [tuple(r) for r in again])
    sizes, taken, target = {}, {}, {}
    same([(r.doc_id, r["size"]) for r in rows], [(d, len(brute.words(t))) for d, t in PAIRS])
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, brute.mix_targets([sizes[s] for s in order])):
        assert target[s] == pytest.approx(t) and taken[s] == int(target[s])
    assert all(r.source_size == sizes[r.source] for r in rows)


def test_mix_rows_hold_the_words(odd):
    rows = mixing.Mix(odd, block_words=16, shard_slots=10, with_text=True).rows().collect()
    texts = {}
    for d, t in PAIRS:
        texts.setdefault(d, set()).add(" ".join(brute.words(t)))
    for r in rows:
        piece = " ".join(brute.words(r.text))
        assert len(brute.words(r.text)) == r.n_words
        assert any(piece in t for t in texts[r.doc_id])
    sums = {}
    for r in rows:
        sums[r.shard, r.slot] = sums.get((r.shard, r.slot), 0) + r.n_words
    assert max(sums.values()) <= 16
    plain = mixing.Mix(odd, block_words=16, shard_slots=10).rows().agg(F.sum("n_words"), F.count("*")).first()
    assert (sum(sums.values()), len(rows)) == tuple(plain)


def test_mixing_empty_and_no_words(spark, odd, none):
    assert mixing.mix_sources(none).count() == 0
    silent = odd.withColumn("text", F.lit(None).cast("string"))
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix_sources(silent).collect())


def test_permutation():
    for n in (1, 2, 3, 10, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(got) == list(range(n))


def test_compression_rules(odd, none):
    rows = compression.compression_rules(odd).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
          for r in rows], [(d, *brute.rule_counts(t)) for d, t in PAIRS])
    assert not any(r.kept for r in rows if r.base_failed)
    kept = {r.doc_id for r in rows if r.kept}
    assert 50 in kept and 52 not in kept and 51 not in kept
    assert compression.compression_rules(none).count() == 0


def test_compression_bands_reject_noise(spark):
    rng = np.random.default_rng(3)
    noise = " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 12)) for _ in range(800))
    row = compression.compression_rules(spark.createDataFrame([(1, noise)], "doc_id long, text string"),
                                        whole_bands=((0, 1.4, 9.0),)).first()
    assert row.incompressible and not row.base_failed and not row.kept


def test_license_scan(odd, none):
    rows = license_scan.license_scan(odd).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows],
         [(d, *brute.license_base(t)) for d, t in PAIRS])
    row = next(r for r in rows if r.doc_id == 54)
    assert row.labels == "cc-by,cc-by-nc,gpl,reserved" and row.score == 1.0
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in rows)
    assert license_scan.license_scan(none).count() == 0


def test_license_template_survives_small_edits(spark):
    text = license_scan.TEMPLATES[0][0]
    edited = text.replace("this software", "this fine software").replace("charge", "cost")
    far = "permission is hereby granted " + "to nobody " * 20
    docs = spark.createDataFrame([(1, "x y " + edited + " z"), (2, far)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert got[1].labels == "mit" and 0.8 <= got[1].score < 1 and got[2].labels == ""


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_personal_data(spark, odd, none):
    rows = pii.personal_data(odd).collect()
    expected = []
    for d, t in PAIRS:
        spans = brute.base_personal(t)
        expected.append((d, *(sum(s[0] == k for s in spans) for k in pii.BASE), digest(spans)))
    same([tuple(r)[:6] for r in rows], expected)
    row = next(r for r in rows if r.doc_id == 53)
    assert all(f"{k}:{a}:{b}" in row.spans.split(",") for k, a, b in brute.base_personal(dict(PAIRS)[53]))
    assert pii.personal_data(none).count() == 0


def test_personal_data_on_adversarial_texts(spark):
    texts = ["a" * 100000 + " @", "a.b" * 40000 + " @", "x@" + "a." * 20000 + "b", "1" * 100000, "1.2.3.4," * 3000,
             "+1 " * 30000, "1-" * 30000 + "1", "@" * 50000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(docs).collect():  # Python's engine needs quadratic time for the first two
        spans = brute.base_personal(texts[r.doc_id]) if r.doc_id > 1 else []
        assert r.base_sha256 == digest(spans), r.doc_id


def test_personal_data_plan_has_no_python(spark, odd):
    plan = pii.candidates(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_queries_against_brute_force_on_test_data(spark):
    pairs = sf_pairs(spark)
    got = [tuple(r) for r in queries.op2_line_dedup(spark, SF).collect()]
    same(got, [x[:4] for x in brute.dedup(pairs)])
    rows = queries.op8_compression_rules(spark, SF).collect()
    same([tuple(r)[:7] for r in rows], [(d, *brute.rule_counts(t)) for d, t in pairs])
    rows = queries.op10_license_scan(spark, SF).collect()
    same([tuple(r)[:6] for r in rows], [(d, *brute.license_base(t)) for d, t in pairs])
    rows = queries.op6_personal_data(spark, SF).collect()
    same([(r.doc_id, r.base_sha256) for r in rows], [(d, digest(brute.base_personal(t))) for d, t in pairs])
