"""Quality classifier by positive-unlabelled learning (operator 5).

Trusted positives are training rows whose label marks them as good; all
training rows are the unlabelled web text. A small network over text statistics
minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss. The class prior is estimated first: a network that
tells positives from unlabelled rows scores every training row, and the prior
is the smallest ratio, over thresholds, of the share of unlabelled rows to the
share of (unseen) positives above the threshold, with a margin for chance. The
shares come from one distributed histogram of all training rows.

Only the fit is bounded: it uses at most ``sample_rows`` positives and as many
unlabelled rows, taken by hash order. Statistics and scores cover every row.
Labels, lang, source and doc_id are never inputs of a score.

Defined results: a null text is empty; empty texts get the score of an empty
text's statistics; a null doc_id counts as held out; a document with several
labels is a positive only if all say so; null labels are ignored; repeated rows
are scored each; an empty table gives an empty table; without any positive all
scores are 0.5; other columns are ignored by the score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written
from .kernels import (NOT_WHITESPACE, WordHasher, before, pieces, repeated_words, split_words, starts_code_point,
                      text_buffers, word_docs)

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
BINS = 1000
HIDDEN, EPOCHS, BATCH_ROWS, RATE, DECAY = 24, 40, 512, 0.01, 1e-4


def byte_classes() -> np.ndarray:
    """A row of flags for each class of bytes whose share is a feature."""
    sets = [range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b"#*$%&|<>", b"!?", b".,;:", b"'\"()[]{}-_/\\@+=~^`",
            b" ", b"\n", [*range(0x09), *range(0x0E, 0x20), 0x7F], range(0xC0, 0x100)]
    table = np.zeros((len(sets), 256), bool)
    for row, values in zip(table, sets):
        row[list(values)] = True
    return table


def text_features(column, hasher: WordHasher, classes: np.ndarray) -> np.ndarray:
    """One row of statistics for each whole text."""
    all_data, all_off = text_buffers(column)
    out = []
    for a, b in pieces(all_off):
        data, off = all_data[all_off[a]:all_off[b]], all_off[a:b + 1] - all_off[a]
        starts, ends, doc_words = split_words(data, off, NOT_WHITESPACE)
        h, docs, n = hasher(data, starts, ends), word_docs(doc_words), np.diff(doc_words)
        chars = np.diff(before(starts_code_point(data))[off]) if len(data) else np.zeros(b - a, np.int64)
        per_char, per_word = 1 / np.maximum(chars, 1), 1 / np.maximum(n, 1)

        def share(flags):  # of words
            return np.diff(before(flags)[doc_words]) * per_word
        length = ends - starts
        cols = [np.log1p(chars), np.log1p(n), np.diff(before(length)[doc_words]) * per_word]
        cols.append(np.sqrt(np.maximum(np.diff(before(length ** 2)[doc_words]) * per_word - cols[2] ** 2, 0)))
        cols += [np.diff(before(flags[data])[off]) * per_char for flags in classes]
        first, last = data[starts], data[ends - 1]
        upper, lower = classes[0], classes[1]
        cols += [share(upper[first]), share(upper[last]), share(classes[3][last]), share(classes[4][last]),
                 share(classes[5][last]), share(classes[2][first]), share((length == 1) & ~lower[first]),
                 share(repeated_words(h, docs, 4)), share(repeated_words(h, docs, 8))]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (docs[1:] == docs[:-1])
        cols.append(share(again))
        more = []
        for i in range(b - a):
            raw = data[off[i]:off[i + 1]].tobytes()
            lines = [x for x in raw.split(b"\n") if x.strip()]
            count = np.unique(h[doc_words[i]:doc_words[i + 1]], return_counts=True)[1]
            p = count / max(n[i], 1)
            spread = -(p * np.log(np.maximum(p, 1e-12))).sum()
            more.append((len(count) * per_word[i], p.max(initial=0), spread / max(np.log(max(n[i], 2)), 1),
                         1 - len(set(lines)) / len(lines) if lines else 0, np.log1p(len(lines)),
                         np.log1p(chars[i] / max(len(lines), 1)),
                         len(raw) / max(len(zlib.compress(raw, 1)), 1)))
        out.append(np.column_stack([*cols, np.array(more)]))
    width = len(classes) + 21
    return np.concatenate([*out, np.empty((0, width))]).astype(np.float32)


def _features():
    classes = byte_classes()

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            x = text_features(batch.column("text"), hasher, classes)
            at = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "held_out", "x"])
    return run


class Net:
    """One hidden layer over standardised statistics; picklable arrays only."""

    def __init__(self, x: np.ndarray, seed: int, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        d = x.shape[1]
        self.w = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden),
                  np.zeros(1)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.w
        return np.tanh(self.scaled(x) @ w + b) @ v + c

    def fit(self, p: np.ndarray, u: np.ndarray, slopes, seed: int, epochs: int = EPOCHS) -> "Net":
        """Adam over batches of positives and unlabelled rows; ``slopes(zp, zu)`` gives
        the derivatives of the risk by the logits."""
        rng, p, u = np.random.default_rng(seed), self.scaled(p), self.scaled(u)
        m = [np.zeros_like(a) for a in self.w]
        s = [np.zeros_like(a) for a in self.w]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(u))
            for lo in range(0, len(u), BATCH_ROWS):
                xu = u[order[lo:lo + BATCH_ROWS]]
                xp = p[rng.integers(0, len(p), len(xu))]
                x = np.concatenate([xp, xu])
                w, b, v, c = self.w
                a = np.tanh(x @ w + b)
                z = a @ v + c
                dz = np.concatenate(slopes(z[:len(xp)], z[len(xp):]))
                da = np.outer(dz, v) * (1 - a ** 2)
                grads = [x.T @ da, da.sum(axis=0), a.T @ dz, np.array([dz.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    g = g + DECAY * self.w[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - RATE * (m[i] / (1 - 0.9 ** step)) / (
                        np.sqrt(s[i] / (1 - 0.999 ** step)) + 1e-8)
        return self


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def plain_slopes(zp: np.ndarray, zu: np.ndarray) -> tuple:
    """Positives against unlabelled rows as if those were negatives."""
    return -sigmoid(-zp) / len(zp), sigmoid(zu) / len(zu)


def non_negative_slopes(prior: float):
    """Derivatives of the non-negative risk. Where the negative part of the risk is
    below zero, the step goes against it, which undoes the overfit."""
    def slopes(zp, zu):
        part = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        neg_u, neg_p = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / len(zp)
        if part < 0:
            return -neg_p, -neg_u
        return -prior * sigmoid(-zp) / len(zp) + neg_p, neg_u
    return slopes


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Smallest ratio, over score bins from the top, of the shares above, with a margin."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if n_p == 0 or n_u == 0:
        return 0.5
    q_p, q_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    margin = np.sqrt(np.log(4 / delta) / (2 * n_p)) + np.sqrt(np.log(4 / delta) / (2 * n_u))
    ok = q_p > 0.01
    best = int(np.argmin(np.where(ok, (q_u + margin) / np.maximum(q_p, 1e-12), np.inf)))
    return float(np.clip(q_u[best] / q_p[best], 0.02, 0.98))


def _bins(net: Net):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            at = np.minimum((sigmoid(net.logit(x)) * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(at)], names=["kind", "bin"])
    return run


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the statistics of every whole text."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                      F.col("text").cast("string").alias("text"))
    return arrow_map(src, _features(), "doc_id long, held_out boolean, x array<float>")


def fit(stats: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> tuple:
    """(network, prior) from a features table; (None, 0.5) without positives."""
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("of")).agg(F.min("quality").alias("q")).where("q = 1").select("of")
    train = stats.where("NOT held_out")
    marked = train.join(good, F.col("doc_id") == F.col("of"))
    by_hash = F.xxhash64("doc_id", F.lit(seed))

    def sample(rows):
        # the first rows by hash: hashes are even, so a bound a little above the share that is
        # wanted leaves few rows to sort (six deviations: the bound practically never cuts into them)
        share = (sample_rows + 6 * sample_rows ** 0.5) / max(rows.count(), 1)
        if share < 1:
            rows = rows.where(by_hash < int((2 * share - 1) * 2 ** 63))
        got = rows.select("doc_id", "x", by_hash.alias("o")).orderBy("o", "doc_id").limit(sample_rows).toArrow()
        x = _matrix(got["x"].combine_chunks()) if got.num_rows else np.empty((0, 0))
        return x, got["o"].to_numpy()
    (p, o), (u, _) = sample(marked), sample(train)
    if len(p) < 2 or len(u) < 2:
        return None, 0.5
    half = o % 2 == 0
    half = half if half.any() and (~half).any() else np.arange(len(p)) % 2 == 0
    first = Net(u, seed).fit(p[half], u, plain_slopes, seed, epochs=EPOCHS // 2)
    # the prior: positives that the first network has not seen, against all training rows
    seen = by_hash % 2 == 0
    kinds = marked.where(~seen).select(F.lit(1).alias("kind"), "x").unionByName(
        train.select(F.lit(0).alias("kind"), "x"))
    hist = np.zeros((2, BINS))
    for r in arrow_map(kinds, _bins(first), "kind int, bin int").groupBy("kind", "bin").count().collect():
        hist[r["kind"], r["bin"]] = r["count"]  # two rows a bin at most
    prior = estimate_prior(hist[1], hist[0])
    return Net(u, seed).fit(p, u, non_negative_slopes(prior), seed), prior


def _score(net: Net | None):
    def run(batches):
        for batch in batches:
            z = sigmoid(net.logit(_matrix(batch.column("x")))) if net else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(z)],
                                             names=["doc_id", "held_out", "score"])
    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    stats = written(features(docs), "quality-features")
    net, _ = fit(stats, labels, **options)
    return arrow_map(stats, _score(net), "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def _filter(net: Net | None, threshold: float):
    classes = byte_classes()

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            if net is None:
                yield batch
                continue
            x = text_features(batch.column("text"), hasher, classes).astype(np.float64)
            yield batch.filter(pa.array(sigmoid(net.logit(x)) >= threshold))
    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""
    net, _ = fit(written(features(docs), "quality-features"), labels, **options)
    return arrow_map(docs, _filter(net, threshold), docs.schema)
