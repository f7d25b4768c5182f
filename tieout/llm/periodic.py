"""Runs of repeated words: block convolution at dyadic scales.

A run is a stretch of words with smallest period q (words q apart are equal),
at least ``max(min_words, min_exponent * q)`` words long, that no neighbouring
word extends. The search goes over scales L = 1, 2, 4, ...; scale L finds the
periods from 2L/3 up to, not including, 4L/3:

* A run of at least 4q words holds a whole aligned block of L <= 3q/2 words
  together with the block's copy q words later. So every aligned block is
  searched for in the words that follow it, at the scale's distances.
* Words become codes so small that a sum of L squared differences stays below
  the prime 998244353. The sums for all distances come from one number
  theoretic transform per block (sums of squares by prefix sums, the products
  by convolution) and are exact integers: zero means that all codes agree.
* Before that, a block is left out if one of its words (from L = 4 on: of its
  stretches of four words) has no equal one within the scale's largest distance
  (then no distance can match), or if a run found
  at a smaller scale covers the block up to its largest distance (then its
  matches belong to that run). Neither loses a run.
* A match (block, distance) is a seed. It is extended to both sides by
  comparing the words themselves, so equal codes of different words do no harm.
  A stretch that a run of a smaller period covers has that smaller period and
  is left out.

All texts of a piece of about 1 MB are searched at once: words of different
texts never have equal numbers, so nothing matches across texts. A text is
handled whole, in one task; memory follows the longest text.

Defined results: a null or empty text has no words and no runs; a null
``doc_id`` is never rewritten by ``repeat_tails``; repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .kernels import NOT_WHITESPACE, WordHasher, kgrams, mix, pieces, split_words, text_buffers, word_docs

MIN_WORDS = 6
MIN_EXPONENT = 4

#: Prime of the transform, 119 * 2**23 + 1, and a generator of its units.
P = 998244353
GENERATOR = 3
#: Sums of squared differences stay below 2**SUM_BITS < P.
SUM_BITS = 29
#: Numbers in the arrays of one batch of blocks.
BATCH = 1 << 20

SCHEMA = ("doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, "
          "runs_sha256 string, collapsed string")


def _roots(size: int, inverse: bool) -> np.ndarray:
    g = pow(GENERATOR, (P - 1) // size, P)
    g = pow(g, -1, P) if inverse else g
    out = np.ones(max(size // 2, 1), np.uint64)
    for h in range(max(size // 2, 1).bit_length() - 1):  # powers by doubling
        out[1 << h:2 << h] = out[:1 << h] * np.uint64(pow(g, 1 << h, P)) % np.uint64(P)
    return out


def _transform(a: np.ndarray) -> np.ndarray:
    """Transform of each row; the results stand in bit-reversed order."""
    size, p = a.shape[1], np.uint64(P)
    roots = _roots(size, False)
    half = size // 2
    while half:
        v = a.reshape(len(a), -1, 2, half)
        x, y = v[:, :, 0], v[:, :, 1]
        out = np.empty_like(v)
        out[:, :, 0] = (x + y) % p
        out[:, :, 1] = (x + (p - y)) * roots[::size // (2 * half)][:half] % p
        a, half = out.reshape(len(a), size), half // 2
    return a


def _back(a: np.ndarray) -> np.ndarray:
    """Inverse of ``_transform``."""
    size, p = a.shape[1], np.uint64(P)
    roots = _roots(size, True)
    half = 1
    while half < size:
        v = a.reshape(len(a), -1, 2, half)
        x, y = v[:, :, 0], v[:, :, 1] * roots[::size // (2 * half)][:half] % p
        out = np.empty_like(v)
        out[:, :, 0] = (x + y) % p
        out[:, :, 1] = (x + (p - y)) % p
        a, half = out.reshape(len(a), size), half * 2
    return a * np.uint64(pow(size, -1, P)) % p


def squared_differences(codes: np.ndarray, blocks: np.ndarray, length: int, low: int, high: int) -> np.ndarray:
    """Exact sums of (codes[b + i] - codes[b + d + i])**2 over i < length, for
    each block start b (rows) and distance low <= d <= high (columns).
    ``codes`` must hold ``length + high`` numbers after each block start."""
    size = 2 * length
    reach = length + high - low
    at = np.zeros((len(blocks), size), np.uint64)
    at[:, :length] = codes[blocks[:, None] + np.arange(length - 1, -1, -1)]
    window = np.zeros((len(blocks), size), np.uint64)
    window[:, :reach] = codes[blocks[:, None] + low + np.arange(reach)]
    own = (at * at).sum(axis=1)
    squares = np.zeros((len(blocks), size + 1), np.uint64)
    np.cumsum(window * window, axis=1, out=squares[:, 1:])
    t = np.arange(high - low + 1)
    product = _back(_transform(at) * _transform(window) % np.uint64(P))[:, length - 1 + t]
    total = own[:, None] + squares[:, length + t] - squares[:, t]
    return (total + np.uint64(2) * (np.uint64(P) - product)) % np.uint64(P)


def _covered(runs: tuple, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether one known run holds [start, stop)."""
    starts, furthest = runs
    if len(starts) == 0:
        return np.zeros(len(start), bool)
    at = np.searchsorted(starts, start, side="right") - 1
    return (at >= 0) & (furthest[np.maximum(at, 0)] >= stop)


def _extend(ids: np.ndarray, d: int, at: np.ndarray, length: int) -> np.ndarray:
    """Distinct maximal stretches (first, stop) whose words equal those d later,
    around the blocks ``at`` that match whole."""
    if len(at) >= 16 or len(ids) <= 4096:
        differ = np.flatnonzero(ids[:-d] != ids[d:])
        k = np.searchsorted(differ, at)
        edges = np.concatenate([[-1], differ, [len(ids) - d]])
        good = edges[k + 1] >= at + length
        return np.unique(np.stack([edges[k[good]] + 1, edges[k[good] + 1]], axis=1), axis=0)
    out: list[tuple[int, int]] = []
    for b in at.tolist():
        if out and b < out[-1][1]:
            continue
        if (ids[b:b + length] != ids[b + d:b + d + length]).any():
            continue
        first, stop, step = b, b + length, 64
        while stop < len(ids) - d:  # to the right, in steps that grow with what is found
            n = min(step, len(ids) - d - stop)
            bad = np.flatnonzero(ids[stop:stop + n] != ids[stop + d:stop + d + n])
            stop += int(bad[0]) if len(bad) else n
            if len(bad):
                break
            step *= 2
        step = 64
        while first > 0:
            n = min(step, first)
            bad = np.flatnonzero(ids[first - n:first] != ids[first - n + d:first + d])
            first -= n - 1 - int(bad[-1]) if len(bad) else n
            if len(bad):
                break
            step *= 2
        out.append((first, stop))
    return np.array(out, np.int64).reshape(-1, 2)


def _next_equal(keys: np.ndarray) -> np.ndarray:
    """Distance to the next equal key, a huge number without one."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), np.iinfo(np.int64).max, np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def find_runs(ids: np.ndarray, longest: int, *, min_words: int = MIN_WORDS,
              min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period. ``ids``
    are word numbers (uint64); ``longest`` bounds the words of one text."""
    if min_exponent < MIN_EXPONENT:
        raise ValueError("blocks are sure to lie in a run only from an exponent of 4")
    n = len(ids)
    found: list[np.ndarray] = []
    if n < min_words:
        return np.empty((0, 3), np.int64)
    nearest = {1: _next_equal(ids), 4: _next_equal(kgrams(ids, np.zeros(n, np.int64), 4)[0])}
    known = (np.empty(0, np.int64), np.empty(0, np.int64))
    length = 1
    while -(-2 * length // 3) * min_exponent <= longest:
        low, high = -(-2 * length // 3), -(-4 * length // 3) - 1
        starts = np.arange(0, n - length + 1, length)
        k = 4 if length >= 4 else 1
        near = np.lib.stride_tricks.as_strided(  # the block's k-grams, one row per block
            nearest[k], (len(starts), length - k + 1), (8 * length, 8), writeable=False).max(axis=1)
        starts = starts[(near <= high) & (starts + length + low <= n)]
        starts = starts[~_covered(known, starts, np.minimum(starts + length + high, n))]
        if len(starts):
            bits = max((SUM_BITS - (length.bit_length() - 1)) // 2, 1)
            codes = np.zeros(n + high + length, np.uint64)  # zeros, which no word has, follow the last word
            codes[:n] = mix(ids) % np.uint64((1 << bits) - 1) + np.uint64(1)
            seeds_at, seeds_d = [], []
            step = max(BATCH // (2 * length), 1)
            for i in range(0, len(starts), step):
                b = starts[i:i + step]
                row, col = np.nonzero(squared_differences(codes, b, length, low, high) == 0)
                seeds_at.append(b[row])
                seeds_d.append(col + low)
            at, d = np.concatenate(seeds_at), np.concatenate(seeds_d)
            keep = ~_covered(known, at, at + length + d)
            at, d = at[keep], d[keep]
            for q in np.unique(d).tolist():
                part = _extend(ids, q, at[d == q], length)
                rows = np.stack([part[:, 0], part[:, 1] + q - part[:, 0], np.full(len(part), q)], axis=1)
                rows = rows[rows[:, 1] >= max(min_words, min_exponent * q)]
                found.append(rows[~_covered(known, rows[:, 0], rows[:, 0] + rows[:, 1])])
            if found:
                every = np.concatenate(found)
                every = every[np.argsort(every[:, 0], kind="stable")]
                known = every[:, 0], np.maximum.accumulate(every[:, 0] + every[:, 1]) if len(every) else every[:, 0]
        length *= 2
    if not found:
        return np.empty((0, 3), np.int64)
    every = np.concatenate(found)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _tail_sources(doc: int | None, n: int) -> tuple[int, int] | None:
    """(first rewritten word, period) of the texts whose tail ``repeat_tails`` repeats."""
    if doc is None or n == 0:
        return None
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _search(repeat_tails: bool, min_words: int, min_exponent: int):
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            all_data, all_off = text_buffers(batch.column(1))
            out = []
            for first, last in pieces(all_off):
                data = all_data[all_off[first]:all_off[last]]
                off = all_off[first:last + 1] - all_off[first]
                starts, ends, doc_words = split_words(data, off, NOT_WHITESPACE)
                with np.errstate(over="ignore"):
                    ids = hasher(data, starts, ends) + mix(word_docs(doc_words).astype(np.uint64))
                source = np.arange(len(ids))
                if repeat_tails:
                    for i in range(first, last):
                        w0, w1 = doc_words[i - first:i - first + 2].tolist()
                        tail = _tail_sources(docs[i], w1 - w0)
                        if tail:
                            a, p = w0 + tail[0], tail[1]
                            source[a:w1] = a + np.arange(w1 - a) % p
                    ids = ids[source]
                longest = int(np.diff(doc_words).max(initial=0))
                runs = find_runs(ids, longest, min_words=min_words, min_exponent=min_exponent)
                change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(change[:-1]) == 0
                run_docs = np.searchsorted(runs[:, 0], doc_words)
                raw = data.tobytes()
                for i in range(first, last):
                    w0, w1 = doc_words[i - first:i - first + 2]
                    mine = runs[run_docs[i - first]:run_docs[i - first + 1]] - [w0, 0, 0]
                    text = "".join(f"{s},{k},{q}\n" for s, k, q in mine.tolist())
                    use = source[w0:w1][kept[w0:w1]]
                    words = b" ".join([raw[s:e] for s, e in zip(starts[use].tolist(), ends[use].tolist())])
                    out.append((docs[i], int(w1 - w0), *mine.T.tolist(),
                                hashlib.sha256(text.encode()).hexdigest(), words.decode("utf-8")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], kind) for c, kind in enumerate(
                    [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.string(), pa.string()])],
                names=["doc_id", "n_words", "starts", "lengths", "periods", "runs_sha256", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, repeat_tails: bool = False, min_words: int = MIN_WORDS,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Per row: doc_id, n_words, the runs as three arrays (by start, then
    period), their digest and the text without repetitions (a word goes if any
    run holds it after the run's first period). ``repeat_tails`` first rewrites
    the end of about every tenth text as a repetition (a planted test)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(src, _search(repeat_tails, min_words, min_exponent), SCHEMA)


def longest_run(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length (ties: smallest start, then
    period) with its exponent in thousandths, and the digests."""
    every = F.arrays_zip("starts", "lengths", "periods")
    best = F.reduce(F.slice(every, F.lit(2), F.greatest(F.size("starts"), F.lit(1))), F.get(every, F.lit(0)),
                    lambda a, b: F.when(b["lengths"] > a["lengths"], b).otherwise(a))
    return found.withColumn("best", best).select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), F.col("best.starts").alias("start"),
        F.col("best.lengths").alias("length"), F.col("best.periods").alias("period"),
        F.expr("(1000 * best.lengths) div best.periods").alias("exponent_milli"),
        "runs_sha256", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
