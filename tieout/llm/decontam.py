"""Benchmark decontamination by latent semantic retrieval (operator 7).

1. Word statistics: passages of ``window`` words of all documents give document
   frequencies in ``2 ** df_bits`` hashed buckets (one distributed aggregate).
2. Latent space: the TF-IDF matrix of the benchmark's passages goes through a
   distributed randomised SVD: partitions multiply their rows with a test matrix and
   back, partial products are summed by feature in Spark, and the driver only
   orthonormalises the ``2 ** feature_bits`` x rank result. A direction outside the
   benchmark's row space has no product with any benchmark passage, so documents are
   folded into this space; their own passages need not be decomposed.
3. Candidate search: overlapping windows of every document are folded in and compared by
   cosine with the benchmark's passages, block of the benchmark by block. Every window is
   folded in. Items much shorter than a window have windows (and strides) of a half or a
   quarter of its size of their own, so that other words do not outweigh theirs.
4. Verification: the longest common subsequence of words between the item and each place of
   the region around its windows. A place is a window of twice the item's words and ``GAP``,
   or a match in the region whose gaps are at most ``GAP`` words; each counts on its own.
   ``verbatim`` of the item's words is a leak; from ``paraphrase`` on it is one if the item's
   answer (its last sentence) is found to at least ``answer`` as well.
5. Verbatim runs: ``run`` words of the item (all of a shorter one) in place, with at most one
   word changed, added or left out between two of them and ``SEED`` in a row somewhere (half
   of a shorter item), are a leak whatever their share. The seeds are looked up by hash in
   every document, so a run does not depend on the cosine (0 if no window came near).

Words are runs of ASCII letters and digits and non-ASCII code points, A-Z lower-cased.

Defined results: null texts and texts without words match nothing; items without words are
skipped; repeated rows give their own rows; repeated items match each; null ids are ordinary
values; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written
from .kernels import ALNUM, LOWER, WordHasher, kgrams, mix, pieces, split_words, text_buffers, word_docs

WINDOW, STRIDE = 24, 8
DF_BITS, FEATURE_BITS, RANK, ROUNDS = 16, 14, 256, 2
MIN_COSINE = 0.5
#: Stretches of the widest stride folded in at once: their rows stay in the cache.
CHUNK = 256
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.5, 0.5
GAP = 12
RUN, SEED = 13, 5
BLOCK_BYTES = 8 << 20


def _windows(doc_words: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of the windows of every text with words. They start at multiples
    of the stride; the last one ends with the text and may be shorter."""
    n = np.diff(doc_words)
    count = np.where(n > 0, np.maximum(-(-(n - size) // stride), 0) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = doc_words[doc] + k * stride
    return doc, first, np.minimum(first + size, doc_words[doc + 1])


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _feature(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _words(data, off, hasher):
    data = LOWER[data]
    starts, ends, doc_words = split_words(data, off, ALNUM)
    return hasher(data, starts, ends), doc_words


def _frequencies(window: int, bits: int):
    """(bucket, passages that hold it); bucket -1 counts the passages."""
    def run(batches):
        hasher, counts, total = WordHasher(), np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            for a, b in pieces(off):
                h, doc_words = _words(data[off[a]:off[b]], off[a:b + 1] - off[a], hasher)
                docs = word_docs(doc_words)
                inside = (np.arange(len(h)) - doc_words[docs]) // window
                most = int(inside.max(initial=0)) + 1
                cell = (docs * most + inside) << bits | _bucket(h, bits)
                new = np.ones(len(cell), bool)  # a bucket counts once a passage: no equal one among the words before it
                for back in range(1, min(window, len(cell))):
                    new[back:] &= cell[back:] != cell[:-back]
                counts += np.bincount(cell[new] & ((1 << bits) - 1), minlength=1 << bits)
                total += int(np.sum(-(-np.diff(doc_words) // window)))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], total))],
                                         names=["bucket", "n"])
    return run


def idf_table(docs: DataFrame, window: int = WINDOW, bits: int = DF_BITS) -> np.ndarray:
    """Weight of each bucket from all passages of all documents (2 ** bits numbers)."""
    rows = arrow_map(docs.select(F.col("text").cast("string")), _frequencies(window, bits), "bucket long, n long")
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts, total = np.zeros(1 << bits), 0
    for b, n in zip(got["bucket"].to_pylist(), got["n"].to_pylist()):
        if b < 0:
            total = n
        else:
            counts[b] = n
    return np.log((1 + total) / (1 + counts)) + 0.1


def _passages(h: np.ndarray, window: int) -> list[tuple[int, int]]:
    _, first, end = _windows(np.array([0, len(h)]), window, window // 2)
    return list(zip(first.tolist(), end.tolist()))


def _row(h: np.ndarray, idf: np.ndarray, bits: int, df_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse TF-IDF row of unit length."""
    f, at = np.unique(_feature(h, bits), return_inverse=True)
    w = np.bincount(at, weights=idf[_bucket(h, df_bits)])
    return f, w / np.linalg.norm(w)


def _product(basis: np.ndarray, idf: np.ndarray, window: int, bits: int, df_bits: int):
    """Partial A^T (A basis): one row per feature that this partition holds."""
    def run(batches):
        hasher, sums = WordHasher(), {}
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            h, doc_words = _words(data, off, hasher)
            for a, b in zip(doc_words[:-1], doc_words[1:]):
                for lo, hi in _passages(h[a:b], window):
                    f, w = _row(h[a:b][lo:hi], idf, bits, df_bits)
                    y = w @ basis[f]
                    for i, x in zip(f.tolist(), w.tolist()):
                        sums[i] = sums.get(i, 0) + x * y
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["feature", "v"])
    return run


def _sum_rows(table: pa.Table) -> pa.Table:
    v = table["v"].combine_chunks()
    total = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).sum(axis=0)
    return pa.table({"feature": table["feature"][:1], "v": pa.array([total.tolist()], pa.list_(pa.float64()))})


def latent_space(benchmark: DataFrame, idf: np.ndarray, *, window: int = WINDOW, rank: int = RANK,
                 bits: int = FEATURE_BITS, df_bits: int = DF_BITS, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Right singular vectors (features x at most rank) of the benchmark's passages."""
    texts = benchmark.select(F.col("text").cast("string").alias("text"))
    rng, basis = np.random.default_rng(seed), np.empty((1 << bits, rank), np.float32)
    for rows in np.array_split(basis, 16):  # the same numbers as in one draw of doubles, without holding these
        rows[:] = rng.normal(size=rows.shape)
    for turn in range(rounds):
        parts = arrow_map(texts, _product(basis, idf, window, bits, df_bits), "feature long, v array<double>")
        got = parts.groupBy("feature").applyInArrow(_sum_rows, "feature long, v array<double>").toArrow()
        if got.num_rows == 0:
            return np.zeros((1 << bits, 0), np.float32)
        basis = _orthonormal(got["feature"].to_numpy(), got["v"].combine_chunks().flatten().to_numpy(), 1 << bits)
    return basis


def _orthonormal(features: np.ndarray, values: np.ndarray, n_features: int) -> np.ndarray:
    """Left singular vectors of the features' rows. A feature without a row has zeros in all of them,
    so the driver decomposes the rows alone."""
    order = np.argsort(features)
    u, s, _ = np.linalg.svd(values.reshape(len(features), -1)[order], full_matrices=False)
    u = u[:, s > 1e-6 * s[0]]
    basis = np.zeros((n_features, u.shape[1]), np.float32)
    basis[features[order]] = u
    return basis


class Item:
    """A benchmark row: words, answer range, and its passages in the latent space."""

    def __init__(self, item_id, h: np.ndarray, answer: int):
        self.id, self.h, self.answer = item_id, h, answer
        self.known, self.counts = np.unique(h, return_counts=True)
        self.masks: dict = {}
        for i, w in enumerate(h.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << i


def prepare_items(rows: list, hasher: WordHasher) -> list[Item]:
    out = []
    for item_id, text in rows:
        data, off = text_buffers(pa.array([text], pa.string()))
        h, _ = _words(data, off, hasher)
        if len(h) == 0:
            continue
        # the answer: the last sentence of three words or more, else the last quarter
        starts, _, _ = split_words(LOWER[data], off, ALNUM)
        stops = np.flatnonzero(np.isin(data, list(b".!?\n")))
        cuts = np.searchsorted(starts, stops)
        cuts = cuts[(cuts > 0) & (cuts <= len(h) - 3)]
        out.append(Item(item_id, h, int(cuts[-1]) if len(cuts) else len(h) - max(1, len(h) // 4)))
    return out


def lcs_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of one longest common subsequence."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a):
        prev = table[i]
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(prev[1:], prev[:-1] + (b == x)))
    # from the first end: what comes again after a whole match does not draw its tail away
    i, j, at = len(a), int(np.argmax(table[-1])), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            at.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    at = np.array(at[::-1], np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def lcs_length(masks: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence with an item of n words (its places by word, as bits)."""
    full = left = (1 << n) - 1
    for w in words:
        hit = left & masks.get(w, 0)
        if hit:
            left = ((left + hit) | (left - hit)) & full
    return n - left.bit_count()


def overlap(item: Item, kinds: np.ndarray) -> int:
    """Words that the item and a stretch share, repeats counted; ``kinds`` numbers the stretch's words in the item."""
    return int(np.minimum(np.bincount(kinds, minlength=len(item.counts)), item.counts).sum())


def places(item: Item, words: np.ndarray, lo: int, hi: int, least: float):
    """(places in the item, places in the text) of the matches of ``least`` words or more inside words[lo:hi]."""
    n = len(item.h)
    place = np.minimum(item.known.searchsorted(words[lo:hi]), len(item.known) - 1)
    held = lo + np.flatnonzero(item.known[place] == words[lo:hi])
    # the common subsequence holds a word no more often than either side: an exact bound before any search
    kinds = place[held - lo]
    if len(held) < least or overlap(item, kinds) < least:
        return
    span, step = 2 * n + GAP, max(1, n // 2)
    seen = set()
    for first in range(int(held[0]), max(int(held[-1]) + 1 - span, int(held[0])) + step, step):
        a, b = held.searchsorted((first, first + span)).tolist()
        if b - a < least or (a, b) in seen:
            continue
        seen.add((a, b))
        at = held[a:b]
        if overlap(item, kinds[a:b]) >= least and lcs_length(item.masks, n, words[at].tolist()) >= least:
            mine, theirs = lcs_places(item.h, words[at])
            yield mine, at[theirs]
    if held[-1] - held[0] >= span and lcs_length(item.masks, n, words[held].tolist()) >= least:
        mine, theirs = lcs_places(item.h, words[held])
        part = np.cumsum(np.concatenate([[0], np.diff(held[theirs]) > GAP]))
        for k in np.flatnonzero(np.bincount(part) >= least):
            yield mine[part == k], held[theirs[part == k]]


def verify(item: Item, words: np.ndarray, lo: int, hi: int, verbatim: float = VERBATIM,
           paraphrase: float = PARAPHRASE, answer: float = ANSWER) -> tuple[bool, float, float, int, int]:
    """(leak, share of the item's words in order, share of its answer's, first, last word) of the best
    place inside words[lo:hi]: a leak before none, then the larger share."""
    best, n = (False, 0.0, 0.0, lo, lo), len(item.h)
    for mine, theirs in places(item, words, lo, hi, min(verbatim, paraphrase) * n):
        share, found = len(mine) / n, float(np.sum(mine >= item.answer) / (n - item.answer))
        leak = share >= verbatim or (share >= paraphrase and found >= answer)
        best = max(best, (leak, share, found, int(theirs[0]), int(theirs[-1])), key=lambda x: x[:3])
        if best[1:3] == (1.0, 1.0):
            break
    return best


def longest_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(words, first, last word) of the longest run of item words in place in ``words`` with at most one
    word changed, added or left out between two of them."""
    length, start = np.zeros((2, 3, len(words) + 2), np.int64)  # of runs that end here: this row, one, two before
    best = (0, 0, 0)
    here = np.arange(len(words))
    for w in item:
        length[1:], start[1:] = length[:-1].copy(), start[:-1].copy()
        ends = np.stack([length[1, 1:-1], length[1, :-2], length[2, 1:-1], length[2, :-2]])
        of = np.argmax(ends, axis=0)
        most = ends[of, here]
        began = np.stack([start[1, 1:-1], start[1, :-2], start[2, 1:-1], start[2, :-2]])[of, here]
        same = words == w
        length[0, 2:] = np.where(same, most + 1, 0)
        start[0, 2:] = np.where(most > 0, began, here)
        at = int(np.argmax(length[0, 2:])) if len(words) else 0
        if len(words) and length[0, 2 + at] > best[0]:
            best = (int(length[0, 2 + at]), int(start[0, 2 + at]), at)
    return best


class Search:
    """The kernel of the candidate search and its verification for a block of items."""

    def __init__(self, rows, basis, idf, *, window=WINDOW, stride=STRIDE, bits=FEATURE_BITS, df_bits=DF_BITS,
                 min_cosine=MIN_COSINE, verbatim=VERBATIM, paraphrase=PARAPHRASE, answer=ANSWER, run=RUN):
        if window % stride:
            raise ValueError("the window must be a multiple of the stride")
        self.window, self.stride, self.bits, self.df_bits = window, stride, bits, df_bits
        self.min_cosine = min_cosine
        self.verbatim, self.paraphrase, self.answer = verbatim, paraphrase, answer
        self.run = run
        self.idf = idf
        self.items = prepare_items(rows, WordHasher())
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *(i.h for i in self.items)]))
        self.ends = np.zeros(1 << 16, bool)  # last bits of the items' words: most other words end there
        self.ends[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.lengths = np.array([len(i.h) for i in self.items], np.int64)
        # the items' words as one sorted list of (item, word), with their counts
        self.pairs = np.concatenate([np.empty(0, np.int64), *(
            k * len(self.vocabulary) + np.searchsorted(self.vocabulary, i.known) for k, i in enumerate(self.items))])
        self.pair_counts = np.concatenate([np.empty(0, np.int64), *(i.counts for i in self.items)])
        self.basis = np.ascontiguousarray(basis, np.float32)  # row by row, as it is read
        # items of at most three quarters of a window use one of half the size
        sizes = [(window, stride)]
        while len(sizes) < 3 and sizes[-1][1] % 2 == 0:
            sizes.append((sizes[-1][0] // 2, sizes[-1][1] // 2))
        of_size: list = [([], []) for _ in sizes]
        for k, item in enumerate(self.items):
            size = sum(4 * len(item.h) <= 3 * wider for wider, _ in sizes[:-1])
            for lo, hi in _passages(item.h, sizes[size][0]):
                f, w = _row(item.h[lo:hi], idf, bits, df_bits)
                z = w @ basis[f]
                of_size[size][0].append(z / max(np.linalg.norm(z), 1e-9))
                of_size[size][1].append(k)
        # seeds: (words, sorted hashes, their items)
        seeds: dict = {}
        for k, item in enumerate(self.items):
            size = min(SEED, -(-len(item.h) // 2), run)
            grams, of = seeds.setdefault(size, ([], []))
            grams.append(np.unique(kgrams(item.h, np.zeros(len(item.h), np.int64), size)[0]))
            of.append(np.full(len(grams[-1]), k))
        self.seeds = []
        for size, (grams, of) in seeds.items():
            grams, of = np.concatenate(grams), np.concatenate(of)
            order = np.argsort(grams, kind="stable")
            self.seeds.append((size, grams[order], of[order]))
        #: (window, stride, vectors of the passages, their items)
        self.groups = [(*size, np.array(vectors, np.float32).reshape(len(of), basis.shape[1]), np.array(of, np.int64))
                       for size, (vectors, of) in zip(sizes, of_size) if of]

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text of the items' words, and their numbers."""
        if len(h) == 0 or len(self.vocabulary) == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        some = np.flatnonzero(self.ends[(h & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
        good = self.vocabulary[place] == h[some]
        return some[good], place[good]

    def candidates(self, h: np.ndarray, doc_words: np.ndarray, some: np.ndarray):
        """Arrays (text, first, end, item, cosine) of every window that comes near
        a passage; ``some`` are the places of the items' words."""
        none = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.float32)]
        if len(some) == 0:
            return none
        # Windows overlap, and those of the smaller sizes start at parts of a stride: every stretch of the finest
        # stride is folded in once, from its words of some weight, and stretches are added up for all windows. A
        # text starts at a multiple of the widest stride; empty stretches after it stand for what its last window lacks.
        finest, widest = min(g[1] for g in self.groups), max(g[1] for g in self.groups)
        pad = max(g[0] for g in self.groups) // widest
        n_words = np.diff(doc_words)
        base = np.concatenate([[0], np.cumsum(-(-n_words // widest) + pad)])
        slot = some + np.repeat(base[:-1] * widest - doc_words[:-1], n_words)[some]
        stretch, feature = slot // finest, _feature(h[some], self.bits)
        weight = self.idf[_bucket(h[some], self.df_bits)].astype(np.float32)
        edge = np.flatnonzero(np.diff(stretch, prepend=-1))
        nth = np.arange(len(stretch)) - np.repeat(edge, np.diff(np.append(edge, len(stretch))))  # word of its stretch
        windows = []
        for size, step, passages, of in self.groups:
            doc, first, end = _windows(doc_words, size, step)
            windows.append((step, size // step, passages, of, doc, first, end,
                            base[doc] * (widest // step) + (first - doc_words[doc]) // step))
        out = []
        for lo in range(0, int(base[-1]), CHUNK):
            hi = min(lo + CHUNK, int(base[-1]))
            last = min(hi + pad, int(base[-1]))
            fine = np.zeros(((last - lo) * (widest // finest), self.basis.shape[1]), np.float32)
            a, b = np.searchsorted(stretch, [lo * (widest // finest), last * (widest // finest)])
            for j in range(finest):
                k = a + np.flatnonzero(nth[a:b] == j)
                row = self.basis[feature[k]]
                row *= weight[k, None]
                fine[stretch[k] - lo * (widest // finest)] += row
            for step, per, passages, of, doc, first, end, held in windows:
                x, y = np.searchsorted(held, [lo * (widest // step), hi * (widest // step)])
                if x < y:
                    part = fine
                    for _ in range((step // finest).bit_length() - 1):  # steps are powers of two apart
                        part = part[0::2] + part[1::2]
                    whole = part[:len(part) - per + 1].copy()
                    for j in range(1, per):
                        whole += part[j:len(part) - per + 1 + j]
                    out.append(self._near(whole[held[x:y] - lo * (widest // step)], passages, of,
                                          doc[x:y], first[x:y], end[x:y]))
        return [np.concatenate(c) for c in zip(*out)] if out else none

    def _near(self, z, passages, of, doc, first, end):
        """The windows, by their vectors, that come near a passage."""
        out = []
        z /= np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-9)[:, None]
        for p in range(0, len(of), 4096):
            cos = z @ passages[p:p + 4096].T
            a, b = np.divmod(np.flatnonzero(cos >= self.min_cosine), cos.shape[1])
            out.append((doc[a], first[a], end[a], of[p + b], cos[a, b]))
        return [np.concatenate(c) for c in zip(*out)]

    def overlaps(self, some: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Words that item k[i] and the text's words lo[i]:hi[i] share, repeats
        counted, for all regions at once; ``some`` and ``place`` from ``known``."""
        out = np.zeros(len(lo), np.int64)
        if len(lo) == 0 or len(some) == 0:
            return out
        first, stop = np.searchsorted(some, lo), np.searchsorted(some, hi)
        for a in range(0, len(lo), 4096):
            n = (stop - first)[a:a + 4096]
            of = np.repeat(np.arange(a, a + len(n)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:a + 4096], n)
            want = k[of] * len(self.vocabulary) + place[at]
            pair = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
            hit = self.pairs[pair] == want
            key, count = np.unique(of[hit] * len(self.pairs) + pair[hit], return_counts=True)
            region, pair = np.divmod(key, len(self.pairs))
            out += np.bincount(region, np.minimum(count, self.pair_counts[pair]), len(out)).astype(np.int64)
        return out

    def seeded(self, h: np.ndarray, doc_words: np.ndarray):
        """(text, first, end, item) of every seed of an item in a text."""
        docs, out = word_docs(doc_words), []
        for size, grams, of in self.seeds:
            g, at = kgrams(h, docs, size)
            hit = np.flatnonzero(grams[np.minimum(np.searchsorted(grams, g), len(grams) - 1)] == g)
            g, at = g[hit], at[hit]
            first = np.searchsorted(grams, g)
            count = np.searchsorted(grams, g, side="right") - first
            k = of[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
            at = np.repeat(at, count)
            out += zip(docs[at].tolist(), at.tolist(), (at + size).tolist(), k.tolist())
        return out

    def longest(self, item: Item, h: np.ndarray, lo: int, hi: int, spots: list) -> tuple[int, int, int]:
        """The longest run inside h[lo:hi] that holds one of the spots."""
        least, reach, best, done = min(self.run, len(item.h)), 2 * len(item.h), (0, lo, lo), lo
        for first, end in spots:
            if first < done:  # inside the stretch that was looked at last
                continue
            # a run spans at most twice the item's words
            a, b = max(lo, first - reach), min(hi, end + 2 * reach)
            done = b - reach
            if np.isin(h[a:b], item.known).sum() >= least:
                size, x, y = longest_run(item.h, h[a:b])
                best = max(best, (size, a + x, a + y), key=lambda r: r[0])
        return best

    def leaks(self, h: np.ndarray, doc_words: np.ndarray) -> list[tuple]:
        """(text, item, cosine, share, answer share, first, last word of the text) of every verified leak."""
        known, place = self.known(h)
        doc, first, end, k, cos = self.candidates(h, doc_words, known)
        order = np.lexsort((first, k, doc))
        doc, first, end, k, cos = (c[order] for c in (doc, first, end, k, cos))
        reach = self.lengths[k]
        # windows within reach of each other make one region; those of one item have one size, so their ends rise as well
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (k[1:] != k[:-1]) | (first[1:] - reach[1:] > end[:-1] + reach[1:])
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(new))[:len(at)] - 1
        doc, k, reach = doc[at], k[at], reach[at]
        first, end = np.maximum(doc_words[doc], first[at] - reach), np.minimum(doc_words[doc + 1], end[stop] + reach)
        cos = np.maximum.reduceat(cos, at) if len(at) else cos
        nearest: dict = {}
        for d, i, c in zip(doc.tolist(), k.tolist(), cos.tolist()):
            nearest[d, i] = max(c, nearest.get((d, i), 0.0))
        # a region that shares too few words with the item cannot hold them in order: an exact bound, all regions at once
        enough = self.overlaps(known, place, first, end, k) >= min(self.verbatim, self.paraphrase) * self.lengths[k]
        near_by: dict = {}
        for d, i, x, y, c in zip(*(v[enough].tolist() for v in (doc, k, first, end, cos))):
            near_by.setdefault((d, i), []).append((x, y, c))
        spots: dict = {}
        for doc, first, end, k in sorted(self.seeded(h, doc_words)):
            spots.setdefault((doc, k), []).append((first, end))
        found = []
        for doc, k in dict.fromkeys([*near_by, *spots]):
            item, reach = self.items[k], len(self.items[k].h)
            lo, hi = int(doc_words[doc]), int(doc_words[doc + 1])
            best = (False, 0.0, 0.0, 0, 0)
            for first, end, cos in near_by.get((doc, k), []):
                got = verify(item, h, first, end, self.verbatim, self.paraphrase, self.answer)
                if got[:3] > best[:3]:
                    best, near = got, cos
            run = (0, 0, 0)
            if best[1] < self.verbatim and (doc, k) in spots:
                run = self.longest(item, h, lo, hi, spots[doc, k])
            if run[0] >= min(self.run, reach):
                # judged as a place of its own, also if no window came near
                got = verify(item, h, max(lo, run[1] - reach), min(hi, run[2] + 1 + reach), self.verbatim,
                             self.paraphrase, self.answer)
                if got[:3] > best[:3]:
                    best, near = got, nearest.get((doc, k), 0.0)
                if not best[0]:
                    mine = max(best[1], run[0] / reach)
                    best = (True, mine, best[2], run[1], run[2])
                    near = nearest.get((doc, k), 0.0)
            if best[0]:
                found.append((doc, item.id, near, *best[1:3], best[3] - lo, best[4] - lo))
        return found

    def rows(self):
        def run(batches):
            hasher = WordHasher()
            for batch in batches:
                data, off = text_buffers(batch.column("text"))
                out = []
                for a, b in pieces(off):
                    h, doc_words = _words(data[off[a]:off[b]], off[a:b + 1] - off[a], hasher)
                    out += [(a + x[0], *x[1:]) for x in self.leaks(h, doc_words)]
                at = pa.array([x[0] for x in out], pa.int64())
                types = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at),
                     *(pa.array([x[i + 1] for x in out], t) for i, t in enumerate(types))],
                    names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word", "last_word"])
        return run

    def clean(self):
        """Batches without the rows that leak, all columns."""
        def run(batches):
            hasher = WordHasher()
            for batch in batches:
                data, off = text_buffers(batch.column("text"))
                keep = np.ones(batch.num_rows, bool)
                for a, b in pieces(off):
                    h, doc_words = _words(data[off[a]:off[b]], off[a:b + 1] - off[a], hasher)
                    keep[[a + x[0] for x in self.leaks(h, doc_words)]] = False
                yield batch.filter(pa.array(keep))
        return run


SCHEMA = ("doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long, "
          "last_word long")


def searches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, **options) -> list[Search]:
    """A search for each block of the benchmark; a block's items are bounded by ``block_bytes`` of text."""
    items = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                                     F.col("text").cast("string").alias("text")).where("text IS NOT NULL"), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return []
    blocks = -(-size // block_bytes)
    space = {k: options.pop(k) for k in ("rank", "rounds") if k in options}
    shared = {k: options[k] for k in ("window", "bits", "df_bits") if k in options}
    idf = idf_table(docs, shared.get("window", WINDOW), shared.get("df_bits", DF_BITS))
    basis = latent_space(items, idf, **space, **shared)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return [Search([(r.item_id, r.text) for r in dealt.where(F.col("block") == b).orderBy("item_id", "text").collect()],
                   basis, idf, **options) for b in range(blocks)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per input row and benchmark item that it leaks, with the place of the match in words."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for search in searches(docs, benchmark, **options):
        out = out.unionByName(arrow_map(src, search.rows(), SCHEMA))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no benchmark item."""
    for search in searches(docs, benchmark, **options):
        docs = arrow_map(docs, search.clean(), docs.schema)
    return docs
