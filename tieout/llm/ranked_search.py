"""Ranked lexical search: MaxScore with pair bounds over shards of documents.

Scores are integers. A term's weight is floor(1000 ln((2N+2)/(2df+1))); its
impact in a document is weight * ((10**9 tf) div (1000 tf + 20 m)), where m is
50 + ((50 n N) div L); a document's score is the sum of its impacts.

Items are handled in blocks of bounded size (``BLOCK_BYTES``); the texts of one
block are all that the driver holds. Per block the documents are read twice:

1. Statistics: every task counts documents and terms, and in how many of its
   documents each term of the block stands; one aggregation adds them up.
2. Search: every task collects documents into shards of about ``SHARD_TERMS``
   terms. A shard's index holds, per term of the block, the documents and their
   impacts, and the term's maximum. For terms that are neighbours in an item
   (in falling order of their maxima) it holds the intersection of their lists
   with the joint impacts. A document adds for a pair at most max(joint maximum,
   maximum of either term), often far below the sum of the two maxima.
   A query adds up the impacts of its terms in falling order of their maxima.
   The bound of the terms still to come is the least combination of single
   maxima and pair bounds. Once it cannot reach the score of the k-th best
   document so far, only documents that can still reach it are looked up in the
   remaining lists, and dropped as soon as they cannot. Documents are skipped
   only if their bound is below that score, so ties are all kept and the result
   is exact.

Every shard gives at most k documents an item; these are cut to k per group of
partitions, then per item, so no task meets more than k rows a group.

Terms are compared by 64-bit hashes of their lower-cased UTF-8.

Defined results: null and empty texts have no terms, are not counted in N and
match nothing; an item without terms gives no rows; every input row is a
document of its own (repeated rows rank next to each other), ties by doc_id
with null last; repeated items give repeated rows; extra columns are ignored;
an empty table of either kind gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map
from .kernels import ALNUM, LOWER, WordHasher, pieces, split_words, text_buffers, word_docs

TOP = 50
SHARD_TERMS = 1 << 21
BLOCK_BYTES = 8 << 20
#: Partitions whose best documents are cut to k before they meet.
GROUP = 64

HITS = "q int, doc_id long, score long, piece int"


def _terms(hasher: WordHasher, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of a piece and the offsets of its texts."""
    data = LOWER[data]
    starts, ends, doc_words = split_words(data, off, ALNUM)
    return hasher(data, starts, ends), doc_words


def _find(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``h`` of the vocabulary's terms, and the terms' numbers."""
    if len(vocabulary) == 0 or len(h) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.zeros(1 << 16, bool)  # most words are no query terms: a bitmap of 16 bits goes first
    low[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(low[(h & np.uint64(0xFFFF)).astype(np.int64)])
    no = np.searchsorted(vocabulary, h[at])
    good = vocabulary[np.minimum(no, len(vocabulary) - 1)] == h[at]
    return at[good], no[good]


def _postings(terms: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, document) by term, then document, with their counts."""
    key, tf = np.unique(terms * n_docs + docs, return_counts=True)
    return key // max(n_docs, 1), key % max(n_docs, 1), tf.astype(np.int64)


def _count(vocabulary: np.ndarray):
    """Rows (term number, documents with it); number -1: documents with terms, -2: all terms."""
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            all_data, all_off = text_buffers(batch.column(0))
            df = np.zeros(len(vocabulary), np.int64)
            n_docs = n_terms = 0
            for first, last in pieces(all_off):
                h, doc_words = _terms(hasher, all_data[all_off[first]:all_off[last]],
                                      all_off[first:last + 1] - all_off[first])
                n_docs += int((np.diff(doc_words) > 0).sum())
                n_terms += len(h)
                at, no = _find(vocabulary, h)
                terms, _, _ = _postings(no, word_docs(doc_words)[at], last - first)
                df += np.bincount(terms, minlength=len(vocabulary))
            seen = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([seen, [-1, -2]]), pa.int64()),
                 pa.array(np.concatenate([df[seen], [n_docs, n_terms]]), pa.int64())], names=["term", "n"])

    return run


class Shard:
    """Index of a bounded set of documents: lists of the block's terms and of
    term pairs, with impacts and maxima."""

    def __init__(self, n_docs: int, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.n_docs = n_docs
        self.docs, self.impacts = docs, impacts
        self.at = np.searchsorted(terms, np.arange(n_terms + 1))
        self.top = np.zeros(n_terms, np.int64)
        np.maximum.at(self.top, terms, impacts)
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.docs[self.at[t]:self.at[t + 1]], self.impacts[self.at[t]:self.at[t + 1]]

    def add_pair(self, a: int, b: int) -> None:
        """Intersection list with joint impacts, and the bound of the pair."""
        if (a, b) not in self.pairs:
            (da, ia), (db, ib) = self.postings(a), self.postings(b)
            if len(da) > len(db):
                da, ia, db, ib = db, ib, da, ia
            k = np.minimum(np.searchsorted(db, da), len(db) - 1)
            both = db[k] == da
            joint = ia[both] + ib[k[both]]
            bound = max(int(self.top[a]), int(self.top[b]), int(joint.max(initial=0)))
            self.pairs[a, b] = da[both], joint, bound

    def chain(self, terms: np.ndarray) -> list[int]:
        """The item's terms that stand in the shard, in falling order of their
        maximum; the index keeps the lists of neighbouring terms."""
        return sorted((int(t) for t in terms if self.top[t] > 0), key=lambda t: (-self.top[t], t))

    def bounds(self, chain: list[int]) -> list[int]:
        """For each i the least bound on what the terms from the i-th on add
        together: every term stands alone or in a pair with its neighbour."""
        rest = [0] * (len(chain) + 2)
        for i in range(len(chain) - 1, -1, -1):
            rest[i] = int(self.top[chain[i]]) + rest[i + 1]
            pair = self.pairs.get(tuple(chain[i:i + 2]))
            if pair:
                rest[i] = min(rest[i], pair[2] + rest[i + 2])
        return rest[:len(chain) + 1]

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents (ties of the last score all kept), their scores,
        and how many list entries were read."""
        chain = self.chain(terms)
        rest = self.bounds(chain)
        score = np.zeros(self.n_docs, np.int64)
        live = None  # None: any document may still come in
        least, read = 1, 0
        for i, t in enumerate(chain):
            docs, impacts = self.postings(t)
            if live is None:
                score[docs] += impacts
                read += len(docs)
            else:
                at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
                hit = docs[at] == live
                score[live[hit]] += impacts[at[hit]]
                read += len(live)
            part = score if live is None else score[live]
            if len(part) > k:
                least = max(least, int(np.partition(part, len(part) - k)[len(part) - k]))
            if live is not None:
                live = live[score[live] + rest[i + 1] >= least]
            elif rest[i + 1] < least:
                live = np.flatnonzero(score >= max(least - rest[i + 1], 1))
        live = np.flatnonzero(score) if live is None else live
        live = live[score[live] >= least]
        return live, score[live], read


def _cut(docs: np.ndarray, missing: np.ndarray, found: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by doc_id with null last."""
    return np.lexsort((docs[found], missing[found], -scores))[:k]


def _search(vocabulary: np.ndarray, weights: np.ndarray, n: int, length: int, queries: list[np.ndarray],
            k: int, shard_terms: int):
    def answer(ids, missing, sizes, terms, docs):
        sizes = np.concatenate(sizes)
        m = np.array([50 + (50 * s * n) // max(length, 1) for s in sizes.tolist()], np.int64)  # Python integers: no overflow
        t, d, tf = _postings(np.concatenate(terms), np.concatenate(docs), len(sizes))
        shard = Shard(len(sizes), t, d, weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[d])), len(vocabulary))
        ids, missing = np.concatenate(ids), np.concatenate(missing)
        for q in queries:
            chain = shard.chain(q)
            for a, b in zip(chain, chain[1:]):
                shard.add_pair(a, b)
        cols = ([], [], [])
        for no, q in enumerate(queries):
            found, scores, _ = shard.search(q, k)
            best = _cut(ids, missing, found, scores, k)
            cols[0].append(np.full(len(best), no))
            cols[1].append(found[best])
            cols[2].append(scores[best])
        no, found, scores = (np.concatenate(c) for c in cols)
        return pa.RecordBatch.from_arrays(
            [pa.array(no, pa.int32()), pa.array(ids[found], pa.int64(), mask=missing[found]),
             pa.array(scores, pa.int64())], names=["q", "doc_id", "score"])

    def run(batches):
        hasher, held, n_docs, n_terms = WordHasher(), ([], [], [], [], []), 0, 0
        for batch in batches:
            column = batch.column(0)
            empty = np.array(column.is_null())
            ids = np.array(column.fill_null(0))
            all_data, all_off = text_buffers(batch.column(1))
            for first, last in pieces(all_off):
                h, doc_words = _terms(hasher, all_data[all_off[first]:all_off[last]],
                                      all_off[first:last + 1] - all_off[first])
                at, no = _find(vocabulary, h)
                for part, new in zip(held, (ids[first:last], empty[first:last], np.diff(doc_words), no,
                                            word_docs(doc_words)[at] + n_docs)):
                    part.append(new)
                n_docs, n_terms = n_docs + last - first, n_terms + len(h) + last - first
                if n_terms >= shard_terms:
                    yield answer(*held)
                    held, n_docs, n_terms = ([], [], [], [], []), 0, 0
        if n_docs:
            yield answer(*held)

    return run


def _weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def ranked_search(docs: DataFrame, items: DataFrame, *, top: int = TOP, shard_terms: int = SHARD_TERMS,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's ``top`` best documents."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # equal texts are one query; an item's key is its text's digest
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    asked = asked.select("item_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    texts = asked.groupBy("key").agg(F.first("text").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    out = None
    for no in range(blocks):
        block = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == no).orderBy("key").collect()
        if not block:  # no key has fallen into it
            continue
        hits = _block(src, [r["key"] for r in block], [r["text"] for r in block], top, shard_terms)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return asked.select("item_id", "key").join(out, "key").select("item_id", "rank", "doc_id", "score")


def _block(src: DataFrame, keys: list[str], texts: list[str], top: int, shard_terms: int) -> DataFrame:
    spark = src.sparkSession
    data, off = text_buffers(pa.array(texts, pa.string()))
    h, doc_words = _terms(WordHasher(), data, off)
    vocabulary = np.unique(h)
    queries = [np.searchsorted(vocabulary, np.unique(h[a:b])) for a, b in zip(doc_words[:-1], doc_words[1:])]
    counts = dict(arrow_map(src.select("text"), _count(vocabulary), "term long, n long")
                  .groupBy("term").agg(F.sum("n").alias("n")).collect())
    n, length = counts.get(-1, 0), counts.get(-2, 0)
    weights = _weights(n, np.array([counts.get(t, 0) for t in range(len(vocabulary))], np.int64))
    hits = arrow_map(src, _search(vocabulary, weights, n, length, queries, top, shard_terms),
                     "q int, doc_id long, score long")
    hits = hits.withColumn("piece", F.floor(F.spark_partition_id() / GROUP))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["q", "piece"], ["q"]):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(
            F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(keys)), "q int, key string")
    return hits.join(F.broadcast(names), "q").select("key", "rank", "doc_id", "score")
