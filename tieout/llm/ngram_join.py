"""N-gram Jaccard join (operator 3): MinHash bands, verified on full n-gram sets.

1. Every text becomes the set of its five-word grams (64-bit hashes); texts with
   the same set collapse to one node by a 128-bit digest (partial aggregate, so a
   group of exact copies that holds a third of all rows costs one row per task).
2. Nodes get MinHash signatures; ``choose_bands`` picks bands and rows for the
   target recall at the threshold. Band hashes are shuffled; each bucket links its
   nodes to its smallest node, and connected components of these unverified links
   form candidate groups. No pair inside a bucket is listed.
3. Candidate groups are verified pair by pair inside tasks: a group is dealt into
   blocks of bounded size, every pair of blocks is one unit of work, and a unit
   gives one row per node (its number of links and one verified link towards the
   unit's smallest reachable node). So every two texts that share a band, and all
   others of the group, are compared on their full sets, while rows stay linear
   in the nodes of a block pair.
4. Components of the verified links are the classes.

Defined results: a null text is empty; a text without words has no grams, no
links and a class of its own; one to four words form one gram of all words;
repeated rows and equal gram sets are copies of each other and linked; class_id
is the smallest doc_id of the class (null only if all are null); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, written
from .components import components
from .kernels import NOT_WHITESPACE, WordHasher, kgrams, mix, pieces, split_words, text_buffers, word_docs

N, SIMILARITY, RECALL, MAX_HASHES = 5, 0.8, 0.9995, 160
#: Nodes and grams in a block of a candidate group.
BLOCK_NODES, BLOCK_GRAMS = 1000, 1_000_000


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple:
    """(bands, rows): the most rows per band, so the fewest false candidates, for which
    the bands that reach ``recall`` at ``similarity`` need at most ``max_hashes`` hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = similarity ** rows
        bands = 1 if hit >= recall else int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach the recall with so few hashes")
    return best


def text_grams(data: np.ndarray, off: np.ndarray, n: int, hasher: WordHasher):
    """Gram hashes of all texts of a piece, text after text, and the offsets of the texts."""
    starts, ends, doc_words = split_words(data, off, NOT_WHITESPACE)
    h, docs = hasher(data, starts, ends), word_docs(doc_words)
    g, at = kgrams(h, docs, n)
    of, count = docs[at], np.diff(doc_words)
    for k in range(1, n):  # a shorter text is one gram
        short = np.flatnonzero(count == k)
        if len(short):
            with np.errstate(over="ignore"):
                acc = np.full(len(short), k, np.uint64)
                for j in range(k):
                    acc = mix(acc + h[doc_words[short] + j])
            g, of = np.concatenate([g, acc]), np.concatenate([of, short])
    order = np.argsort(of, kind="stable")
    return g[order], np.searchsorted(of[order], np.arange(len(off)))


def _features(n: int, bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            all_data, all_off = text_buffers(batch.column("text"))
            d1, d2, size, sig = [], [], [], []
            for a, b in pieces(all_off):
                g, at = text_grams(all_data[all_off[a]:all_off[b]], all_off[a:b + 1] - all_off[a], n, hasher)
                for lo, hi in zip(at[:-1], at[1:]):
                    own = np.unique(g[lo:hi])
                    digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8")
                    d1.append(int(digest[0]) if len(own) else None)
                    d2.append(int(digest[1]) if len(own) else None)
                    size.append(len(own))
                full = np.flatnonzero(np.diff(at))
                out = np.zeros((b - a, bands), np.uint64)
                if len(full):
                    x, first = (g >> np.uint64(32)).astype(np.uint32), at[full]
                    with np.errstate(over="ignore"):
                        for band in range(bands):
                            acc = np.full(len(full), band + 1, np.uint64)
                            for k in range(band * rows, (band + 1) * rows):
                                low = np.minimum.reduceat(x * mul[k] + add[k], first)
                                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + low)
                            out[full, band] = acc
                sig.append(out)
            flat = np.concatenate([*sig, np.empty((0, bands), np.uint64)]).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * bands, pa.int32()),
                                             pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(size, pa.int64()), lists], names=["doc_id", "th", "d1", "d2", "n_grams", "bands"])
    return run


def unit_links(sets: list[np.ndarray], left: np.ndarray, copies: np.ndarray, similarity: float):
    """(links, lowest reachable index) of each set, over pairs inside the unit.
    ``left`` tells the block of each set; if both blocks are there only pairs
    across them count, as pairs inside a block belong to that block's own unit."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(code, kind="stable")
    posting = owner[order]
    begin = np.searchsorted(code[order], np.arange(code.max() + 2))
    linked = np.zeros((n, n), bool)
    across = left.any() and not left.all()
    ends = np.cumsum(size)
    for a in range(n):
        own = code[ends[a] - size[a]:ends[a]]
        lo, hi = begin[own], begin[own + 1]
        span = hi - lo
        at = np.repeat(lo - np.cumsum(span) + span, span) + np.arange(span.sum())
        both = np.bincount(posting[at], minlength=n)
        linked[a] = both >= similarity * (size[a] + size - both) - 1e-9
    np.fill_diagonal(linked, False)
    if across:
        linked &= left[:, None] != left[None, :]
    links = linked @ copies
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        low = low[low]
        if (low == label).all():
            return links, label
        label = low


def _verify(n: int, similarity: float):
    """Rows come by unit (group, i, j); a unit's texts are bounded by its two blocks."""
    def unit(rows, hasher):
        nodes = list(rows)
        data, off = text_buffers(pa.array([rows[x][2] for x in nodes], pa.binary()))
        g, at = text_grams(data, off, n, hasher)
        sets = [np.unique(g[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
        order = np.argsort(nodes)
        links, low = unit_links([sets[i] for i in order], np.array([rows[nodes[i]][0] for i in order]),
                                np.array([rows[nodes[i]][1] for i in order]), similarity)
        ids = np.array(nodes)[order]
        return ids, links, ids[low]

    def run(batches):
        hasher, now, rows = WordHasher(), None, {}

        def give(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]).astype(np.int64))
                                               for i in range(3)], names=["node", "links", "low"])
        for batch in batches:
            found = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j"))))
            texts = batch.column("text").cast(pa.binary())
            node, block, copies = (batch.column(c).to_pylist() for c in ("node", "block", "copies"))
            for k, key in enumerate(keys):
                if key != now:
                    if rows:
                        found.append(unit(rows, hasher))
                    now, rows = key, {}
                rows[node[k]] = (block[k] == key[1], copies[k], texts[k].as_py())
            if found:
                yield give(found)
        if rows:
            yield give([unit(rows, hasher)])
    return run


def jaccard_classes(docs: DataFrame, *, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL,
                    max_hashes: int = MAX_HASHES, block_nodes: int = BLOCK_NODES, block_grams: int = BLOCK_GRAMS,
                    seed: int = 3) -> DataFrame:
    """One row per input row: doc_id, th (hash of its text), class_id, n_links, and
    the class's representative row (rep_doc_id, rep_th)."""
    spark = docs.sparkSession
    bands, rows = choose_bands(similarity, recall, max_hashes)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      F.xxhash64("text").alias("th"))
    features = written(arrow_map(src, _features(n, bands, rows, seed),
                                 "doc_id long, th long, d1 long, d2 long, n_grams long, bands array<long>"),
                       "gram-features")
    # a null doc_id comes last among the rows that could stand for a set
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    nodes = written(features.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(
        F.min(first).alias("rep"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"),
        F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "gram-nodes")
    slim = nodes.select("node", "copies", "n_grams", F.col("rep.doc_id").alias("rep_doc_id"),
                        F.col("rep.th").alias("rep_th"))
    # buckets: links to the smallest node of each band hash
    spread = nodes.select("node", F.explode("bands").alias("band"))
    hubs = spread.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    stars = spread.join(hubs, "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    groups = components(stars)
    # units: pairs of blocks of a group
    members = groups.join(slim, "node")
    sizes = members.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n_grams") / block_grams)).alias("blocks"))
    members = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    texts = src.withColumnRenamed("doc_id", "rep_doc").withColumnRenamed("th", "of").join(
        members, F.col("rep_doc").eqNullSafe(F.col("rep_doc_id")) & (F.col("of") == F.col("rep_th")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = texts.select("root", "node", "block", "copies", "text", other.alias("with")).select(
        "root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
        "node", "block", "copies", "text")
    units = units.repartition(partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    verified = written(arrow_map(units, _verify(n, similarity), "node long, links long, low long"), "gram-links")
    classes = components(verified.select(F.col("node").alias("u"), F.col("low").alias("v")))
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    found = slim.join(classes, "node", "left").join(counts, "node", "left").select(
        "node", "copies", "rep_doc_id", "rep_th", F.coalesce("root", "node").alias("root"),
        F.coalesce("links", F.lit(0)).alias("links"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("rep_doc_id").isNull().alias("no_id"),
                                                    "rep_doc_id", "rep_th")).alias("rep"))
    found = found.join(best, "root").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"),
                                            F.col("rep.rep_doc_id").alias("rep_doc_id"),
                                            F.col("rep.rep_th").alias("rep_th"))
    keyed = nodes.select("node", "d1", "d2").join(found, "node").drop("node")
    out = features.select("doc_id", "th", "d1", "d2").join(keyed, ["d1", "d2"], "left")
    alone = F.col("n_links").isNull()
    return out.select("doc_id", "th", F.when(alone, F.col("doc_id")).otherwise(F.col("rep_doc_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("rep_doc_id")).alias("rep_doc_id"),
                      F.when(alone, F.col("th")).otherwise(F.col("rep_th")).alias("rep_th"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without all but one row of each class: the row of the smallest
    doc_id (then text hash) stays. Rows without words all stay."""
    classes = jaccard_classes(docs, **options)
    a, b, th, n = _free_names(docs.columns, 4)
    at = (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull())
    gone = classes.where(~(F.col("doc_id").eqNullSafe(F.col("rep_doc_id")) & (F.col("th") == F.col("rep_th"))))
    gone = gone.select(at[0].alias(a), at[1].alias(b), F.col("th").alias(th)).distinct()
    mine = docs.withColumns({a: at[0], b: at[1], th: F.xxhash64(F.col("text").cast("string"))})
    left = mine.join(gone, [a, b, th], "left_anti")
    # identical rows are copies as well: one of them stays; rows without words are no copies
    words = F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r ", "") != ""
    left = left.withColumn(n, F.when(words, F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return left.dropDuplicates([a, b, th, n]).select([F.col(f"`{c}`") for c in docs.columns])


def _free_names(taken: list[str], n: int) -> list[str]:
    """Column names that the input does not have."""
    used, out, i = {c.lower() for c in taken}, [], 0
    while len(out) < n:
        if f"__k{i}" not in used:
            out.append(f"__k{i}")
        i += 1
    return out
