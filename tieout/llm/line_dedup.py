"""Line dedup over a sharded minimal perfect hash (operator 2).

Distinct line keys of the whole corpus are hashed to 128 bits and split into
shards of about ``shard_keys`` keys. For each shard a minimal perfect hash is
built; it indexes a compact fingerprint array, a document-count array and, for
the frequent keys only, the largest doc_id. Documents probe these arrays: the
distinct key hashes of a block of documents go to their shards once per block
(a line that a third of all documents share costs one probe per block), the
shard's task answers from its arrays, and the answers return to the block. No
line text is joined or shuffled.

Every probed key was indexed, so a minimal perfect hash finds its own slot; the
fingerprint tells foreign keys apart when another corpus probes the arrays.

Defined results: a null or empty text has one empty line; a null doc_id counts
as one document that is smaller than any other; repeated rows are one document
to the counts and each gives its own output row; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, written
from .kernels import mix, text_buffers

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 12
BLOCK_BYTES = 2 << 20
NULL_ID = -(1 << 63)


def line_keys(raw: bytes, min_chars: int):
    """(line, key or None) of every line; None where the key is too short."""
    for line in raw.split(b"\n"):
        key = line.strip(b" \t\n\r\x0b\x0c").lower()  # bytes: only A-Z are lower-cased
        n = len(key)
        if n >= min_chars and not key.isascii():
            n -= sum(1 for b in key if b & 0xC0 == 0x80)
        yield line, (key if n >= min_chars else None)


# --- minimal perfect hash of one shard ---------------------------------------------------------------------------

def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)


def mphf_build(keys: np.ndarray, gamma: float = 2.0, levels: int = 48) -> tuple[bytes, np.ndarray]:
    """(function, slot of every key). Each level marks the slots that exactly one
    remaining key takes; the others try the next level. Keys left over after the
    last level (equal 64-bit keys) are listed by value."""
    sizes, bits, at = [], [], np.full(len(keys), -1, np.int64)
    rest, base = np.arange(len(keys)), 0
    for level in range(levels):
        if len(rest) == 0:
            break
        size = max(8, int(gamma * len(rest)))
        slot = _slots(keys[rest], level, size)
        single = np.bincount(slot, minlength=size) == 1
        placed = single[slot]
        at[rest[placed]] = base + slot[placed]
        rest, base = rest[~placed], base + size
        sizes.append(size)
        bits.append(single)
    all_bits = np.concatenate(bits) if bits else np.empty(0, bool)
    rank = np.cumsum(all_bits) - 1
    slots = np.where(at >= 0, rank[np.maximum(at, 0)] if len(rank) else -1, -1)
    slots[rest] = int(all_bits.sum()) + np.arange(len(rest))
    packed = np.packbits(all_bits).tobytes()
    head = struct.pack(f"<III{len(sizes)}I", len(sizes), len(rest), len(packed), *sizes)
    return head + packed + keys[rest].tobytes(), slots


class Mphf:
    def __init__(self, blob: bytes):
        n, left, packed = struct.unpack_from("<III", blob)
        self.sizes = struct.unpack_from(f"<{n}I", blob, 12)
        at = 12 + 4 * n
        self.bits = np.unpackbits(np.frombuffer(blob, np.uint8, packed, at), count=sum(self.sizes)).astype(bool)
        self.rank = np.cumsum(self.bits) - 1
        self.left = np.frombuffer(blob, np.uint64, left, at + packed)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; a key that was not indexed gets any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        rest, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + _slots(keys[rest], level, size)
            found = self.bits[at]
            out[rest[found]] = self.rank[at[found]]
            rest, base = rest[~found], base + size
            if len(rest) == 0:
                return out
        for i, key in enumerate(self.left):
            out[rest[keys[rest] == key]] = int(self.bits.sum()) + i
        return out


def _key64(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1.view(np.uint64) ^ mix(h2.view(np.uint64))


def _fingerprints(h2: np.ndarray) -> np.ndarray:
    return (h2.view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _int64(column) -> np.ndarray:
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False), dtype=np.int64)


def _build_shard(min_docs: int):
    def build(table: pa.Table) -> pa.Table:
        h1, h2 = _int64(table["h1"].combine_chunks()), _int64(table["h2"].combine_chunks())
        n, keeper = _int64(table["n_docs"].combine_chunks()), _int64(table["keeper"].combine_chunks())
        blob, slot = mphf_build(_key64(h1, h2))
        prints, counts = np.empty(len(slot), np.uint32), np.empty(len(slot), np.uint32)
        prints[slot], counts[slot] = _fingerprints(h2), np.minimum(n, 0xFFFFFFFF)
        keep = np.empty(len(slot), np.int64)
        keep[slot] = keeper
        return pa.table({"shard": table["shard"][:1], "mphf": pa.array([blob], pa.binary()),
                         "prints": pa.array([prints.tobytes()], pa.binary()),
                         "counts": pa.array([counts.tobytes()], pa.binary()),
                         "keepers": pa.array([keep[counts >= min_docs].tobytes()], pa.binary())})
    return build


# --- Arrow maps ----------------------------------------------------------------------------------------------------

def _hits(min_chars: int):
    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column(2))
            digests, rows = [], []
            for i in range(batch.num_rows):
                keys = {k for _, k in line_keys(data[off[i]:off[i + 1]].tobytes(), min_chars) if k is not None}
                digests += [xxhash.xxh3_128_digest(k) for k in keys]
                rows += [i] * len(keys)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(h[:, 0].copy()),
                 pa.array(h[:, 1].copy())], names=["doc", "dh", "h1", "h2"])
    return run


def _probe(min_docs: int):
    """Rows come by shard: its arrays first, then the hashes of one block each."""
    def run(batches):
        shard = None
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                number = batch.column("shard")[row].as_py()
                if batch.column("mphf")[row].is_valid:
                    f = Mphf(batch.column("mphf")[row].as_py())
                    prints = np.frombuffer(batch.column("prints")[row].as_py(), np.uint32)
                    counts = np.frombuffer(batch.column("counts")[row].as_py(), np.uint32)
                    keepers = np.frombuffer(batch.column("keepers")[row].as_py(), np.int64)
                    order = np.cumsum(counts >= min_docs) - 1
                    shard = number
                    continue
                if number != shard:
                    raise RuntimeError("the arrays of a shard must come before its probes")
                h1, h2 = (_int64(batch.column(c)[row].values) for c in ("h1s", "h2s"))
                slot = f(_key64(h1, h2))
                hit = (slot >= 0) & (prints[slot] == _fingerprints(h2)) & (counts[slot] >= min_docs)
                if hit.any():
                    out.append((batch.column("block")[row].as_py(), h1[hit], h2[hit], keepers[order[slot[hit]]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()),
                 *(pa.array([x[i] for x in out], pa.list_(pa.int64())) for i in (1, 2, 3))],
                names=["block", "h1s", "h2s", "keepers"])
    return run


def _clean(min_chars: int):
    """Rows come by block: the answers first, then the documents."""
    def run(batches):
        block, keeper = None, {}
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            blocks, kinds = batch.column("block").to_pylist(), batch.column("kind").to_pylist()
            docs, rows, texts, n_lines, n_dropped = batch.column("doc").to_pylist(), [], [], [], []
            for i in range(batch.num_rows):
                if blocks[i] != block:
                    block, keeper = blocks[i], {}
                if kinds[i] == 0:
                    h = np.stack([_int64(batch.column(c)[i].values) for c in ("h1s", "h2s")], axis=1).astype("<i8")
                    raw = h.tobytes()
                    keeper.update((raw[16 * j:16 * j + 16], k)
                                  for j, k in enumerate(batch.column("keepers")[i].as_py()))
                    continue
                kept, n = [], 0
                for line, key in line_keys(data[off[i]:off[i + 1]].tobytes(), min_chars):
                    n += 1
                    if key is None or not keeper or keeper.get(xxhash.xxh3_128_digest(key), docs[i]) == docs[i]:
                        kept.append(line)
                rows.append(i)
                texts.append(b"\n".join(kept))
                n_lines.append(n)
                n_dropped.append(n - len(kept))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(at), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array(texts, pa.binary()).cast(pa.string(), safe=False),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                names=["row", "n_lines", "n_dropped", "kept_text", "kept_sha256"])
    return run


def line_hits(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, dh, h1, h2: the distinct key hashes of every row (doc: its id; dh: deals rows to blocks)."""
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
                      F.xxhash64("doc_id", "text").alias("dh"), F.col("text").cast("string").alias("text"))
    return arrow_map(src, _hits(min_chars), "doc long, dh long, h1 long, h2 long")


def line_index(hits: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(one row of arrays per shard, number of shards)."""
    counts = written(hits.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(
        F.count("*").alias("n_docs"), F.max("doc").alias("keeper")), "line-counts")
    shards = max(1, -(-counts.count() // shard_keys))
    index = counts.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInArrow(
        _build_shard(min_docs), "shard long, mphf binary, prints binary, counts binary, keepers binary")
    return index, shards


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                shard_keys: int = SHARD_KEYS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``row`` (struct of all input columns but ``text``), n_lines, n_dropped,
    kept_text, kept_sha256."""
    n = partitions(docs.sparkSession)
    hits = written(line_hits(docs, min_chars), "line-hits")
    index, shards = line_index(hits, min_docs, shard_keys)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod("dh", F.lit(blocks))
    probes = (hits.select(block.alias("block"), "h1", "h2").distinct()
              .groupBy(F.pmod("h1", F.lit(shards)).alias("shard"), "block")
              .agg(F.collect_list("h1").alias("h1s"), F.collect_list("h2").alias("h2s")))
    asked = (index.unionByName(probes, allowMissingColumns=True).repartition(n, "shard")
             .sortWithinPartitions("shard", F.col("mphf").isNull()))
    answers = arrow_map(asked, _probe(min_docs), "block long, h1s array<long>, h2s array<long>, keepers array<long>")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    texts = docs.select(rest, F.col("text").cast("string").alias("text"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
                        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), F.lit(1).alias("kind"))
    together = (texts.unionByName(answers.withColumn("kind", F.lit(0)), allowMissingColumns=True)
                .repartition(n, "block").sortWithinPartitions("block", "kind"))
    kind = docs.select(rest).schema["row"].dataType.simpleString()
    return arrow_map(together, _clean(min_chars),
                     f"row {kind}, n_lines long, n_dropped long, kept_text string, kept_sha256 string")
