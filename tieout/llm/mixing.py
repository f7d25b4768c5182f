"""Mixing sources to target weights (operator 1).

Words are the tokens. Each source's documents, in a pseudorandom order, form
one word stream that is packed into blocks of ``block_words``. The mix consists
of slots; a slot takes one block. Per output shard of ``shard_slots`` slots the
counts of the sources are a multinomial draw; the draws of all shards together
miss the planned totals by a little, so slots past a source's planned total go
to the sources that were drawn too rarely (prefix sums map the j-th such slot
to the j-th missing one). A source's slots are numbered across shards by prefix
sums, and slot j maps through the source's pseudorandom permutation of its
block indices (a cycle-walking Feistel network, one per pass over the source).
Slots and blocks are joined by (source, block index).

A source's planned words are its target, rounded down. Its last slot takes only
the words that are left to plan, and the short last block of a stream always
comes last in a pass, so words taken equal the plan exactly and no word is
taken more than ``max_epochs`` times.

Only one row per source reaches the driver (sources are a bounded dimension;
more than ``max_sources`` raise an error).

Defined results: a null text has size 0; the null source is a source of its own
and comes last; a null doc_id is an ordinary row; repeated rows each take part;
an empty table gives an empty table; other columns are ignored. Reruns agree:
the order within a source depends on the rows' values alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, partitions, written
from .kernels import NOT_WHITESPACE, mix, pieces, split_words, text_buffers

WEIGHTS = (3, 1, 2)
SHARE, MAX_EPOCHS = 1.5, 2
BLOCK_WORDS = 512
SHARD_SLOTS = 1 << 14
BUCKET_ROWS = 1024
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MAX_EPOCHS) -> list[float]:
    """Words for each source: ``share`` of all words by weight, at most ``most`` times a
    source's own; what a source cannot take is shared among the others by weight."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    free = [i for i, s in enumerate(sizes)]
    while free:
        total = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each index under a pseudorandom permutation of 0 .. n - 1 chosen by its key."""
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.flatnonzero(n > 1)
    while len(todo):  # walk on until the image lies inside; each pass ends more than a quarter of the walks
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (mix(right + k * np.uint64(2 * r + 3) + np.uint64(r)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _sizes():
    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            n = [np.empty(0, np.int64)]
            for a, b in pieces(off):
                n.append(np.diff(split_words(data[off[a]:off[b]], off[a:b + 1] - off[a], NOT_WHITESPACE)[2]))
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate(n))],
                                             names=[*keep, "size"])
    return run


def _cut():
    """Slices of whole texts: text, start of the first word and end of the last, in words of the text."""
    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            lo, hi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            out = []
            for i in range(batch.num_rows):
                own = data[off[i]:off[i + 1]]
                starts, ends, _ = split_words(own, np.array([0, len(own)]), NOT_WHITESPACE)
                out.append([own[starts[a]:ends[b - 1]].tobytes() for a, b in zip(lo[i], hi[i])])
            keep = [c for c in batch.schema.names if c not in ("text", "lo", "hi")]
            flat = pa.array(out, pa.list_(pa.binary())).cast(pa.list_(pa.string()), safe=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat], names=[*keep, "texts"])
    return run


def _draw(p: np.ndarray, total: int, shard_slots: int, seed: int):
    """(shard, source, count) of the multinomial draw of each shard number."""
    def run(batches):
        for batch in batches:
            out = []
            for shard in batch.column(0).to_pylist():
                slots = min(shard_slots, total - shard * shard_slots)
                counts = np.random.default_rng([seed, shard]).multinomial(slots, p)
                out += [(shard, int(s), int(counts[s])) for s in np.flatnonzero(counts)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)],
                                             names=["shard", "drawn", "n"])
    return run


def _slots(sizes, plan, n_slots, drawn, block_words: int, seed: int):
    """Every slot of a (shard, source, count, first number) row: its source after
    the correction, its block and the words it takes."""
    size, words, slots, had = (np.asarray(x, np.int64) for x in (sizes, plan, n_slots, drawn))
    full = size // block_words
    per_pass = np.maximum(full + (size % block_words > 0), 1)
    surplus, lack = np.maximum(had - slots, 0), np.maximum(slots - had, 0)
    surplus_at, lack_end = np.cumsum(surplus) - surplus, np.cumsum(lack)

    def run(batches):
        for batch in batches:
            shard, drawn_no, n, first = (batch.column(c).to_numpy() for c in ("shard", "drawn", "n", "first"))
            for a in range(len(n)):
                s = np.full(n[a], drawn_no[a])
                j = first[a] + np.arange(n[a])
                extra = np.flatnonzero(j >= slots[s])
                if len(extra):
                    g = surplus_at[s[extra]] + j[extra] - slots[s[extra]]
                    to = np.searchsorted(lack_end, g, side="right")
                    s[extra], j[extra] = to, had[to] + g - (lack_end[to] - lack[to])
                turn, i = j // per_pass[s], j % per_pass[s]
                with np.errstate(over="ignore"):
                    key = mix(mix(s.astype(np.uint64) + np.uint64(seed)) + turn.astype(np.uint64))
                inside = i < full[s]
                block = np.where(inside, 0, full[s])
                block[inside] = permuted(i[inside], full[s][inside], key[inside])
                length = np.where(inside, block_words, size[s] % block_words)
                take = np.minimum(length, words[s] - turn * size[s] - i * block_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n[a], shard[a])), pa.array(np.arange(n[a]) + (drawn_no[a] << 32)),
                     pa.array(s), pa.array(block), pa.array(take)],
                    names=["shard", "slot", "source_no", "block", "take"])
    return run


class Mix:
    """The packed blocks of every source and the slots that take them."""

    def __init__(self, docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
                 block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7,
                 max_sources: int = MAX_SOURCES, with_text: bool = False):
        spark = docs.sparkSession
        self.block_words, self.with_text = block_words, with_text
        src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                          F.xxhash64("doc_id", "source", "text").alias("ord"),
                          F.col("text").cast("string").alias("text"))
        sized = written(arrow_map(src, _sizes(), "doc_id long, source string, ord long, size long"), "mix-sizes")
        found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        rows = found.limit(max_sources + 1).collect()
        if len(rows) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        # code points order as UTF-8 bytes do; the null source is last
        rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
        sizes = [int(r["size"]) for r in rows]
        goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(rows))], share, max_epochs)
        plan = [int(x) for x in goal]
        n_slots = [self._slot_count(s, t) for s, t in zip(sizes, plan)]
        self.total = sum(n_slots)
        self.sources = spark.createDataFrame(
            [(r.source, i, s, t, max(1, -(-int(r["rows"]) // BUCKET_ROWS)))
             for i, (r, s, t) in enumerate(zip(rows, sizes, goal))],
            "source string, source_no long, source_size long, target double, buckets long")
        self.sized, self.src = sized, src
        if self.total:
            p = np.asarray(n_slots, float) / self.total
            shards = -(-self.total // shard_slots)
            draws = written(arrow_map(spark.range(shards), _draw(p, self.total, shard_slots, seed),
                                      "shard long, drawn long, n long"), "mix-draws")
            had = [0] * len(rows)
            for r in draws.groupBy("drawn").agg(F.sum("n").alias("n")).collect():  # one row per source
                had[r.drawn] = int(r.n)
            w = Window.partitionBy("drawn").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
            numbered = draws.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))
            self.slots = arrow_map(numbered, _slots(sizes, plan, n_slots, had, block_words, seed),
                                   "shard long, slot long, source_no long, block long, take long")
        else:
            self.slots = spark.createDataFrame([], "shard long, slot long, source_no long, block long, take long")

    def _slot_count(self, size: int, plan: int) -> int:
        if size == 0 or plan == 0:
            return 0
        full, b = size // self.block_words, self.block_words
        turns, left = divmod(plan, size)
        return turns * (full + (size % b > 0)) + (-(-left // b) if left <= full * b else full + 1)

    def placed(self) -> DataFrame:
        """Every row with ``start``, its first word's place in its source's stream.
        Prefix sums in two steps: over buckets of a source (one row each), then
        inside a bucket, so no task gets a whole source."""
        rows = self.sized
        if self.with_text:
            rows = arrow_map(self.src.select("doc_id", "source", "ord", "text", F.col("text").alias("kept")),
                             _sizes(), "doc_id long, source string, ord long, kept string, size long")
        rows = rows.withColumnRenamed("source", "of").join(
            F.broadcast(self.sources), F.col("of").eqNullSafe(F.col("source"))).drop("of")
        rows = rows.withColumn("bucket", F.pmod("ord", F.col("buckets")))
        base = self.sized.withColumnRenamed("source", "of").join(
            F.broadcast(self.sources), F.col("of").eqNullSafe(F.col("source")))
        base = base.groupBy("source_no", F.pmod("ord", F.col("buckets")).alias("bucket")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        base = base.select("source_no", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
        inside = Window.partitionBy("source_no", "bucket").orderBy("ord", "doc_id", "size")
        rows = rows.withColumn("rank", F.row_number().over(inside)).withColumn(
            "start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        rows = rows.join(base.hint("merge"), ["source_no", "bucket"]).withColumn("start", F.col("start") + F.col("base"))
        return rows.drop("base", "buckets", "ord")

    def packed(self) -> DataFrame:
        """One row per row and block it reaches into: words ``lo`` up to ``hi`` of the
        text stand from word ``at`` of the block. Rows without words keep a null block."""
        b, end = F.lit(self.block_words), F.col("start") + F.col("size")
        rows = self.placed().withColumn("blocks", F.when(
            F.col("size") > 0, F.sequence((F.col("start") / b).cast("long"), ((end - 1) / b).cast("long"))))
        lo = F.transform("blocks", lambda k: F.greatest(k * b - F.col("start"), F.lit(0)))
        hi = F.transform("blocks", lambda k: F.least((k + 1) * b - F.col("start"), F.col("size")))
        if not self.with_text:
            rows = rows.withColumn("part", F.explode_outer(F.arrays_zip(F.col("blocks").alias("block"),
                                                                        lo.alias("lo"), hi.alias("hi"))))
            keep = [c for c in rows.columns if c not in ("blocks", "part")]
        else:
            cut = rows.where("size > 0").withColumn("lo", lo).withColumn("hi", hi).withColumn(
                "los", F.col("lo")).withColumn("his", F.col("hi")).withColumnRenamed("kept", "text")
            kept = [f for f in cut.schema if f.name not in ("text", "lo", "hi")]
            rows = arrow_map(cut, _cut(), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
                             + ", texts array<string>")
            rows = rows.withColumn("part", F.explode(F.arrays_zip(
                F.col("blocks").alias("block"), F.col("los").alias("lo"), F.col("his").alias("hi"),
                F.col("texts").alias("text"))))
            keep = [c for c in rows.columns if c not in ("blocks", "los", "his", "texts", "part")]
        return rows.select(*keep, "part.*").withColumn("at", F.col("start") + F.col("lo") - F.col("block") * b)

    def taken(self) -> DataFrame:
        """One row per input row: the words that the mix takes, repeats counted."""
        got = F.when(F.col("take").isNotNull(),  # no slot took the block otherwise
                     F.least(F.col("hi") - F.col("lo"), F.col("take") - F.col("at")))
        n = partitions(self.sized.sparkSession)
        slots = self.slots.repartition(n, "source_no", "block").hint("merge")  # slots grow with the data
        return (self.packed().join(slots, ["source_no", "block"], "left")
                .groupBy("source_no", "bucket", "rank").agg(
                    *(F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")),
                    F.coalesce(F.sum(F.greatest(got, F.lit(0))), F.lit(0)).cast("long").alias("taken"))
                .drop("source_no", "bucket", "rank"))

    def rows(self) -> DataFrame:
        """The mix itself: one row per slot and document piece in it, with its
        text (words up to ``n_words``); sorted by (shard, slot, at) it is the shard's text."""
        got = F.least(F.col("hi") - F.col("lo"), F.col("take") - F.col("at"))
        out = self.packed().join(self.slots.hint("merge"), ["source_no", "block"]).withColumn("n_words", got).where("n_words > 0")
        cols = ["shard", "slot", "at", "doc_id", "source", "n_words"]
        if not self.with_text:
            return out.select(*cols, "lo")
        text = F.when(F.col("n_words") == F.col("hi") - F.col("lo"), F.col("text")).otherwise(
            F.call_function("regexp_extract", F.col("text"), F.concat(
                F.lit(r"^(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){"), F.col("n_words").cast("string"), F.lit("}")),
                F.lit(0)))
        return out.select(*cols, text.alias("text"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row."""
    return Mix(docs, **options).taken()
