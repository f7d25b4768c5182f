"""Layer 3 audit log: SHA-256 hash-chained append, verification, the
warehouse link view, retention purge with a chain anchor, query and export.

Canonical hashed text (``hash_version = 2``), built JVM-side::

    body = lp(event_id) | lp(event_type) | lp(timestamp) | lp(actor) |
           lp(action) | lp(resource) | lp(details)
    event_hash = sha256(body || '|' || lp(previous_hash))

with ``lp(x) = length(x) ':' x`` (``~`` for NULL) and the timestamp as
``yyyy-MM-ddTHH:mm:ss.ffffff``. Length prefixes stop field-boundary
collisions; ``details`` is a JSON string.

``details`` is hashed in canonical form (keys sorted at every depth, no
spaces), so equal payloads hash alike however they were written.

The chain is cut into blocks of ``BLOCK_ROWS`` consecutive ``seq``: the first
event of a block links to the genesis value, every other one to the event
before it. So blocks fold and verify independently and in parallel, and no
task ever holds more than a block. The blocks are tied together by a tree of
hashes that is recorded with the append (``audit_tree.py``); a log of more than
one block is verified with it only. A block's place cannot be forged, because
the hashed event id carries ``seq``; ``verify`` also demands that the rows
before a block's first row are there.

Plans:

* append: numbering (distributed positions), then one shuffle by block and a
  fold inside each block. With ``chain_by`` a (chain, block) pair is the unit,
  so a chain that holds a third of all events still folds in many tasks.
* verify: hashes are recomputed row-locally in codegen; links need the row
  before in the block, a window over at most ``BLOCK_ROWS`` rows; a join with
  the per-block row counts finds missing ends of blocks.
* ``hash_version = 1`` keeps the original logger's form: one chain over the
  whole log. It is there to verify old logs and to go on with them; its fold is
  sequential by definition and runs in blocks, one after another.

"""

from __future__ import annotations

import hashlib
import uuid
from typing import Iterator, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import seq_id
from ..plans.seq import dense_sequence, lag_dense
from ..session import ensure_checkpoint_dir, stored
from . import audit_tree
from .audit_tree import AuditTree

# fixed value: genesis link
GENESIS_HASH = "0" * 64
#: Events in a block of the chain. A log is verified with the value it was written with.
BLOCK_ROWS = 4096
#: Block headers that one task chains: 65,536 (of 268 million events).
HEADER_RUN = 1 << 16

LOG_COLUMNS = ["seq", "event_id", "event_type", "timestamp", "actor", "action", "resource", "details",
               "previous_hash", "event_hash", "event_date", "hash_version"]
HASH_VERSION = 2  # the length-prefixed canonical text above; 1 = the original logger's sorted-key JSON
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def lp(c: Column) -> Column:
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~"))


def canonical_details(details: Column) -> Column:
    """JSON text with sorted keys and no spaces; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(details)), details)


def body_rest(event_type: Column, ts: Column, actor: Column, action: Column, resource: Column,
              details: Column) -> Column:
    """Hashed text after the event id (everything known before numbering)."""
    return F.concat_ws("|", lp(event_type), lp(F.date_format(ts, TS_FORMAT)), lp(actor), lp(action),
                       lp(resource), lp(canonical_details(details)))


def body_text(event_id: Column, event_type: Column, ts: Column, actor: Column, action: Column,
              resource: Column, details: Column) -> Column:
    return F.concat(lp(event_id), F.lit("|"), body_rest(event_type, ts, actor, action, resource, details))


def _row_rest() -> Column:
    return body_rest(*[F.col(c) for c in ("event_type", "timestamp", "actor", "action", "resource", "details")])


def link_hash(body: Column, previous_hash: Column) -> Column:
    return F.sha2(F.concat(body, F.lit("|"), lp(previous_hash)), 256)


def _row_body() -> Column:
    return body_text(*[F.col(c) for c in ("event_id", "event_type", "timestamp", "actor", "action",
                                          "resource", "details")])


# --------------------------------------------------------------------- fold
_V1_FIELDS = ("event_type", "_ts_text", "actor", "action", "resource", "details")


def _hasher(version: int):
    """Per-row link hash of one canonical form. Built inside the fold's
    closure, so Python workers get it by value."""
    if version == 1:
        import json

        def h1(eid: str, row: tuple, prev: str) -> str:
            event_type, ts_text, actor, action, resource, details = row
            payload = {"event_id": eid, "event_type": event_type, "timestamp": ts_text, "actor": actor,
                       "action": action, "resource": resource, "details": json.loads(details) if details else {},
                       "previous_hash": prev}
            return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()
        return h1

    def h2(eid: str, row: tuple, prev: str) -> str:
        (rest,) = row
        return hashlib.sha256(f"{len(eid)}:{eid}|{rest}|64:{prev}".encode("utf-8")).hexdigest()
    return h2


def _inputs(version: int) -> tuple[str, ...]:
    return _V1_FIELDS if version == 1 else ("_rest",)


def _fold(seed: str | None, chain_col: str | None, version: int = HASH_VERSION, drop: tuple[str, ...] = ()):
    """Arrow fold over rows sorted by (chain, seq). Per row it does one
    hash of the canonical text: the only sequential work of the append.
    Columns in ``drop`` are not passed on."""
    names = _inputs(version)
    step = _hasher(version)  # nested functions: shipped to the workers by value

    def values(column: pa.Array) -> list:
        """Texts by way of an object array, which takes a tenth of the time of ``to_pylist``."""
        return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()


    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = seed
        cur = object()
        for b in batches:
            col = lambda n: values(b.column(b.schema.get_field_index(n)))
            ids = col("event_id")
            fields = list(zip(*[col(n) for n in names]))
            chains = col(chain_col) if chain_col else None
            seeds = col("_seed") if chain_col else None
            prevs, hashes = [], []
            for i, eid in enumerate(ids):
                if chains is not None and chains[i] != cur:
                    cur = chains[i]
                    prev = seeds[i] or GENESIS_HASH
                p = prev or GENESIS_HASH
                h = step(eid, fields[i], p)
                prevs.append(p)
                hashes.append(h)
                prev = h
            kept = [n for n in b.schema.names if n not in drop]
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in kept] + [pa.array(prevs, pa.string()), pa.array(hashes, pa.string())],
                names=kept + ["previous_hash", "event_hash"])
    return fn


def _fold_schema(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType(df.schema.fields + [T.StructField(n, T.StringType(), True)
                                            for n in names or ("previous_hash", "event_hash")])


def _finish(df: DataFrame, extra: list[str], version: int = HASH_VERSION) -> DataFrame:
    return df.withColumn("hash_version", F.lit(version)).select(*LOG_COLUMNS, *extra)


def _hash_inputs(df: DataFrame, version: int) -> DataFrame:
    """Columns the fold hashes: the rendered text after the id (v2), or the
    event fields plus ``str(datetime)`` of the timestamp (v1)."""
    if version == 1:
        from ..functions.canonical import python_timestamp_text
        return df.withColumn("_ts_text", python_timestamp_text(F.col("timestamp")))
    return df.withColumn("_rest", _row_rest())


def prepare_events(events: DataFrame, *, order_by: list[str | Column], start_seq: int = 1,
                   timestamp_col: str = "timestamp", hash_version: int = HASH_VERSION) -> DataFrame:
    """Number events (dense, in ``order_by`` order, from ``start_seq``),
    format ids and render the hashed body, all in parallel."""
    numbered = dense_sequence(events, order_by, name="seq", start=start_seq)
    ts = F.col(timestamp_col).cast("timestamp_ntz")
    staged = numbered.select(
        "*", seq_id("AUD", F.col("seq"), 8).alias("event_id"), ts.alias("_ts")) \
        .drop(timestamp_col).withColumnRenamed("_ts", "timestamp") \
        .withColumn("event_date", F.date_format("timestamp", "yyyy-MM-dd"))
    return _hash_inputs(staged, hash_version)


def tail_state(log: DataFrame | None, anchor: DataFrame | None = None) -> tuple[int, str]:
    """(next seq, last hash) of a log: of its last event, or, where a purge
    has left none, of the purge's ``anchor`` row. Two scalars."""
    r = log.agg(F.max("seq").alias("m"), F.max_by("event_hash", "seq").alias("h")).first() if log is not None else None
    if r is not None and r["m"] is not None:
        return int(r["m"]) + 1, r["h"]
    a = anchor.first() if anchor is not None else None
    return (int(a["next_seq"]), a["anchor_hash"]) if a is not None else (1, GENESIS_HASH)


def _block(block_rows: int) -> Column:
    return F.floor((F.col("seq") - 1) / F.lit(block_rows)).cast("long")


def _opens_block(block_rows: int) -> Column:
    return (F.col("seq") - 1) % F.lit(block_rows) == 0


def audit_append(events: DataFrame, *, order_by: list[str | Column], tail: DataFrame | None = None,
                 anchor: DataFrame | None = None, chain_by: str | None = None,
                 block_rows: int = BLOCK_ROWS, timestamp_col: str = "timestamp",
                 hash_version: int = HASH_VERSION) -> DataFrame:
    """Append ``events`` (event_type, timestamp, actor, action, resource,
    details JSON string) after ``tail`` and return the new rows with ids and
    hashes, stored once in the checkpoint folder. ``order_by`` must be
    unique. After a purge that left no event, ``anchor`` (the purge's) makes
    ids and links go on. See the module doc for the plan."""
    spark = events.sparkSession
    start, last = tail_state(tail, anchor)
    extra = [c for c in events.columns if c not in LOG_COLUMNS and c != timestamp_col]
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/audit-append-{uuid.uuid4().hex}"
    staged = prepare_events(events, order_by=order_by, start_seq=start, timestamp_col=timestamp_col,
                            hash_version=hash_version)
    if hash_version == 1:
        return _finish(_append_single_chain(staged, base, start, last, block_rows), extra, hash_version)
    staged = staged.withColumn("_block", _block(block_rows))
    unit = ["_block"] if chain_by is None else [chain_by, "_block"]
    # only the block that the tail has left open goes on from a hash
    open_block = (start - 1) // block_rows if (start - 1) % block_rows else -1
    if chain_by is None:
        staged = staged.withColumn("_seed", F.when(F.col("_block") == open_block, F.lit(last)))
    elif tail is not None:
        heads = tail.where(_block(block_rows) == open_block).groupBy(F.col(chain_by).alias("_chain")).agg(
            F.max_by("event_hash", "seq").alias("_head"))
        staged = staged.join(heads, F.col(chain_by).eqNullSafe(F.col("_chain")), "left").withColumn(
            "_seed", F.when(F.col("_block") == open_block, F.col("_head"))).drop("_chain", "_head")
    else:
        staged = staged.withColumn("_seed", F.lit(None).cast("string"))
    staged = staged.withColumn("_unit", F.concat_ws("|", *[lp(F.col(f"`{c}`").cast("string")) for c in unit]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one chain: its blocks are stretches of seq, and a long sorts faster than a text
    s = staged.repartition(n, "_unit").sortWithinPartitions(*(["seq"] if chain_by is None else ["_unit", "seq"]))
    # what only the fold needs is not stored
    drop = tuple(c for c in ("_rest", "_unit", "_seed", "_block") if c not in extra)
    schema = _fold_schema(s.drop(*drop))
    s.mapInArrow(_fold(None, "_unit", hash_version, drop), schema).write.parquet(f"{base}/chain")
    out = _finish(spark.read.schema(schema).parquet(f"{base}/chain"), extra, hash_version)
    out._frozen = True  # this frame itself, not what is derived from it
    return out


class Appended(NamedTuple):
    rows: DataFrame  # the new events
    tree: AuditTree  # the log's tree after them; its head belongs outside the log


def audit_append_recorded(events: DataFrame, *, order_by: list[str | Column], tail: DataFrame | None = None,
                          tree: AuditTree | None = None, fanout: int = audit_tree.FANOUT,
                          block_rows: int = BLOCK_ROWS, chain_by: str | None = None, **options) -> Appended:
    """``audit_append`` that also extends the log's tree by the new events."""
    rows = audit_append(events, order_by=order_by, tail=tail, block_rows=block_rows, chain_by=chain_by, **options)
    started = None
    if chain_by is not None and tail is not None:
        end = tail_state(tail)[0] - 1
        started = tail.where((F.col("seq") > end - end % block_rows) & (F.col("seq") <= end))
    return Appended(rows, audit_tree.extend(tree, rows, block_rows=block_rows, chain_by=chain_by, open_block=started,
                                            fanout=fanout))


def _append_single_chain(staged: DataFrame, base: str, start: int, last: str, block_rows: int) -> DataFrame:
    """The original logger's one chain (v1): each hash covers the one before it
    over the whole log, so blocks fold one after another, each seeded with the
    last hash of the one before. No task holds more than a block."""
    spark = staged.sparkSession
    staged.withColumn("_block", F.floor((F.col("seq") - F.lit(start)) / F.lit(block_rows)).cast("long")) \
        .write.partitionBy("_block").parquet(f"{base}/staged")
    schema = _fold_schema(staged)
    rows = spark.read.schema(T.StructType(staged.schema.fields + [T.StructField("_block", T.LongType())])) \
        .parquet(f"{base}/staged")
    top, prev = rows.agg(F.max("_block")).first()[0], last
    for b in range(0 if top is None else top + 1):
        part = rows.filter(F.col("_block") == b).drop("_block").coalesce(1).sortWithinPartitions("seq")
        part.mapInArrow(_fold(prev, None, 1), schema).write.parquet(f"{base}/chain/_block={b}")
        prev = spark.read.schema(schema).parquet(f"{base}/chain/_block={b}").agg(
            F.max_by("event_hash", "seq")).first()[0]
    if top is None:
        return staged.withColumns({c: F.lit(None).cast("string") for c in ("previous_hash", "event_hash")})
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/chain")


# ------------------------------------------------------------------- verify
class Verification(NamedTuple):
    rows: DataFrame     # one row per event: links and hash checks
    verdict: DataFrame  # one row: valid, first violation


def _expected_links(rows: DataFrame, *, single_chain: bool, anchor_hash: str, first_seq: int | None,
                    chain_by: str | None, block_rows: int) -> DataFrame:
    """``expected_previous_hash`` of every row, and ``contiguous``: false for
    the first row of a block before which rows of the log are missing;
    ``_opens`` marks the first row of a block (and chain)."""
    opens = _opens_block(block_rows)
    if single_chain:
        rows = lag_dense(rows, "seq", "event_hash", "_lag")
        v2_start = (F.col("hash_version") == HASH_VERSION) & opens
        return rows.withColumn("expected_previous_hash", F.when(v2_start, F.lit(GENESIS_HASH)).otherwise(
            F.coalesce("_lag", F.lit(anchor_hash)))).withColumns(
            {"contiguous": F.lit(True), "_opens": opens}).drop("_lag")
    rows = rows.withColumn("_block", _block(block_rows))
    w = Window.partitionBy("_block", *([chain_by] if chain_by else [])).orderBy("seq")
    head = F.when((F.col("seq") == F.lit(first_seq)) & ~opens, F.lit(anchor_hash)).otherwise(F.lit(GENESIS_HASH))
    rows = rows.withColumns({"expected_previous_hash": F.coalesce(F.lag("event_hash").over(w), head),
                             "_opens": F.lag("seq").over(w).isNull()})  # the first row left of its block
    ends = rows.groupBy((F.col("_block") + 1).alias("_block")).agg(F.max("seq").alias("_before"))
    return rows.join(ends, "_block", "left").withColumn(
        "contiguous", ~opens | (F.col("seq") == F.lit(first_seq))
        | F.coalesce(F.col("_before") == F.col("seq") - 1, F.lit(False))).drop("_before", "_block")


def _tie_blocks(rows: DataFrame, log: DataFrame, tree: AuditTree, hi: int, chain_by: str | None,
                block_rows: int) -> DataFrame:
    """Adds the recorded and actual hash of a changed block, ``_expected`` and
    ``_actual``, to the event that follows the block (where a single chain would
    break), or to the log's last event if nothing follows; ``_tied`` is false there."""
    changed = audit_tree.changed_blocks(log, tree, block_rows=block_rows, chain_by=chain_by)
    what = F.struct(F.col("expected").alias("_expected"), F.col("actual").alias("_actual"))
    after = changed.select((F.col("block") + 1).alias("_block"), what.alias("_after"))
    last = changed.where(F.col("block") >= F.lit((hi - 1) // block_rows)).agg(F.min_by(what, "block").alias("_end"))
    rows = rows.withColumn("_block", _block(block_rows)).join(after, "_block", "left").crossJoin(F.broadcast(last))
    broken = F.when(F.col("_opens") & F.col("_after").isNotNull(), F.col("_after")) \
        .when(F.col("seq") == F.lit(hi), F.col("_end"))
    return rows.withColumn("_broken", broken).withColumn("_tied", F.col("_broken").isNull()) \
        .select("*", "_broken.*").drop("_block", "_after", "_end", "_broken")


def _need_tree(lo: int | None, hi: int | None, block_rows: int, tree: AuditTree | None) -> None:
    if tree is None and lo is not None and (lo - 1) // block_rows != (hi - 1) // block_rows:
        raise ValueError("blocks of a log are tied by its recorded tree only: pass tree")


def verify(log: DataFrame, *, anchor_hash: str = GENESIS_HASH, hash_version: int | None = None,
           chain_by: str | None = None, block_rows: int = BLOCK_ROWS, tree: AuditTree | None = None,
           head: DataFrame | None = None) -> Verification:
    """``verify_chain_detail``: recompute every hash and check every link,
    starting from the purge anchor. First violation = earliest position; at
    one event a link mismatch is reported before a hash mismatch. A NULL hash
    or link is a violation. Each row is checked by its own ``hash_version``
    (or by the one given).

    A log of more than one block needs its recorded ``tree`` (and takes the
    ``head`` from outside the log, where given). A block whose last hash is not
    the recorded one is a ``block_mismatch`` at the event after it, or at the
    log's last event; a tree that does not lead to its head is a
    ``tree_mismatch`` without an event, reported before all others; a recorded
    log of which nothing is left is a ``block_mismatch`` without an event.

    Version 1 recomputes hashes byte-compatibly with chains written by the
    original Python logger (Arrow-batched UDF, see ``functions/canonical.py``);
    it uses a ``timestamp_text`` column when the log has one."""
    stored_version = F.coalesce("hash_version", F.lit(HASH_VERSION)) if "hash_version" in log.columns \
        else F.lit(HASH_VERSION)
    log = log.withColumn("hash_version", F.lit(hash_version) if hash_version else stored_version)
    r = log.agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"),
                F.min("hash_version").alias("hv")).first()  # one small aggregate
    dense = r["n"] > 0 and r["hi"] - r["lo"] + 1 == r["n"]
    lo, old = r["lo"], r["hv"] == 1
    computed = link_hash(_row_body(), F.col("previous_hash"))
    if old:
        from ..functions.canonical import python_timestamp_text, reference_event_hash
        ts_text = F.col("timestamp_text") if "timestamp_text" in log.columns \
            else python_timestamp_text(F.col("timestamp"))
        v1 = reference_event_hash(F.col("event_id"), F.col("event_type"), ts_text, F.col("actor"), F.col("action"),
                                  F.col("resource"), F.col("details"), F.col("previous_hash"))
        computed = F.when(F.col("hash_version") == 1, v1).otherwise(computed)
    # every hash is recomputed row-locally first; only narrow columns then look for their predecessor
    narrow = log.select("seq", "event_id", "event_type", "previous_hash", "event_hash", "hash_version",
                        computed.alias("computed_hash"), *([chain_by] if chain_by else []))
    linked = _expected_links(narrow, single_chain=old, anchor_hash=anchor_hash, first_seq=lo, chain_by=chain_by,
                             block_rows=block_rows)
    if not old:
        _need_tree(lo, r["hi"], block_rows, tree)
    tied = tree is not None and lo is not None
    if tied:
        linked = _tie_blocks(linked, log, tree, r["hi"], chain_by, block_rows)
    rows = linked.select(
        "seq", "event_id", "event_type", "previous_hash", "event_hash", "expected_previous_hash",
        (F.col("previous_hash").eqNullSafe(F.col("expected_previous_hash")) & F.col("contiguous")).alias("is_linked"),
        "computed_hash", F.coalesce(F.col("computed_hash") == F.col("event_hash"), F.lit(False)).alias("hash_ok"),
        *((F.col("_tied").alias("block_ok"), "_expected", "_actual") if tied else
          (F.lit(True).alias("block_ok"), F.lit(None).cast("string").alias("_expected"),
           F.lit(None).cast("string").alias("_actual"))))
    bad = ~F.col("is_linked") | ~F.col("hash_ok") | ~F.col("block_ok")

    def by_kind(link, own, block):
        return F.when(~F.col("is_linked"), link).when(~F.col("hash_ok"), own).otherwise(block)
    first = rows.agg(
        F.min_by(F.struct(
            "seq", "event_id",
            by_kind(F.lit("prev_hash_mismatch"), F.lit("hash_mismatch"), F.lit("block_mismatch")).alias("violation"),
            by_kind(F.col("expected_previous_hash"), F.col("computed_hash"), F.col("_expected")).alias("expected"),
            by_kind(F.col("previous_hash"), F.col("event_hash"), F.col("_actual")).alias("actual")),
            F.when(bad, F.col("seq"))).alias("v"))
    rows = rows.drop("_expected", "_actual")
    # position of the violation in the (possibly purged or gapped) log: with
    # dense ids it is seq - min(seq); with gaps, count the rows before it
    if dense:
        located = first.select("v", (F.col("v.seq") - F.lit(lo)).alias("_idx"))
    else:
        pos = rows.join(first.select(F.col("v.seq").alias("_vseq")), F.col("seq") < F.col("_vseq")) \
            .agg(F.count(F.lit(1)).alias("_idx"))
        located = first.crossJoin(pos)  # 1 x 1 rows
    verdict = located.select(
        F.col("v").isNull().alias("valid"),
        F.when(F.col("v").isNotNull(), F.col("_idx")).alias("event_index"),
        F.col("v.event_id").alias("event_id"), F.col("v.violation").alias("violation"),
        F.col("v.expected").alias("expected"), F.col("v.actual").alias("actual"))
    if tree is not None:
        verdict = _with_record(verdict, log, tree, head, lo is None, block_rows, chain_by)
    return Verification(rows, verdict)


def _with_record(verdict: DataFrame, log: DataFrame, tree: AuditTree, head: DataFrame | None, empty: bool,
                 block_rows: int, chain_by: str | None) -> DataFrame:
    """The verdict of a log whose record itself may be broken, or all of whose events may be gone."""
    sound = audit_tree.broken_nodes(tree, head).agg(F.count(F.lit(1)).alias("_nodes"))
    lost = audit_tree.changed_blocks(log, tree, block_rows=block_rows, chain_by=chain_by).agg(
        F.count(F.lit(1)).alias("_lost")) if empty else sound.select(F.lit(0).alias("_lost"))
    j = verdict.crossJoin(sound).crossJoin(lost)  # one-row frames
    kind = F.when(F.col("_nodes") > 0, "tree_mismatch").when(F.col("_lost") > 0, "block_mismatch")
    fields = {c: F.when(kind.isNull(), F.col(c)) for c in ("event_index", "event_id", "expected", "actual")}
    return j.select((F.col("valid") & kind.isNull()).alias("valid"), fields["event_index"].alias("event_index"),
                    fields["event_id"].alias("event_id"), F.coalesce(kind, "violation").alias("violation"),
                    fields["expected"].alias("expected"), fields["actual"].alias("actual"))


def _fold_headers(seed: str):
    """Arrow fold over blocks in order: each header covers the one before it."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = seed
        for b in batches:
            prevs, hashes = [], []
            for text in b.column(b.schema.get_field_index("_text")).to_pylist():
                prevs.append(prev)
                prev = hashlib.sha256(f"{text}|{prev}".encode()).hexdigest()
                hashes.append(prev)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())],
                                             names=[*b.schema.names, "previous_header", "header_hash"])
    return fn


def block_headers(log: DataFrame, block_rows: int = BLOCK_ROWS, run_blocks: int = HEADER_RUN) -> DataFrame:
    """One row per block: its range, row count, last hash and leaf of the log's tree (``leaf_hash``),
    chained by ``header_hash = sha256(block | first_seq | last_seq | rows | block_hash |
    previous_header)`` from the genesis value. A chain folds one after another: runs of
    ``run_blocks`` blocks, each seeded with the last header of the run before, so no task
    holds more than a run."""
    spark = log.sparkSession
    text = F.concat_ws("|", "idx", "first_seq", "last_seq", "rows", "block_hash")
    run = F.floor(F.col("idx") / F.lit(run_blocks)).cast("long")
    blocks = stored(audit_tree._leaves(audit_tree.block_ends(log, block_rows)).select(
        F.col("idx").alias("block"), "first_seq", "last_seq", "rows", "block_hash",
        F.col("node_hash").alias("leaf_hash"), text.alias("_text"), run.alias("_run")), "headers")
    schema = _fold_schema(blocks, "previous_header", "header_hash")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/audit-headers-{uuid.uuid4().hex}"
    ends, prev = blocks.agg(F.min("_run").alias("lo"), F.max("_run").alias("hi")).first(), GENESIS_HASH
    if ends["lo"] is None:
        return blocks.withColumns({c: F.lit(None).cast("string") for c in ("previous_header", "header_hash")}) \
            .drop("_text", "_run")
    for n in range(ends["lo"], ends["hi"] + 1):
        part = blocks.where(F.col("_run") == n).coalesce(1).sortWithinPartitions("block")
        part.mapInArrow(_fold_headers(prev), schema).write.mode("append").parquet(base)
        last = spark.read.schema(schema).parquet(base).where(F.col("_run") == n).agg(F.max_by("header_hash", "block"))
        prev = last.first()[0] or prev  # a purge may have left nothing of a run
    return spark.read.schema(schema).parquet(base).drop("_text", "_run")


def chain_view(log: DataFrame, *, genesis: str = GENESIS_HASH, block_rows: int = BLOCK_ROWS,
               tree: AuditTree | None = None) -> DataFrame:
    """``v_audit_chain_verification``: the hash of the event before, in event
    order, and whether the row links to it; the first row must link to
    ``genesis`` (64 zeros, as the view does even after a purge; pass the
    anchor to check a purged log). As in the view, a NULL link is NULL. The
    first event of a block follows a block whose last hash is the one that the
    log's recorded ``tree`` holds, so a log of more than one block needs it."""
    lo, hi = log.agg(F.min("seq"), F.max("seq")).first()
    _need_tree(lo, hi, block_rows, tree)
    linked = _expected_links(
        log.select("seq", "event_id", "event_type", "timestamp", "actor", "action", "resource", "previous_hash",
                   "event_hash", "hash_version"),
        single_chain=False, anchor_hash=genesis, first_seq=lo, chain_by=None, block_rows=block_rows)
    whole = F.col("contiguous")
    if tree is not None and lo is not None:
        linked, whole = _tie_blocks(linked, log, tree, hi, None, block_rows), whole & F.col("_tied")
    return linked.withColumn("is_linked", (F.col("previous_hash") == F.col("expected_previous_hash")) & whole) \
        .drop("contiguous", "hash_version", "_opens", "_tied", "_expected", "_actual")


def chain_valid(view: DataFrame) -> DataFrame:
    return view.agg((F.count_if(~F.col("is_linked")) == 0).alias("chain_is_valid"))


def broken_links(view: DataFrame) -> DataFrame:
    """The view's broken rows, in event order."""
    return view.filter(~F.col("is_linked")).select("seq", "event_id", "event_type", "previous_hash",
                                                   "expected_previous_hash").orderBy("seq")


# -------------------------------------------------------------------- purge
class Purged(NamedTuple):
    log: DataFrame     # surviving events (ids unchanged)
    anchor: DataFrame  # one row: anchor_hash to verify the survivors from, next_seq to go on at
    tree: AuditTree | None = None  # the log's tree without the purged subtrees; its head is the old one


def purge(log: DataFrame, *, retention_days: int = 2555, as_of: str,
          previous_anchor: str = GENESIS_HASH, tree: AuditTree | None = None) -> Purged:
    """Retention: cutoff = as_of - retention; the first event at or after the
    cutoff and everything later stays (later rows stay even if older); the
    anchor becomes the hash of the last purged event. Given the log's ``tree``,
    the subtrees of purged blocks are cut off it."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(retention_days))
    b = log.agg(F.min(F.when(F.col("timestamp") >= cutoff, F.col("seq"))).alias("_first"),
                F.max("seq").alias("_max"))
    j = log.crossJoin(F.broadcast(b))  # one row
    keep = F.col("seq") >= F.coalesce(F.col("_first"), F.col("_max") + 1)
    kept = j.filter(keep).drop("_first", "_max")
    anchor = j.agg(F.coalesce(F.max_by(F.when(~keep, F.col("event_hash")), F.when(~keep, F.col("seq"))),
                              F.lit(previous_anchor)).alias("anchor_hash"),
                   (F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))
    if tree is not None:
        cut = b.select(F.coalesce(F.col("_first"), F.col("_max") + 1)).first()[0]
        tree = audit_tree.prune(tree, cut) if cut is not None else tree
    return Purged(kept, anchor, tree)


# ------------------------------------------------------------ query, export
def query(log: DataFrame, *, event_type: str | None = None, start: str | None = None, end: str | None = None,
          actor: str | None = None) -> DataFrame:
    """AND of optional filters; time bounds inclusive at both ends. The
    derived ``event_date`` predicate lets a partitioned table prune."""
    out = log
    if event_type is not None:
        out = out.filter(F.col("event_type") == event_type)
    if start is not None:
        out = out.filter((F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
                         & (F.col("event_date") >= F.lit(start[:10])))
    if end is not None:
        out = out.filter((F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
                         & (F.col("event_date") <= F.lit(end[:10])))
    if actor is not None:
        out = out.filter(F.col("actor") == actor)
    return out


#: A JSON string (kept) or a bare non-finite number (quoted).
_NON_FINITE = r'("(?:[^"\\]|\\.)*+")|(NaN|-?Infinity)'


def export_json(log: DataFrame) -> DataFrame:
    """One JSON object per event (JSON lines) with the 9 reference keys;
    ``details`` is embedded as JSON, not as a quoted string. Non-finite
    numbers at any depth become the strings "NaN", "Infinity", "-Infinity";
    a payload that is no JSON is embedded as a string."""
    # \\u0001 cannot stand in JSON text: it marks where a bare number was
    marked = F.regexp_replace(F.coalesce("details", F.lit("{}")), _NON_FINITE, "$1\u0001$2\u0001")
    labelled = F.regexp_replace(F.regexp_replace(marked, "\u0001(NaN|-?Infinity)\u0001", '"$1"'), "\u0001", "")
    listed = F.to_json(F.array("details"))
    quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
    details = F.coalesce(F.try_parse_json(labelled), F.try_parse_json(quoted))
    return log.select(F.to_json(F.struct(
        "event_id", "event_type", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        "actor", "action", "resource", details.alias("details"), "previous_hash", "event_hash")).alias("json"))


# --------------------------------------------------------- event builders
GATE_DETAILS = "struct<total_records:bigint,flagged:bigint,blocked:bigint,batch_anomaly_rate:double," \
               "baseline_mean:double,baseline_std:double>"


def gate_decision_events(verdicts: DataFrame, *, gate_name: Column | str, timestamp: Column | str,
                         actor: str = "gate_pipeline") -> DataFrame:
    """``log_gate_decision`` in bulk: one gate_decision event per verdict row
    (action ``gate_<decision>``, resource = gate name); the verdict numbers
    travel in ``details`` so the gate_decisions table can be derived from the
    log alone."""
    g = gate_name if isinstance(gate_name, Column) else F.lit(gate_name)
    ts = timestamp if isinstance(timestamp, Column) else F.lit(timestamp).cast("timestamp_ntz")
    return verdicts.select(
        F.lit("gate_decision").alias("event_type"), ts.alias("timestamp"), F.lit(actor).alias("actor"),
        F.concat(F.lit("gate_"), F.col("gate_decision")).alias("action"), g.alias("resource"),
        F.to_json(F.struct("total_records", "flagged", "blocked", "batch_anomaly_rate", "baseline_mean",
                           "baseline_std")).alias("details"))


def access_events(accesses: DataFrame, *, actor: str = "actor", resource: str = "resource",
                  timestamp: str = "timestamp", action: str | None = None,
                  keep_cols: list[str] | None = None) -> DataFrame:
    """``log_access``: event_type data_access, action defaults to ``read``;
    ``keep_cols`` (such as the append order's tie-breaker) stay."""
    act = F.col(action) if action else F.lit("read")
    return accesses.select(F.lit("data_access").alias("event_type"), F.col(timestamp).alias("timestamp"),
                           F.col(actor).alias("actor"), act.alias("action"), F.col(resource).alias("resource"),
                           F.lit("{}").alias("details"), *(keep_cols or []))


def access_log(log: DataFrame, *, sensitivity: Column | None = None, ip: Column | None = None) -> DataFrame:
    """``access_log`` sink rows: the data_access events."""
    return log.filter(F.col("event_type") == "data_access").select(
        "event_id", "timestamp", "actor", "action", "resource",
        (sensitivity if sensitivity is not None else F.lit(None).cast("string")).alias("sensitivity_level"),
        (ip if ip is not None else F.lit(None).cast("string")).alias("ip_address"), "event_hash")


def gate_decisions_table(log: DataFrame) -> DataFrame:
    """``gate_decisions`` sink rows: the gate_decision events of the log with
    the verdict numbers read back from ``details``; hashes link the table to
    the chain."""
    d = F.from_json("details", GATE_DETAILS)
    return log.filter(F.col("event_type") == "gate_decision").select(
        "event_id", "timestamp", F.col("resource").alias("gate_name"),
        F.regexp_replace("action", "^gate_", "").alias("decision"),
        d["total_records"].alias("record_count"), (d["flagged"] + d["blocked"]).alias("anomaly_count"),
        d["batch_anomaly_rate"].alias("anomaly_rate"), d["baseline_mean"].alias("baseline_mean"),
        d["baseline_std"].alias("baseline_std"), "previous_hash", "event_hash")



def reliable_log(log: DataFrame) -> DataFrame:
    """Freeze a freshly built log (its hashes came from a sequential fold)
    with a reliable checkpoint before deriving several results from it. The rows
    that ``audit_append`` returns lie there already and are not copied again."""
    from ..session import reliable_checkpoint
    return log if log.__dict__.get("_frozen") else reliable_checkpoint(log)
