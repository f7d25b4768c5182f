"""The audit log's authenticated tree: what ties its blocks together.

The log's hash chain starts anew in every block (``audit.py``), so blocks can be
written and checked in parallel. A tree of hashes over the blocks makes the log
one whole again:

* a leaf per block: ``sha256('leaf' | block | first_seq | last_seq | rows | block_hash)``
  with the hash of the block's last event (of the last event of every chain);
* an inner node per ``fanout`` nodes of the level below:
  ``sha256('node' | level | idx | rows | child hashes, in order)``;
* the head: one row with the number of levels and blocks, the last seq and the
  top node's hash. It is kept outside the log (in another store, or printed);
  whoever can rewrite the log cannot rewrite it.

``audit.verify`` recomputes each block's last hash from the log and compares it
with the recorded leaf, and ``broken_nodes`` recomputes the tree up to the
recorded head. So a block that was edited and hashed anew, a block or the end of
the log that was dropped, and events that were added outside the record all show.

Plans: every level is one grouping of the stored level below (partial sums, lists
of at most ``fanout`` hashes), so no task holds more than a node's children and the
number of steps, each of a plan of fixed size, is the logarithm of the number of blocks. ``extend`` reads the
new events and the nodes beside their path only. ``prune`` drops the subtrees
that a purge has emptied and keeps their tops: the old head still follows from
what is left.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

FANOUT = 64
NODE_COLUMNS = ["level", "idx", "first_seq", "last_seq", "rows", "block_hash", "node_hash", "pruned"]
_SCHEMA = ("level int, idx long, first_seq long, last_seq long, rows long, block_hash string, node_hash string, "
           "pruned boolean")


class AuditTree(NamedTuple):
    nodes: DataFrame  # one row per node; pruned: its children are gone
    head: DataFrame   # one row: levels, blocks, last_seq, root_hash, fanout


def _leaf_hash() -> Column:
    return F.sha2(F.concat_ws("|", F.lit("leaf"), "idx", "first_seq", "last_seq", "rows",
                              F.coalesce("block_hash", F.lit("~"))), 256)


def block_ends(log: DataFrame, block_rows: int, chain_by: str | None = None) -> DataFrame:
    """idx, first_seq, last_seq, rows and block_hash of every block, from the log."""
    block = F.floor((F.col("seq") - 1) / F.lit(block_rows)).cast("long").alias("idx")
    ranges = [F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("rows"),
              F.max_by("event_hash", "seq").alias("block_hash")]
    if chain_by is None:
        return log.groupBy(block).agg(*ranges)
    per_chain = log.groupBy(block, F.col(chain_by).cast("string").alias("_chain")).agg(*ranges)
    return per_chain.groupBy("idx").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("rows").alias("rows"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chain", "block_hash"))),
                                        lambda x: F.to_json(x)), "|"), 256).alias("block_hash"))


def _leaves(ends: DataFrame) -> DataFrame:
    return ends.select(F.lit(0).alias("level"), "idx", "first_seq", "last_seq", "rows", "block_hash",
                       _leaf_hash().alias("node_hash"), F.lit(False).alias("pruned"))


def _parents(children: DataFrame, level: int, fanout: int) -> DataFrame:
    """Nodes of ``level`` from all children of each."""
    parts = children.groupBy(F.floor(F.col("idx") / F.lit(fanout)).cast("long").alias("idx")).agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("rows").alias("rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "node_hash"))),
                                 lambda x: x["node_hash"]), "|").alias("_hashes"))
    return parts.select(F.lit(level).alias("level"), "idx", "first_seq", "last_seq", "rows",
                        F.lit(None).cast("string").alias("block_hash"),
                        F.sha2(F.concat_ws("|", F.lit("node"), F.lit(level), "idx", "rows", "_hashes"), 256)
                        .alias("node_hash"), F.lit(False).alias("pruned"))


def _levels(blocks: int, fanout: int) -> int:
    """Levels above the leaves; one top node covers all blocks."""
    n = 1
    while fanout ** n < blocks:
        n += 1
    return n


def _head(nodes: DataFrame, levels: int, blocks: int, fanout: int) -> DataFrame:
    top = nodes.where(F.col("level") == levels)
    return top.select(F.lit(levels).alias("levels"), F.lit(blocks).cast("long").alias("blocks"), "last_seq",
                      F.col("node_hash").alias("root_hash"), F.lit(fanout).alias("fanout"))


def build(log: DataFrame, *, block_rows: int, chain_by: str | None = None, fanout: int = FANOUT) -> AuditTree:
    """The tree of a whole log: call it with the append, before anyone else can write."""
    return extend(None, log, block_rows=block_rows, chain_by=chain_by, fanout=fanout)


def extend(tree: AuditTree | None, new_rows: DataFrame, *, block_rows: int, chain_by: str | None = None,
           open_block: DataFrame | None = None, fanout: int = FANOUT) -> AuditTree:
    """The tree after an append of ``new_rows``: their leaves and the nodes above
    them are made anew, from the nodes beside their path; the rest stays. A log
    of several chains needs the earlier rows of the block that was open
    (``open_block``), for the chains that the new rows do not go on with."""
    spark = new_rows.sparkSession
    old = tree.nodes if tree is not None else spark.createDataFrame([], _SCHEMA)
    if open_block is not None:
        columns = ["seq", "event_hash", *([chain_by] if chain_by else [])]
        ends = block_ends(open_block.select(columns).unionByName(new_rows.select(columns)), block_rows, chain_by)
        ends = ends.drop("first_seq", "rows").join(
            block_ends(new_rows, block_rows).select("idx", "first_seq", "rows"), "idx")
    else:
        ends = block_ends(new_rows, block_rows, chain_by)
    was = old.where(F.col("level") == 0).select("idx", F.col("first_seq").alias("_first"), F.col("rows").alias("_rows"))
    ends = ends.join(was, "idx", "left").select(
        "idx", F.coalesce("_first", "first_seq").alias("first_seq"), "last_seq",
        (F.col("rows") + F.coalesce("_rows", F.lit(0))).alias("rows"), "block_hash")
    changed = stored(_leaves(ends), "tree")
    last = changed.agg(F.max("idx")).first()[0]
    if last is None:
        return tree if tree is not None else AuditTree(old, _head(old, 1, 0, fanout))
    if tree is not None and tree.head.first()["fanout"] != fanout:
        raise ValueError("the tree was built with another fanout")
    levels = _levels(last + 1, fanout)
    # each level is stored, so the plan of a level starts at the level below and not at the log
    made = [changed]
    for level in range(1, levels + 1):
        path = made[-1]
        if tree is not None:
            parent = F.floor(F.col("idx") / F.lit(fanout)).cast("long")
            parents = path.select(parent.alias("_parent")).distinct()
            beside = old.where(F.col("level") == level - 1).withColumn("_parent", parent).join(
                parents, "_parent", "left_semi").join(path.select("idx"), "idx", "left_anti").select(NODE_COLUMNS)
            path = path.unionByName(beside)
        made.append(stored(_parents(path, level, fanout), "tree"))
    changed = reduce(DataFrame.unionByName, made)
    kept = old.join(changed.select("level", "idx"), ["level", "idx"], "left_anti").select(NODE_COLUMNS)
    nodes = stored(kept.unionByName(changed), "tree") if tree is not None else changed
    return AuditTree(nodes, _head(nodes, levels, last + 1, fanout))


def prune(tree: AuditTree, first_seq: int) -> AuditTree:
    """The tree after a purge of all events before ``first_seq``. The children of
    a node go if it holds nothing else, unless it holds the last block (an
    append goes on there). The head stays as it was."""
    head = tree.head.first()
    nodes = tree.nodes
    open_ = (F.col("last_seq") >= F.lit(first_seq)) | (F.col("last_seq") == F.lit(head["last_seq"]))
    opened = nodes.where(open_ & ~F.col("pruned")).select(
        (F.col("level") - 1).alias("level"), F.col("idx").alias("_parent"))
    parent = F.floor(F.col("idx") / F.lit(head["fanout"])).cast("long")
    kept = nodes.withColumn("_parent", parent).join(opened, ["level", "_parent"], "left_semi").unionByName(
        nodes.where(F.col("level") == head["levels"]).withColumn("_parent", parent))
    return AuditTree(stored(kept.withColumn("pruned", F.col("pruned") | ~open_).select(NODE_COLUMNS), "tree"), tree.head)


def broken_nodes(tree: AuditTree, head: DataFrame | None = None) -> DataFrame:
    """Nodes (level, idx) whose hash does not follow from what is below them, and
    the top node if it is not the one that the ``head`` kept outside the log
    records (given, or the tree's)."""
    head = (head if head is not None else tree.head).first()
    nodes = tree.nodes
    if head is None:
        return nodes.select("level", "idx")
    leaves = nodes.where((F.col("level") == 0) & ~F.col("pruned")).where(
        ~F.col("node_hash").eqNullSafe(_leaf_hash())).select("level", "idx")
    fanout = head["fanout"]
    below = nodes.withColumn("_up", F.col("level") + 1)
    made = below.groupBy(F.col("_up").alias("level"), F.floor(F.col("idx") / F.lit(fanout)).cast("long").alias("idx")).agg(
        F.sum("rows").alias("_rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "node_hash"))),
                                 lambda x: x["node_hash"]), "|").alias("_hashes"))
    made = made.select("level", "idx", F.sha2(F.concat_ws("|", F.lit("node"), "level", "idx", "_rows", "_hashes"), 256)
                       .alias("_made"))
    inner = nodes.where((F.col("level") > 0) & ~F.col("pruned")).join(made, ["level", "idx"], "left").where(
        ~F.col("node_hash").eqNullSafe(F.col("_made"))).select("level", "idx")
    spark: SparkSession = nodes.sparkSession
    top = spark.createDataFrame([(head["levels"], 0, head["root_hash"])], "level int, idx long, root_hash string")
    tops = top.join(nodes.select("level", "idx", "node_hash"), ["level", "idx"], "left").where(
        ~F.col("node_hash").eqNullSafe(F.col("root_hash"))).select("level", "idx")
    return leaves.unionByName(inner).unionByName(tops).distinct()


def changed_blocks(log: DataFrame, tree: AuditTree, *, block_rows: int, chain_by: str | None = None) -> DataFrame:
    """Blocks whose end is not the recorded one: block, expected and actual hash
    of the last event (NULL: the block is not recorded, or nothing of it is
    left), and the recorded last seq. Blocks that a purge has emptied are none."""
    now = block_ends(log, block_rows, chain_by).select(
        "idx", F.col("last_seq").alias("_last"), F.col("block_hash").alias("actual"))
    first = F.broadcast(log.agg(F.min("seq").alias("_first_left")))  # one row
    leaves = tree.nodes.where(F.col("level") == 0).crossJoin(first).where(
        ~(F.col("pruned") | F.coalesce(F.col("last_seq") < F.col("_first_left"), F.lit(False))))
    both = leaves.select("idx", "last_seq", F.col("block_hash").alias("expected")).join(now, "idx", "full")
    return both.where(~(F.col("last_seq").eqNullSafe(F.col("_last")) & F.col("expected").eqNullSafe(F.col("actual")))) \
        .select(F.col("idx").alias("block"), "expected", "actual", "last_seq")
