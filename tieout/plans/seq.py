"""Positional primitives built from range partitioning.

Spark has no row order, and a window without PARTITION BY moves every row
into one task. These helpers get global positions instead from a
range-partitioned, locally sorted copy that is stored in the checkpoint
folder (so every later pass sees the same partitions):

* ``ordered_blocks``: sorted copy + per-row (partition, local index) and a
  tiny per-partition frame (one row per partition, so its size is bounded
  by the partition count and safe to broadcast).
* ``dense_sequence``: 1-based global position = partition offset + local index.
* ``global_positions``: 0-based position after the range sort.
* ``lag_over``: the previous row's value in a global order (LAG without a
  single-partition window): in-partition shift in Arrow batches plus a
  boundary fix-up from the previous non-empty partition.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

_PID, _MID = "_pid", "_mid"


def join_groups(rows: DataFrame, per_group: DataFrame, group_cols: list[str], how: str = "inner") -> DataFrame:
    """Join a frame of one row per group on its group columns, NULL groups included."""
    of = per_group.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(group_cols)})
    on = [F.col(f"`{c}`").eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(group_cols)]
    return rows.join(of, reduce(Column.__and__, on), how).drop(*[f"_of_{i}" for i in range(len(group_cols))])


def _sorted_parts(df: DataFrame, order_cols: list[str | Column], num_partitions: int | None) -> DataFrame:
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_df = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    return sorted_df.select("*", F.spark_partition_id().alias(_PID), F.monotonically_increasing_id().alias(_MID))


def ordered_blocks(df: DataFrame, order_cols: list[str | Column],
                   num_partitions: int | None = None) -> DataFrame:
    """Range-partition + sort by ``order_cols`` and freeze (partition, id).

    Returns the stored frame with ``_pid`` and ``_mid`` (a
    ``monotonically_increasing_id``: partition << 33 | local index).
    """
    return stored(_sorted_parts(df, order_cols, num_partitions), "blocks")


def _partition_offsets(blocks: DataFrame) -> DataFrame:
    """(pid, first_mid, offset): rows before each partition. One row per
    partition; the window runs over that tiny frame only."""
    per = blocks.groupBy(_PID).agg(F.count(F.lit(1)).alias("_n"), F.min(_MID).alias("_first_mid"))
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(_PID, "_first_mid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))


def dense_sequence(df: DataFrame, order_cols: list[str | Column], *, name: str = "seq",
                   start: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Add a dense 1-based (or ``start``-based) position in ``order_cols``
    order. The order must be unique (add a tie-breaker) for a stable result."""
    pos = global_positions(ordered_blocks(df, order_cols, num_partitions))
    return pos.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_pos") + F.lit(start)).alias(name))


def global_positions(blocks: DataFrame, name: str = "_pos") -> DataFrame:
    """0-based global position of every row of ``ordered_blocks`` output:
    partition offset (tiny broadcast frame) + index inside the partition."""
    offs = _partition_offsets(blocks)
    j = blocks.join(F.broadcast(offs), _PID)  # bounded by the partition count
    return j.withColumn(name, F.col("_offset") + (F.col(_MID) - F.col("_first_mid"))) \
        .drop("_offset", "_first_mid")


# ---------------------------------------------------------------- LAG
def _arrow_lag(value_col: str, out_col: str, schema: T.StructType):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        first = True
        for b in batches:
            if b.num_rows == 0:
                continue
            col = b.column(b.schema.get_field_index(value_col))
            head = pa.array([carry], type=col.type)
            lagged = pa.concat_arrays([head, col.slice(0, b.num_rows - 1)])
            starts = [False] * b.num_rows
            if first:
                starts[0] = True
                first = False
            carry = col[b.num_rows - 1].as_py()
            yield pa.RecordBatch.from_arrays(
                list(b.columns) + [lagged, pa.array(starts, type=pa.bool_())],
                names=list(b.schema.names) + [out_col, "_part_first"])
    return fn


def lag_over(df: DataFrame, order_col: str, value_col: str, out_col: str = "lag_value",
             num_partitions: int | None = None) -> DataFrame:
    """``LAG(value_col) OVER (ORDER BY order_col)`` for a unique order column,
    without a single-partition window: range blocks, an in-partition shift
    (Arrow, no per-row Python) and a fix-up of each partition's first row
    from the last value of the previous non-empty partition (a frame of one
    row per partition, broadcast)."""
    parts = _sorted_parts(df, [order_col], num_partitions)
    vt = parts.schema[value_col].dataType
    out_schema = T.StructType(parts.schema.fields + [T.StructField(out_col, vt, True),
                                                     T.StructField("_part_first", T.BooleanType(), False)])
    # the shift runs in the stage that sorts; what is stored no longer depends on partitions
    shifted = stored(parts.mapInArrow(_arrow_lag(value_col, out_col, out_schema), out_schema), "lag")
    ends = shifted.groupBy(_PID).agg(F.min(order_col).alias("_first_key"),
                                    F.max_by(value_col, order_col).alias("_last_val"))
    w = Window.orderBy("_first_key")
    fix = ends.select(F.col("_first_key"), F.lag("_last_val").over(w).alias("_prev_last"))
    j = shifted.join(F.broadcast(fix), shifted[order_col] == fix["_first_key"], "left")
    lagged = F.when(F.col("_part_first"), F.col("_prev_last")).otherwise(F.col(out_col))
    return j.select(*[F.col(f"`{c}`") for c in df.columns], lagged.alias(out_col))


def dense_range(df: DataFrame, order_col: str) -> tuple[bool, int | None]:
    """(is the integral order column dense, its minimum): one small aggregate."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    if r["n"] == 0:
        return False, None
    return r["hi"] - r["lo"] + 1 == r["n"], r["lo"]


def lag_dense(df: DataFrame, order_col: str, value_col: str, out_col: str = "lag_value",
              dense: bool | None = None) -> DataFrame:
    """LAG over an integral order column, exact whatever the gaps.

    When the order column is dense (count == max - min + 1; one small
    aggregate decides unless the caller knows), the previous row is simply
    ``order - 1``: an equi-join on a unique key, fully parallel and
    skew-free, with no checkpoint and no Python. Otherwise (rows deleted,
    e.g. a tampered log) it falls back to ``lag_over``."""
    if dense is None:
        dense, _ = dense_range(df, order_col)
    if not dense:
        return lag_over(df, order_col, value_col, out_col)
    prev = df.select((F.col(order_col) + 1).alias("_next"), F.col(value_col).alias(out_col))
    return df.join(prev, F.col(order_col) == F.col("_next"), "left").drop("_next")


def group_row_number(df: DataFrame, group_cols: list[str], order_cols: list[str], *, name: str = "row_number",
                     num_partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)`` without a
    per-group window: one range sort by (group, order), global positions, and
    each group's first position from a partial aggregate (one row per group,
    joined back; AQE broadcasts it when small). A group holding a third of
    all rows is still numbered by many tasks. The order must be unique
    within a group."""
    pos = global_positions(ordered_blocks(df, [*group_cols, *order_cols], num_partitions))
    starts = pos.groupBy(*group_cols).agg(F.min("_pos").alias("_start"))
    j = join_groups(pos, starts, group_cols)
    return j.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_pos") - F.col("_start") + 1).alias(name))
