"""Where two datasets differ: row hashes kept by key range under a tree of sums.

``keep`` writes, once per dataset, the row hashes by bucket (a hash of the key) and
a tree over the buckets: a node holds the row count and the sums of two 60-bit lanes
of its rows' SHA-256, so a parent is the sum of its children and the top node is
``checks.fingerprint`` of the dataset. ``differing_buckets`` goes down two trees from
the top and opens children of unequal nodes only. ``differences`` then reads the
hashes of those buckets (partition pruning) and names each row that one side holds
more often than the other. Equal data cost one comparison of two top nodes.

Plans: rows meet one partial aggregate by (key, hash), so a hot key or a mass
duplicate shrinks before it moves. Trees have at most ``buckets`` leaves, a
parameter. Unequal trees (another ``buckets``) are refused.

Defined results: NULL keys are keys; a repeated row counts as often as it stands; an
empty dataset differs from every row of the other.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import row_hash

BUCKETS, FANOUT = 4096, 16


class Kept(NamedTuple):
    path: str
    key_cols: tuple[str, ...]
    buckets: int = BUCKETS
    fanout: int = FANOUT

    @property
    def levels(self) -> int:
        n = 0
        while self.fanout ** n < self.buckets:
            n += 1
        return n


_SUMS = ("n", "lane1", "lane2")


def _bucket(at: Kept) -> Column:
    # keys of another type on the other side must fall into the same bucket: their text decides
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0001")) for c in at.key_cols]
    return F.pmod(F.xxhash64(*text), F.lit(at.buckets)).cast("int")


def keep(df: DataFrame, at: Kept, cols: list[str], **kw) -> None:
    """Write the row hashes of ``cols`` and their tree below ``at.path`` (a new folder)."""
    per_row = df.select(*[F.col(f"`{c}`") for c in at.key_cols], row_hash(df, cols, **kw).alias("row_hash")) \
        .groupBy(*[f"`{c}`" for c in at.key_cols], "row_hash").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("bucket", _bucket(at))
    # the second column spreads a bucket whose key holds many different rows
    per_row.repartition("bucket", F.substring("row_hash", 1, 1)).sortWithinPartitions("bucket") \
        .write.partitionBy("bucket").parquet(f"{at.path}/rows")
    rows = df.sparkSession.read.schema(per_row.schema).parquet(f"{at.path}/rows")
    lane = lambda a: F.conv(F.substring("row_hash", a, 15), 16, 10).cast("decimal(20,0)") * F.col("n")
    leaves = rows.groupBy("bucket").agg(F.sum("n").alias("n"), *[
        F.sum(lane(a)).cast("decimal(38,0)").alias(c) for c, a in (("lane1", 1), ("lane2", 16))])
    step = F.explode(F.sequence(F.lit(0), F.lit(at.levels))).alias("level")
    node = F.expr(f"CAST(bucket DIV CAST(pow({at.fanout}, level) AS INT) AS INT)").alias("node")
    leaves.select("*", step).groupBy("level", node).agg(
        *[F.sum(c).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in _SUMS]) \
        .coalesce(1).write.parquet(f"{at.path}/tree")  # at most ``buckets`` leaves


def tree(spark: SparkSession, at: Kept) -> DataFrame:
    return spark.read.schema("level int, node int, n long, lane1 decimal(38,0), lane2 decimal(38,0)") \
        .parquet(f"{at.path}/tree")


def differing_buckets(spark: SparkSession, a: Kept, b: Kept) -> list[int]:
    """Buckets whose hashes differ, found from the top: one step per level."""
    if (a.buckets, a.fanout) != (b.buckets, b.fanout):
        raise ValueError("the two trees have other buckets or another fanout")
    one, two = tree(spark, a), tree(spark, b)
    unequal = [0]  # the top node
    for level in range(a.levels, -1, -1):
        near = (F.col("level") == level) & F.col("node").isin(unequal)
        left = one.where(near).select("node", F.struct(*_SUMS).alias("a"))
        right = two.where(near).select("node", F.struct(*_SUMS).alias("b"))
        found = left.join(right, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect()
        unequal = sorted(r[0] for r in found)
        if not unequal or level == 0:
            return unequal
        unequal = [u * a.fanout + i for u in unequal for i in range(a.fanout)]
    return unequal


def differences(spark: SparkSession, a: Kept, b: Kept, key_schema: str) -> DataFrame:
    """Key columns, row_hash and ``surplus`` of every row that ``a`` (above 0) or ``b`` (below 0) holds
    more often. ``key_schema`` names the key columns with their types, such as ``txn_id string``."""
    if a.key_cols != b.key_cols:
        raise ValueError("the two datasets were kept by other keys")
    buckets = differing_buckets(spark, a, b)
    sides = [spark.read.schema(f"{key_schema}, row_hash string, n long, bucket int").parquet(f"{at.path}/rows")
             .where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
             .select(*[f"`{c}`" for c in at.key_cols], "row_hash", (F.col("n") * sign).alias("n"))
             for at, sign in ((a, 1), (b, -1))]
    return sides[0].unionByName(sides[1]).groupBy(*[f"`{c}`" for c in a.key_cols], "row_hash").agg(
        F.sum("n").alias("surplus")).where("surplus <> 0")
