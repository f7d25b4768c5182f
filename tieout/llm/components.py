"""Connected components of an edge table (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _pointed(edges: DataFrame) -> DataFrame:
    """(u, v, m): both directions of every edge with the smallest neighbour m of u (u included).
    The minimum is a partial aggregate, so the neighbours of a hub never meet in one task."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges(u, v)`` of long ids; root is the smallest node of the component.

    Each round's edges are written to the shared scratch folder. The rounds go on
    until nothing changes; their number is logarithmic.
    """
    now = written(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u"))
                  .distinct(), "edges")
    state = None
    while True:
        large = _pointed(now).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root")).distinct()
        state = seen
