"""Data skipping for the audit log: an index of its extents.

The log lies in a table partitioned by ``extent``, a stretch of ``extent_rows``
consecutive events. An append of more than ``FOLDERS`` extents puts neighbouring
ones into one folder, named by the first, of ``FILE_ROWS`` to ``EXTENT_ROWS`` rows,
so small extents do not become a folder and a file each. Beside the log lie two small
tables, both made with each append:

* ``ranges``: the least and greatest timestamp and seq of an extent, and its folder;
* ``filters``: a Bloom filter of the extent's actors as sparse 64-bit words, one row
  per (extent, word). Its bits are ``hashes`` positions per actor out of ``bits``.

An append adds rows to both and reads nothing old: rows of one extent merge by
minimum, maximum and bitwise or. The index is written before the log, so what a
failed append leaves behind makes an extent look larger at worst, never smaller.

``query`` and ``retained`` first find the extents that can hold a match, then read
those partitions only and apply the exact filter of ``audit.query`` or
``audit.purge``: rows are the same as without the index. Up to ``LISTED`` folders
are named in the partition filter (so their number is checked before it reaches
the driver); more are met by a join on the folder within their range.

Defined results: a NULL actor or timestamp matches no filter and is not indexed; an
empty log has no extents.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from . import audit

EXTENT_ROWS = 256 * audit.BLOCK_ROWS
BITS, HASHES = 1 << 17, 4
LISTED = 10_000
#: Extents of one append that have a folder each; of more, neighbours share one.
FOLDERS = 256
#: Rows of an extent that are not spread over several files.
FILE_ROWS = EXTENT_ROWS // 16


class IndexedLog(NamedTuple):
    path: str
    extent_rows: int = EXTENT_ROWS
    bits: int = BITS
    hashes: int = HASHES


def _extent(at: IndexedLog) -> Column:
    return F.floor((F.col("seq") - 1) / F.lit(at.extent_rows)).cast("long")


def _positions(at: IndexedLog, actor: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), actor), F.lit(at.bits)) for i in range(at.hashes)])


def append(at: IndexedLog, log: DataFrame) -> None:
    """Add the freshly appended events ``log`` (stored, as ``audit.reliable_log`` does) to the table."""
    rows = log.withColumn("extent", _extent(at))
    spans = stored(rows.groupBy("extent").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time")), "spans")
    lo, hi = spans.agg(F.min("extent"), F.max("extent")).first()
    shared = 1
    if lo is not None and hi - lo >= FOLDERS:
        least = max(-(-(hi - lo + 1) // FOLDERS), -(-FILE_ROWS // at.extent_rows))
        shared = max(1, min(least, EXTENT_ROWS // at.extent_rows))
    folder = F.floor(F.col("extent") / F.lit(shared)) * F.lit(shared)
    spans.withColumn("folder", folder).write.mode("append").parquet(f"{at.path}/ranges")
    actors = rows.where("actor IS NOT NULL").select("extent", "actor").distinct()
    bit = F.explode(_positions(at, F.col("actor"))).alias("at")
    words = actors.select("extent", bit).groupBy("extent", F.floor(F.col("at") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
    # look-ups name few words of all extents: files hold ranges of words
    words.repartitionByRange("word", "extent").sortWithinPartitions("word", "extent") \
        .write.mode("append").parquet(f"{at.path}/filters")
    # one file per task and folder; rows of a large extent are spread by seq, not put into one task, and a small
    # one stays whole: files would be many and hold a few rows each
    parts = F.floor((F.col("seq") - 1) / F.lit(max(at.extent_rows // 16, FILE_ROWS)))
    rows.withColumn("extent", folder).repartition("extent", parts).sortWithinPartitions("extent", "seq") \
        .write.mode("append").partitionBy("extent").parquet(f"{at.path}/log")


def ranges(spark: SparkSession, at: IndexedLog) -> DataFrame:
    """One row per extent: first_seq, last_seq, first_time, last_time."""
    return spark.read.parquet(f"{at.path}/ranges").groupBy("extent").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
        F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))


def actor_extents(spark: SparkSession, at: IndexedLog, actor: str) -> DataFrame:
    """Extents whose Bloom filter holds ``actor``."""
    places = spark.range(1).select(_positions(at, F.lit(actor))).first()[0]
    wanted: dict[int, int] = {}
    for p in places:
        wanted[p // 64] = wanted.get(p // 64, 0) | 1 << p % 64
    probe = spark.createDataFrame([(w, m - (1 << 64) if m >> 63 else m) for w, m in wanted.items()],
                                  "word int, mask long")  # at most ``hashes`` rows
    rows = spark.read.parquet(f"{at.path}/filters").where(F.col("word").isin(list(wanted)))
    held = rows.join(F.broadcast(probe), "word").groupBy("extent", "word", "mask").agg(F.bit_or("bits").alias("bits"))
    return held.where("(bits & mask) = mask").groupBy("extent").agg(F.count(F.lit(1)).alias("c")) \
        .where(F.col("c") == len(wanted)).select("extent")


def candidate_extents(spark: SparkSession, at: IndexedLog, *, start: str | None = None, end: str | None = None,
                      actor: str | None = None) -> DataFrame:
    """Extents that can hold a row of the query."""
    r = ranges(spark, at)
    if start is not None:
        r = r.where(F.col("last_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        r = r.where(F.col("first_time") <= F.lit(end).cast("timestamp_ntz"))
    out = r.select("extent")
    return out if actor is None else out.join(actor_extents(spark, at, actor), "extent", "left_semi")


def _folders(spark: SparkSession, at: IndexedLog) -> DataFrame:
    """The folders of every extent: one, or more where appends of different sizes have filled it."""
    return spark.read.parquet(f"{at.path}/ranges").select("extent", "folder").distinct()


def _read(spark: SparkSession, log: DataFrame, at: IndexedLog, extents: DataFrame, listed: int) -> DataFrame:
    extents = _folders(spark, at).join(extents, "extent", "left_semi").select(F.col("folder").alias("extent")).distinct()
    named = [r[0] for r in extents.limit(listed + 1).collect()]
    if len(named) <= listed:
        return log.where(F.col("extent").isin(named)) if named else log.where(F.lit(False))
    lo, hi = extents.agg(F.min("extent"), F.max("extent")).first()
    return log.where(F.col("extent").between(lo, hi)).join(extents, "extent", "left_semi")


def _log(spark: SparkSession, at: IndexedLog, schema) -> DataFrame:
    """The stored log, listed once. Its columns come from one file's footer unless the caller knows them."""
    from pyspark.sql import types as T
    if schema is not None:
        own = T.StructType([*schema.fields, T.StructField("extent", T.LongType())])
        return spark.read.schema(own).parquet(f"{at.path}/log")
    return spark.read.parquet(f"{at.path}/log").withColumn("extent", F.col("extent").cast("long"))


def query(spark: SparkSession, at: IndexedLog, *, event_type: str | None = None, start: str | None = None,
          end: str | None = None, actor: str | None = None, schema=None, listed: int = LISTED) -> DataFrame:
    """``audit.query`` over the stored log, reading the extents that can match only."""
    extents = candidate_extents(spark, at, start=start, end=end, actor=actor)
    rows = _read(spark, _log(spark, at, schema), at, extents, listed)
    return audit.query(rows, event_type=event_type, start=start, end=end, actor=actor).drop("extent")


def retained(spark: SparkSession, at: IndexedLog, *, retention_days: int = 2555, as_of: str,
             schema=None) -> DataFrame:
    """The rows that ``audit.purge`` keeps. The first event at or after the cutoff lies in the first extent
    whose last time reaches it: that extent alone is searched, and earlier ones are not read."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(retention_days))
    first = ranges(spark, at).where(F.col("last_time") >= cutoff).agg(F.min("extent")).first()[0]
    log = _log(spark, at, schema)
    if first is None:
        return log.where(F.lit(False)).drop("extent")
    where = _folders(spark, at)
    own = [r[0] for r in where.where(F.col("extent") == first).select("folder").collect()]  # few: one per append that filled it
    start = where.where(F.col("extent") >= first).agg(F.min("folder")).first()[0]
    seq = log.where(F.col("extent").isin(own) & (_extent(at) == first) & (F.col("timestamp") >= cutoff)) \
        .agg(F.min("seq")).first()[0]
    return log.where((F.col("extent") >= start) & (F.col("seq") >= seq)).drop("extent")
