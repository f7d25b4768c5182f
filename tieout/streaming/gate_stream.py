"""The stateless gate on a streaming DataFrame.

The reference has no streaming operators; scoring a record against a fixed
baseline is stateless, so it runs unchanged on a micro-batch stream as a
stream-static join. The baseline is computed once (batch) and broadcast:
global baselines are one row, segmented ones one row per segment, and the
caller states that the segment count is bounded by passing
``broadcast_baseline=True`` (otherwise Spark's size threshold decides).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import gate as G


def score_stream(stream: DataFrame, baseline: DataFrame, *, value_col: str = "value",
                 record_id_col: str = "record_id", segment_col: str | None = None,
                 params: G.GateParams = G.GateParams(), nan_policy: str = "pass",
                 broadcast_baseline: bool = False, keep_cols: list[str] | None = None) -> DataFrame:
    """Per-record decisions for a streaming (or batch) DataFrame against a
    precomputed ``gate.baseline`` frame. Its join is left to the optimizer;
    ``broadcast_baseline`` is for callers who know how many segments there are."""
    params.validate()
    keep = ["record_id", *(["segment"] if segment_col else []), *(keep_cols or [])]
    cur = stream.select(F.col(record_id_col).cast("string").alias("record_id"),
                        *([F.col(segment_col).alias("segment")] if segment_col else []),
                        *[F.col(c) for c in (keep_cols or [])],
                        F.col(value_col).cast("double").alias("_value"))
    b = F.broadcast(baseline) if broadcast_baseline else baseline
    if segment_col:
        b = b.withColumnRenamed(segment_col, "_seg") if segment_col in baseline.columns else b
        j = cur.join(b, cur["segment"].eqNullSafe(F.col("_seg")), "left") \
            .withColumn("is_valid", F.coalesce(F.col("is_valid"), F.lit(False)))
    else:
        j = cur.crossJoin(F.broadcast(baseline))  # one row
    return G._score(j, params, nan_policy, keep)


def write_anomalies(scored: DataFrame, path: str, checkpoint: str, *, ts_col: str | None = None,
                    ingested_at: str | None = None, trigger_once: bool = False) -> StreamingQuery:
    """Append FLAG/BLOCK rows to the partitioned ``zscore_anomalies`` table
    (exactly once through the checkpointed file sink)."""
    rows = G.anomalies_table(scored.filter(F.col("decision") != G.PASS), ts_col=ts_col,
                             ingested_at=ingested_at)
    w = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .partitionBy("observation_date").outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
