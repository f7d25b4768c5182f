"""Warehouse table writers: partitioned parquet with the layouts the
warehouse DDL describes (date partitions, clustering by sort within files).

Writers append by default; each partition column is derived from the row,
so readers that filter on it prune whole directories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import LOG_COLUMNS

LAYOUTS = {
    # table: (partition column, clustering columns)
    "audit_log": ("event_date", ["event_type", "actor"]),
    "reconciliation_results": ("created_date", ["sensitivity_level", "match_status"]),
    "exceptions_queue": ("created_date", ["severity", "status"]),
    "zscore_anomalies": ("observation_date", ["decision", "segment"]),
    "gate_decisions": ("event_date", ["gate_name"]),
    "access_log": ("event_date", ["actor"]),
}


def with_partition(table: str, df: DataFrame) -> DataFrame:
    part, _ = LAYOUTS[table]
    if part in df.columns:
        return df
    src = {"created_date": "created_at", "event_date": "timestamp", "observation_date": "timestamp"}[part]
    return df.withColumn(part, F.date_format(src, "yyyy-MM-dd"))


def write_table(table: str, df: DataFrame, path: str, mode: str = "append") -> None:
    """Write one of the warehouse tables, partitioned by its date column and
    clustered inside files. Rows are range-partitioned on (date, cluster
    columns, row hash): the row hash makes every range boundary splittable,
    so a date holding a third of all rows is written by many tasks while
    each task still writes few, well-clustered files."""
    part, cluster = LAYOUTS[table]
    out = with_partition(table, df)
    if table == "audit_log":
        out = out.select(*LOG_COLUMNS)
    keys = [part, *[c for c in cluster if c in out.columns]]
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in out.columns])
    out.repartitionByRange(*keys, salt).sortWithinPartitions(*keys) \
        .write.mode(mode).partitionBy(part).parquet(path)

