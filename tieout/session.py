"""Session helpers: building a local session for tests / bench and
resolving the shared checkpoint folder the cluster names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "tieout",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session used by tests and bench. On a cluster, callers pass their own
    session instead; nothing in the library requires this one."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.retainedJobs", "100")
        .config("spark.ui.retainedStages", "100")
        .config("spark.ui.retainedTasks", "2000")
        .config("spark.sql.ui.retainedExecutions", "50")
        .config("spark.sql.ansi.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    file system path). Only when nothing is configured (local tests) do we
    create one under the system temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="tieout-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df, name: str = "part"):
    """Write ``df`` as parquet into the shared checkpoint folder and read it
    back: cuts the lineage (files any executor can read, so a lost executor
    costs nothing) and lets later passes read single columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tieout-{name}-{uuid.uuid4().hex}"
    void = {c: df[f"`{c}`"].cast("string") for c, kind in df.dtypes if kind == "void"}  # parquet has no void
    out = df.withColumns(void) if void else df
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def reliable_checkpoint(df):
    """Cut lineage with files in the shared checkpoint folder."""
    return stored(df, "checkpoint")
