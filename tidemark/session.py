"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def build_session(app_name: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the plans rely on: adaptive execution, skew-join splitting, UTC.

    Unless set, the number of shuffle partitions follows the cluster: three per core, so that the fact's
    shuffle fits in memory on large clusters. Adaptive execution merges them again where they are small.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        # Call-site capture costs several round trips to the JVM per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.getConf().contains(SHUFFLE_PARTITIONS):
        spark.conf.set(SHUFFLE_PARTITIONS, str(max(200, 3 * spark.sparkContext.defaultParallelism)))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            configured = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written and read back in one run."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
