"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def build_session(app: str = "segue", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings the jobs rely on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        # call-site capture per column expression makes large plans slow to build
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset and driver and executors are one process, a folder of the warehouse is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(df, *keys, tasks: int = 1):
    """Repartition before per-row work that is heavy for its bytes, into ``tasks`` at least; adaptive
    execution would otherwise merge such rows into few tasks by size."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, tasks)
    return df.repartition(n, *keys)
