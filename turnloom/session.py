"""Session set-up and the two helpers every multi-step operator needs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "turnloom", cpus: str | int = "*", partitions: int | None = None) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    n = partitions or (8 if cpus == "*" else int(cpus))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TURNLOOM_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a private one only in a local session without one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="turnloom-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor does not replay the loop."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unsent(df: DataFrame) -> DataFrame:
    """A side of an equi-join that no task or driver gets as a whole: both sides are shuffled and sorted.

    Without it Spark sends a side to all that it takes for small, and it sizes Parquet by its compressed
    bytes and rows behind an explode as if there were one for each row before.
    """
    return df.hint("merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table stored in fewer files than there are cores, spread over them by a unique key.

    For work that costs much more than reading. Tables of many files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df
