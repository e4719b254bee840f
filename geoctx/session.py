"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "geoctx", master: str | None = None, partitions: int | None = None, scratch: str | None = None) -> SparkSession:
    """A session with the settings the operators rely on (adaptive plans, UTC, Arrow).

    ``scratch`` is the shared folder for intermediate tables, where the cluster does not name one itself.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the cluster's shared folder, read back.

    An iterative job stays short this way and outlives its executors. A table is used and not
    ``checkpoint()``, because a checkpointed plan keeps the size estimate of the plan it replaces: joins
    multiply estimates, so after some rounds planning alone takes minutes, while a table has its true size.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, in the folder every executor can reach.

    The folder is the session's ``spark.checkpoint.dir``. The local temporary folder serves only a local
    master with the setting unset, as in tests; a cluster without the setting is refused, because a
    machine-local folder would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/geoctx-{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of fewer tasks than cores, dealt out to all cores before a step that multiplies its rows.

    For plain scans. A table with tasks enough is left alone: a shuffle would only cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
