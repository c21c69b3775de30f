"""Session settings the jobs are written for, and the shared work folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split in a join even when that costs one more shuffle after it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Windows over (key, slice) must be spread on both columns even when the input is already spread on the key.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "slidewatch", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """Sets the settings above on a session that was made elsewhere. All times of the data model are UTC."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)


def shared_root(checkpoint: str | None, warehouse: str, master: str) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one inside the warehouse folder, but never one that
    only the driver's machine sees while executors run on others."""
    if checkpoint:
        return checkpoint
    local = warehouse.startswith("file:") or "://" not in warehouse
    if local and not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/slidewatch-work"


def work_root(spark: SparkSession) -> str:
    """``shared_root`` of the session, also set as its checkpoint folder where none is."""
    root = shared_root(
        spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
    )
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever deleted or reused."""
    return os.path.join(work_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate for the optimized plan (file sizes for scans); runs no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


SCAN_SPLIT_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spreads a small input over all cores before costly per-row work.

    An input below one scan split per core cannot fill the cluster by itself; a larger one is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if size_in_bytes(df) < cores * SCAN_SPLIT_BYTES else df
