"""Session settings for clusters and for one machine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What the plans count on: run-time re-planning with split skewed joins, and partitions that fit in memory.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local(cores: int | None = None, app: str = "pairwright", **more: str) -> SparkSession:
    """A session on this machine; on a cluster, set ``SETTINGS`` and spark.checkpoint.dir (a shared folder) instead."""
    n = cores or os.cpu_count() or 4
    b = SparkSession.builder.master(f"local[{n}]").appName(app)
    own = SETTINGS | {"spark.sql.shuffle.partitions": str(2 * n), "spark.sql.files.maxPartitionBytes": "16m", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    for k, v in (own | more).items():
        b = b.config(k, v)
    return b.getOrCreate()
