"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # Readings are stored in UTC; hour, month and day functions must agree with that.
    "spark.sql.session.timeZone": "UTC",
    # Partition folders hold zero-padded strings such as month=04.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where the next step then needs its own exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Folders are listed by so many tasks at most; by default a task lists one folder.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


def builder(app: str = "stationcast") -> SparkSession.Builder:
    """A session builder with the settings the operators assume."""
    b = SparkSession.builder.appName(app)
    for name, value in RUNTIME_CONF.items():
        b = b.config(name, value)
    return b


def tune(spark: SparkSession) -> SparkSession:
    """Apply the same settings to a session somebody else created."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder path for one run below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; without that setting there is none that all executors see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
