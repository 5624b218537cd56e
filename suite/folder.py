"""The shared work folder of sessions on one machine."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def with_folder(spark: SparkSession) -> SparkSession:
    """Set ``spark.checkpoint.dir`` where a local session names none. A cluster has to name a shared folder itself."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stationcast-"))
    return spark
