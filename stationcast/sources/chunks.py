"""Back-fill plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def chunk_plan(ranges: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """Cut each row's time range into pieces of ``days``; the last piece ends where the range ends.

    An empty range gives no piece.
    """
    step = F.make_dt_interval(days=F.lit(days))
    starts = F.sequence(F.col(start), F.col(end) - F.make_dt_interval(secs=F.lit(0.000001)), step)
    return (
        ranges.where(F.col(start) < F.col(end))
        .withColumn("chunk_start", F.explode(starts))
        .withColumn("chunk_end", F.least(F.col("chunk_start") + step, F.col(end)))
    )
