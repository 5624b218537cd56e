"""Forecasts and readings joined as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def predicted_vs_actual_stream(
    predictions: DataFrame, readings: DataFrame, key: str = "city_slug", delay: str = "2 hours"
) -> DataFrame:
    """The batch join ``joins.predicted_vs_actual`` over two streams, in whichever order their rows arrive.

    Of repeated forecasts for one hour the newest counts, so an hour is settled when the forecasts' watermark has
    passed it; then the reading at exactly that hour is awaited or, if it came first, found. Both sides keep rows only
    until the slower stream's watermark passes them: ``delay`` is how late a row of either may come. Readings that
    come again with the same time count once, the first. Null keys and times match nothing.
    """
    parts = ["as_of", "predicted", "confidence"]
    made = predictions.where(F.col(key).isNotNull() & F.col("forecast_for").isNotNull()).withWatermark("forecast_for", delay)
    # As in the batch join: the newest moment, then the larger class and confidence; nulls rank lowest.
    rank = F.struct(*parts)
    newest = made.groupBy(key, "forecast_for").agg(F.max_by(F.struct(*parts[1:]), rank).alias("_made"))
    known = readings.where(F.col(key).isNotNull() & F.col("timestamp").isNotNull()).withWatermark("timestamp", delay)
    truth = known.dropDuplicatesWithinWatermark([key, "timestamp"]).select(F.col(key).alias("_key"), "timestamp", F.col("aqi").alias("actual"))
    same = (F.col(key) == F.col("_key")) & (F.col("forecast_for") == F.col("timestamp"))
    return newest.join(truth, same).select(key, "forecast_for", "_made.predicted", "_made.confidence", "actual")


def write_joined(joined: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append settled rows to a table of files."""
    return (
        joined.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
