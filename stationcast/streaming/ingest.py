"""Hourly ingest as a stream: upsert each micro-batch, then forecast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stationcast.functions import drop_nan
from stationcast.operators.features import Medians
from stationcast.operators.scoring import Forecaster, latest_forecast, persistence
from stationcast.operators.upsert import upsert_table
from stationcast.schemas import BRONZE_HOURLY, POLLUTANTS, READING, SILVER, WARM_LOOKBACK_HOURS
from stationcast.sinks.tables import append_predictions
from stationcast.sources.tables import read_silver

# Columns that tell which of two deliveries of a reading is the newer one.
DELIVERY = {"_delivered": "file_modification_time", "_file": "file_path", "_row": "row_index"}
NEWEST_FIRST = [f"-{c}" for c in DELIVERY]


def new_readings(
    spark: SparkSession, root: str, schema: StructType = BRONZE_HOURLY, files_per_batch: int = 1000, glob: str | None = None
) -> DataFrame:
    """Bronze files as a stream; each file is taken once.

    The place of every row rides along: when its file was written, which file, which row.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    place = [F.col(f"_metadata.{of}").alias(name) for name, of in DELIVERY.items()]
    return reader.parquet(root).select("*", *place)


def as_reading(rows: DataFrame, source: str = "hourly") -> DataFrame:
    """Bronze columns to silver columns with the lineage value (P10)."""
    place = [c for c in DELIVERY if c in rows.columns]
    return rows.select(
        *place,
        *[F.lit(source).alias(f.name) if f.name == "source" else F.col(f.name).cast(f.dataType) for f in READING.fields]
    ).withColumns({c: drop_nan(c) for c in POLLUTANTS})


def upsert_stream(
    stream: DataFrame,
    silver_path: str,
    checkpoint: str,
    gold_path: str | None = None,
    forecast: Forecaster = persistence,
    medians: Medians | None = None,
    hours: int = WARM_LOOKBACK_HOURS,
    to_reading: Callable[[DataFrame], DataFrame] = as_reading,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Merge every micro-batch into silver (R2) and, with ``gold_path``, append forecasts.

    Of several deliveries of a reading in one batch the newest wins, as it does across batches, so the size
    of a batch changes nothing. Both steps are keyed, so a batch that is run again after a failure changes nothing. Lags are not
    kept as stream state: the last rows of the touched series are read back from silver, which also
    takes late rows into account (R6).
    """

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = to_reading(batch).persist()
        try:
            newest = rows.agg(F.max("timestamp")).first()[0]
            if newest is None:
                return
            placed = set(DELIVERY) <= set(rows.columns)
            upsert_table(spark, silver_path, rows, SILVER, source_order=NEWEST_FIRST if placed else None)
            if gold_path is not None:
                touched = rows.select("city_slug").distinct()
                recent = read_silver(spark, silver_path, hours=hours, as_of=newest)
                made = latest_forecast(recent.join(touched, "city_slug", "left_semi"), forecast, medians)
                append_predictions(spark, made, gold_path)
        finally:
            rows.unpersist()

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drop_repeats(stream: DataFrame, keys: tuple[str, ...] = ("city_slug", "timestamp"), delay: str = "2 hours") -> DataFrame:
    """Drop repeated readings that arrive within ``delay`` of each other.

    Off unless asked for: it bounds the state, and the keyed upsert already makes repeats harmless.
    """
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(keys))


__all__ = ["as_reading", "drop_repeats", "new_readings", "upsert_stream"]
