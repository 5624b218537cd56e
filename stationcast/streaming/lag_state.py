"""Forecasts from keyed stream state: the last rows of every series, kept by the stream itself (R6, opt-in).

``upsert_stream`` reads the last rows of the touched series back from silver. Here each series keeps its newest
``KEPT`` readings as a list state, so that a forecast needs no table. A reading that is late goes to its place
among them, one that comes again replaces the old one, one older than all of them changes nothing: the
rows are the same as those of the look-back read, and so are the forecasts.

State per series is ``KEPT`` rows at most, however many readings a batch holds for it. A series that stays silent for
``quiet`` loses its state: its rows have that time to live, and a timer, set for a new series and set again while it
finds rows alive, clears what is left. The state needs the RocksDB store; streams are started with it.

Of several deliveries of a reading in one batch the newest wins by the columns of ``DELIVERY`` where they are
there, else the last row; across batches the later batch wins. Rows without key or time are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from stationcast.operators.features import LOOK_BACK, Medians
from stationcast.operators.scoring import Forecaster, latest_forecast, persistence
from stationcast.schemas import POLLUTANTS, WARM_LOOKBACK_HOURS
from stationcast.sinks.tables import append_predictions
from stationcast.streaming.ingest import DELIVERY

KEPT = LOOK_BACK + 1
# Time in microseconds since 1970: a state holds no time zone.
_STATE = StructType(
    [StructField("city_slug", StringType()), StructField("us", StringType()), StructField("aqi", DoubleType())]
    + [StructField(c, DoubleType()) for c in POLLUTANTS]
)
_VALUES = ["aqi", *POLLUTANTS]
# Names that reach the processor may not begin with an underscore.
_PLACE = ["delivered", "file", "line"]


# What a stream with this state is started with. Timers fire with the next batch of readings: a query that ends once
# all files are read would otherwise run empty batches for ever.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """``STATE_CONF`` while a stream is started, which keeps a copy of the session; then what was set before."""
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class LastRows(StatefulProcessor):
    """Keeps the newest rows of a series and gives them out again after every batch that touches it."""

    def __init__(self, kept: int, quiet_ms: int, look_back_us: int):
        self.kept, self.quiet_ms, self.look_back_us = kept, quiet_ms, look_back_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        stored = StructType([StructField("us", StringType()), *[StructField(c, DoubleType()) for c in _VALUES]])
        self.rows = handle.getListState("rows", stored, ttlDurationMs=self.quiet_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {int(r[0]): tuple(r[1:]) for r in self.rows.get()}
        new = not known
        fresh: dict[int, tuple] = {}
        for part in rows:
            order, values = (zip(*(part[c].tolist() for c in names)) for names in (_PLACE, _VALUES))
            for us, place, value in zip(part["us"].tolist(), order, values):
                if us not in fresh or place >= fresh[us][0]:
                    fresh[us] = (place, tuple(None if v is None or v != v else float(v) for v in value))
            # An older row never comes back among the newest.
            if len(fresh) > self.kept:
                fresh = {t: fresh[t] for t in sorted(fresh)[-self.kept :]}
        known |= {t: v for t, (_, v) in fresh.items()}
        newest = sorted(known)[-self.kept :]
        newest = [t for t in newest if t >= newest[-1] - self.look_back_us]
        self.rows.put([(str(t), *known[t]) for t in newest])
        if new:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame({"city_slug": [key[0]] * len(newest), "us": [str(t) for t in newest], **{c: [known[t][i] for t in newest] for i, c in enumerate(_VALUES)}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if any(True for _ in self.rows.get()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        else:
            self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_rows(readings: DataFrame, quiet_days: float = 90, hours: int = WARM_LOOKBACK_HOURS, kept: int = KEPT) -> DataFrame:
    """After every batch the newest rows of each series it touched, from a stream of readings."""
    place = {c: F.col(c) if c in readings.columns else F.lit(None) for c in DELIVERY}
    rows = readings.where("city_slug is not null and timestamp is not null").select(
        "city_slug",
        F.unix_micros("timestamp").alias("us"),
        *[F.col(c).cast("double").alias(c) for c in _VALUES],
        F.coalesce(F.unix_micros(place["_delivered"].cast("timestamp")), F.lit(0)).alias("delivered"),
        F.coalesce(place["_file"].cast("string"), F.lit("")).alias("file"),
        F.coalesce(place["_row"].cast("long"), F.lit(0)).alias("line"),
    )
    processor = LastRows(kept, int(quiet_days * 86_400_000), hours * 3_600_000_000)
    made = rows.groupBy("city_slug").transformWithStateInPandas(processor, _STATE, "Update", "ProcessingTime")
    return made.select(
        "city_slug", F.timestamp_micros(F.col("us").cast("long")).alias("timestamp"), F.col("aqi").cast("int").alias("aqi"), *POLLUTANTS
    )


def forecast_stream(
    readings: DataFrame, gold_path: str, checkpoint: str, forecast: Forecaster = persistence, medians: Medians | None = None,
    quiet_days: float = 90, hours: int = WARM_LOOKBACK_HOURS, trigger: dict | None = None,
) -> StreamingQuery:
    """Append the latest forecast of every touched series after each batch, from state alone."""

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        # Appending passes over the forecasts twice; the state is to be read and written once.
        made = latest_forecast(batch, forecast, medians).persist()
        try:
            append_predictions(spark, made, gold_path)
        finally:
            made.unpersist()

    writer = (
        last_rows(readings, quiet_days, hours)
        .writeStream.foreachBatch(handle)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    with state_settings(readings.sparkSession):
        return writer.start()
