"""Streams run to the end of what is there; running them again changes nothing."""

import datetime as dt
import json

from conftest import at, reading
from pyspark.sql import functions as F

from stationcast.schemas import BRONZE_HOURLY
from stationcast.sinks import tables as sinks
from stationcast.sources import tables as sources
from stationcast.streaming import ingest, predictions


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_and_forecast(spark, frame, tmp_path):
    bronze, silver, gold, mark = (str(tmp_path / n) for n in ("bronze", "silver", "gold", "mark"))

    def run():
        stream = ingest.new_readings(spark, bronze)
        ingest.upsert_stream(stream, silver, mark, gold).awaitTermination()
        return sources.read_silver(spark, silver)

    first = frame([reading(s, h, 2) for s in "ab" for h in range(5)]).withColumn("dt", F.unix_timestamp("timestamp"))
    sinks.write_hourly(spark, first, bronze)
    assert run().count() == 10
    made = sources.read_predictions(spark, gold)
    assert {(r.city_slug, r.as_of) for r in made.collect()} == {(s, at(4).replace(tzinfo=None)) for s in "ab"}
    # Nothing new: nothing changes.
    before = rows_of(run())
    assert rows_of(run()) == before
    # One new hour for one series, and a correction of an old one, on a new day.
    more = frame([reading("a", 24, 3), reading("a", 48, 4)]).withColumn("dt", F.unix_timestamp("timestamp"))
    sinks.write_hourly(spark, more, bronze)
    assert run().count() == 12
    assert sources.read_predictions(spark, gold).count() == 3
    # Starting over from scratch reads every file again and ends with the same table.
    again = ingest.upsert_stream(ingest.new_readings(spark, bronze), silver, str(tmp_path / "mark2"), gold)
    again.awaitTermination()
    assert sources.read_silver(spark, silver).count() == 12
    assert sources.read_predictions(spark, gold).count() == 3


def test_drain(spark, tmp_path):
    land, gold, rejects = tmp_path / "land", str(tmp_path / "gold"), str(tmp_path / "rejects")
    land.mkdir()
    line = {"city_slug": "a", "as_of": "2026-01-01T00:00:00", "forecast_for": "2026-01-01T01:00:00", "predicted": 3, "confidence": 0.5}
    (land / "1.txt").write_text(json.dumps(line) + "\n{bad\n" + json.dumps({"city_slug": "b"}) + "\n")

    def run(mark):
        predictions.drain(predictions.prediction_lines(spark, str(land)), gold, rejects, str(tmp_path / mark)).awaitTermination()

    for mark in ("m", "m", "fresh"):
        run(mark)
        assert sources.read_predictions(spark, gold).count() == 1
        assert spark.read.parquet(rejects).count() == 2


def test_repeats_within_the_delay_are_dropped(spark, frame, tmp_path):
    bronze, out = str(tmp_path / "bronze"), str(tmp_path / "out")
    rows = frame([reading("a", h, 2) for h in (0, 1)])
    for _ in range(2):
        rows.write.mode("append").parquet(bronze)
    stream = ingest.drop_repeats(ingest.new_readings(spark, bronze, BRONZE_HOURLY).drop("year", "month", "day"))
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True)
    query.format("parquet").start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_redelivery_lands_in_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    from suite import queries

    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), i % 3, "view", 1.0, '{"k": 2}') for i in range(48)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.repartition(12).write.parquet(str(tmp_path / "events.parquet"))
    # Twelve files are read as twelve partitions.
    monkeypatch.setattr(queries, "workspace", lambda _, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        assert spark.read.parquet(str(tmp_path / "events.parquet")).rdd.getNumPartitions() == 12
        found = {(r.city_slug, r.timestamp): r.aqi for r in queries._redelivered(spark, str(tmp_path), 1000).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list((tmp_path / "land").glob("*.parquet"))) == 2 * queries.LANDED_FILES
    assert sorted(found.values()) == [1] * 24 + [3] * 24
