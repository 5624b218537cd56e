"""Forecasts from stream state against those of the look-back read."""

import random

import pytest
from conftest import reading

from stationcast.schemas import BRONZE_HOURLY
from stationcast.sources.tables import read_predictions
from stationcast.streaming import ingest, lag_state


@pytest.fixture
def rocksdb(spark):
    with lag_state.state_settings(spark):
        yield spark


def state_of(spark, checkpoint):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "rows").option("flattenCollectionTypes", "true").load()


def test_forecasts_equal_the_look_back(rocksdb, frame, tmp_path):
    spark = rocksdb
    rng = random.Random(3)
    land, silver, checkpoint = (str(tmp_path / n) for n in ("land", "silver", "state"))
    gold = {n: str(tmp_path / f"gold-{n}") for n in ("read", "state")}
    latest = {"a": 0, "b": 0}
    for batch in range(3):
        rows = []
        for s in latest if batch != 1 else ["a"]:
            for _ in range(rng.randrange(2, 6)):
                latest[s] += rng.randrange(1, 4)
                rows.append(reading(s, latest[s], rng.randrange(1, 6), no2=None if rng.random() < 0.3 else 5.0))
            # Late ones, one of them in between, and one that comes again with another class.
            rows += [reading(s, max(0, latest[s] - rng.randrange(1, 9)) + 0.5, rng.randrange(1, 6)) for _ in range(2)]
            rows.append(reading(s, latest[s], rng.randrange(1, 6)))
        made = frame(rows).selectExpr("unix_timestamp(timestamp) AS dt", "*").withColumns({}).coalesce(1)
        for name in ("year", "month", "day"):
            made = made.selectExpr("*", f"'{batch}' AS {name}")
        made.select(*BRONZE_HOURLY.fieldNames()).write.mode("append").parquet(land)
        stream = ingest.new_readings(spark, land, BRONZE_HOURLY)
        ingest.upsert_stream(stream, silver, str(tmp_path / "upsert"), gold["read"]).awaitTermination()
        lag_state.forecast_stream(ingest.as_reading(ingest.new_readings(spark, land, BRONZE_HOURLY)), gold["state"], checkpoint).awaitTermination()
        found = {n: sorted(read_predictions(spark, p).collect()) for n, p in gold.items()}
        assert found["read"] == found["state"] and (found["read"] or batch == 0)
        per_key = state_of(spark, checkpoint).groupBy("key").count().collect()
        assert {r["count"] for r in per_key} == {lag_state.KEPT}


def test_silent_series_lose_their_state(rocksdb, frame, tmp_path):
    spark = rocksdb
    land, checkpoint = str(tmp_path / "land"), str(tmp_path / "state")
    for slug in ("a", "b"):
        frame([reading(slug, h, 2) for h in range(5)]).write.mode("append").parquet(land)
        stream = spark.readStream.schema(frame([]).schema).parquet(land)
        lag_state.forecast_stream(stream, str(tmp_path / "gold"), checkpoint, quiet_days=1e-6 if slug == "a" else 1).awaitTermination()
    rows = state_of(spark, checkpoint).select("key.*").distinct().collect()
    assert [r[0] for r in rows] == ["b"]


def test_one_batch_with_many_rows_keeps_few():
    import pandas as pd

    kept = []

    class Rows:
        def get(self):
            return iter(kept)

        def put(self, rows):
            kept[:] = rows

    class Handle:
        def getListState(self, *_, **__):
            return Rows()

        def listTimers(self):
            return iter([1])

        def deleteTimer(self, at):
            assert at == 1

        def registerTimer(self, at):
            assert at == 1010

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 1000

    last = lag_state.LastRows(4, 10, 10**12)
    last.init(Handle())
    values = {c: 1.0 for c in lag_state._VALUES}
    part = pd.DataFrame([{"us": t, "delivered": 1, "file": "f", "line": t, **values, "aqi": float(t % 5)} for t in range(5000)])
    again = pd.DataFrame([{"us": 4999, "delivered": 0, "file": "f", "line": 9, **values, "aqi": None}])
    out = pd.concat(last.handleInputRows(("a",), iter([part, again]), Now()))
    assert out["us"].tolist() == ["4996", "4997", "4998", "4999"] and out["aqi"].tolist() == [1.0, 2.0, 3.0, 4.0]
    out = pd.concat(last.handleInputRows(("a",), iter([again.assign(delivered=2)]), Now()))
    assert out["aqi"].isna().tolist() == [False, False, False, True] and len(kept) == 4


def test_a_known_series_costs_one_read_and_one_write_of_its_state():
    import pandas as pd

    calls, kept = [], []

    class Rows:
        def get(self):
            calls.append("get")
            return iter(kept)

        def put(self, rows):
            calls.append("put")
            kept[:] = rows

        def clear(self):
            calls.append("clear")
            kept.clear()

    class Handle:
        def getListState(self, *_, **__):
            return Rows()

        def listTimers(self):
            return iter([])

        def registerTimer(self, at):
            calls.append(at)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentProcessingTimeInMs(self):
            return self.ms

    last = lag_state.LastRows(4, 10, 10**12)
    last.init(Handle())
    values = {c: 1.0 for c in lag_state._VALUES}
    for now in (1000, 1005):
        part = pd.DataFrame([{"us": now, "delivered": 1, "file": "f", "line": 1, **values}])
        list(last.handleInputRows(("a",), iter([part]), Now(now)))
    assert calls == ["get", "put", 1010, "get", "put"]
    # The timer of the first batch finds the rows of the second, the next one none.
    assert not list(last.handleExpiredTimer(("a",), Now(1010), None)) and calls[5:] == ["get", 1020]
    kept.clear()
    assert not list(last.handleExpiredTimer(("a",), Now(1020), None)) and calls[7:] == ["get", "clear"]
