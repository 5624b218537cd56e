"""Cleaning, upsert, sources and sinks."""

import datetime as dt
import json
import os

import pytest
from conftest import at, reading
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from stationcast.operators import cleaning, joins, upsert
from stationcast.schemas import BRONZE_BULK, READING, SILVER
from stationcast.sinks import tables as sinks
from stationcast.sources import chunks, dimensions, responses, tables as sources


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_values(frame):
    target = frame([reading("a", 1, 2, city="X", source="pipeline", co=1.0, no=2.0), reading("a", 0, 1)])
    source = frame([reading("a", 1, 4, city="Y", source="hourly", co=None, no=9.0), reading("a", 2, 3, city="Y")])
    found = {r.timestamp.hour: r for r in upsert.upsert(target, source).collect()}
    assert (found[1].co, found[1].no, found[1].city, found[1].source, found[1].aqi) == (None, 9.0, "X", "hourly", 4)
    assert found[2].city == "Y" and found[0].aqi == 1 and len(found) == 3


def test_upsert_null_keys_are_added(frame):
    target = frame([reading("a", 1, 2)])
    source = target.withColumn("city_slug", F.lit(None).cast("string"))
    assert upsert.upsert(target, source).count() == 2


def test_upsert_takes_the_first_of_several(frame):
    target = frame([reading("a", 1, 2)])
    source = frame([reading("a", 1, 5), reading("a", 1, 4), reading("b", 1, 3)])
    found = upsert.upsert(target, source, source_order=["aqi"]).select("city_slug", "aqi")
    assert rows_of(found) == [("a", 4), ("b", 3)]


def test_rows_without_time_stay_in_their_own_folder(spark, frame, tmp_path):
    path = str(tmp_path / "silver")
    none = F.lit(None).cast("timestamp")
    upsert.upsert_table(spark, path, frame([reading("a", 1, 2), reading("a", 2, 3)]).withColumn("timestamp", none), SILVER)
    upsert.upsert_table(spark, path, frame([reading("a", 1, 2)]), SILVER)
    assert sources.read_silver(spark, path).count() == 3
    upsert.upsert_table(spark, path, frame([reading("b", 1, 2)]).withColumn("timestamp", none), SILVER)
    assert sources.read_silver(spark, path).where("timestamp IS NULL").count() == 3


KEYS = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 5), st.integers(1, 6)), max_size=8, unique_by=lambda r: r[:2])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(KEYS, KEYS)
def test_upsert_is_like_a_dictionary(frame, old, new):
    target = frame([reading(*r) for r in old])
    source = frame([reading(*r, source="hourly") for r in new])
    once = upsert.upsert(target, source)
    expected = {(k, h): a for k, h, a in old} | {(k, h): a for k, h, a in new}
    assert {(r.city_slug, r.timestamp.hour): r.aqi for r in once.collect()} == expected
    assert rows_of(upsert.upsert(once, source)) == rows_of(once)


def test_upsert_table_rewrites_only_touched_months(spark, frame, tmp_path):
    path = str(tmp_path / "silver")
    upsert.upsert_table(spark, path, frame([reading("a", 24 * d, 2) for d in range(60)]), SILVER)
    february = sorted(p.name for p in (tmp_path / "silver" / "ym=2026-02").iterdir())
    change = frame([reading("a", 24, 5, source="hourly"), reading("b", 0, 1)])
    for _ in range(2):
        upsert.upsert_table(spark, path, change, SILVER)
        silver = sources.read_silver(spark, path)
        assert silver.count() == 61
        assert silver.where("source = 'hourly'").select("aqi").first()[0] == 5
    assert sorted(p.name for p in (tmp_path / "silver" / "ym=2026-02").iterdir()) == february
    assert sources.newest_time(spark, path) == at(24 * 59).replace(tzinfo=None)


def test_hourly_files_replace_their_hour(spark, frame, tmp_path):
    path = str(tmp_path / "hourly")
    day = frame([reading("a", h, 2) for h in range(24)]).withColumn("dt", F.unix_timestamp("timestamp"))
    sinks.write_hourly(spark, day, path)
    again = day.where(F.hour("timestamp") == 5).withColumn("aqi", F.lit(4))
    sinks.write_hourly(spark, again, path)
    rows = sources.read_hourly(spark, path, year="2026", month="01")
    assert rows.count() == 24 and rows.agg(F.sum("aqi")).first()[0] == 50
    assert rows.select("year", "month", "day").distinct().collect()[0] == ("2026", "01", "01")
    files = [r[0] for r in rows.select("_file").distinct().collect()]
    assert sources.only_file(sources.read_hourly(spark, path), files[0]).count() == 24


def test_bulk_with_conflicting_types(spark, frame, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    frame([reading("a", h, 2) for h in range(3)]).write.parquet(one)
    later = frame([reading("a", h, 3) for h in (2, 3)])
    later.withColumn("aqi", F.lit("3.5")).withColumn("co", F.lit("n/a")).drop("nh3").write.parquet(two)
    clean = cleaning.clean_readings(sources.read_mixed_bulk(spark, [one, two]))
    found = {r.timestamp.hour: (r.aqi, r.co, r.nh3) for r in clean.collect()}
    assert found == {0: (2, 300.0, 3.0), 1: (2, 300.0, 3.0), 2: (2, 300.0, 3.0), 3: (4, None, None)}
    assert clean.schema["aqi"].dataType == READING["aqi"].dataType


def test_keep_first_then_drop(spark, frame):
    rows = frame([reading("a", 0, 1), reading("a", 0, 5), reading("b", 0, 2)])
    placed = rows.withColumn("_file", F.when(F.col("aqi") == 5, "f2").otherwise("f1")).withColumn("_row", F.lit(0))
    assert {(r.city_slug, r.aqi) for r in cleaning.clean_readings(placed).collect()} == {("a", 1), ("b", 2)}
    # A row without a time takes part in keep-first and goes only then.
    timeless = placed.withColumn("timestamp", F.when(F.col("city_slug") == "a", F.col("timestamp")))
    assert {(r.city_slug, r.aqi) for r in cleaning.clean_readings(timeless).collect()} == {("a", 1)}


def test_clean_keeps_class_six(frame):
    rows = frame([reading("a", 0, 6)]).withColumn("_file", F.lit("f")).withColumn("_row", F.lit(0))
    assert cleaning.clean_readings(rows).first().aqi == 6


AIR = {"list": [
    {"dt": 1767225600, "main": {"aqi": 2}, "components": {"co": 1.5, "pm10": 3}},
    {"dt": 1767229200, "components": {"nh3": 0.5}},
]}
WEATHER = {"list": [
    {"dt": 1767225600, "main": {"temp": 20, "humidity": 50}, "weather": [{"id": 500, "main": "Rain"}, {"id": 1}],
     "rain": {"1h": 0.4}, "clouds": {"all": 75}},
    {"dt": 1767232800, "main": {"temp": 20, "humidity": 0}, "weather": []},
]}


def land(path, doc, slug):
    path.mkdir(exist_ok=True)
    (path / f"{slug}.json").write_text(json.dumps({"city": slug.title(), "city_slug": slug, **doc}))


def test_responses(spark, tmp_path):
    land(tmp_path / "air", AIR, "tokyo")
    land(tmp_path / "wx", WEATHER, "tokyo")
    air = {r.dt: r for r in responses.read_air(spark, str(tmp_path / "air")).collect()}
    assert (air[1767225600].aqi, air[1767225600].co, air[1767225600].no2) == (2, 1.5, None)
    assert (air[1767229200].aqi, air[1767229200].nh3) == (None, 0.5)
    assert air[1767225600].timestamp == dt.datetime(2026, 1, 1)
    wx = {r.dt: r for r in responses.read_weather(spark, str(tmp_path / "wx")).collect()}
    assert (wx[1767225600].dew_point_c, wx[1767225600].rain_1h_mm, wx[1767225600].snow_1h_mm) == (10.0, 0.4, 0.0)
    assert (wx[1767225600].weather_id, wx[1767225600].clouds_pct) == (500, 75.0)
    assert (wx[1767232800].dew_point_c, wx[1767232800].weather_id) == (None, None)


def test_weather_join(spark, tmp_path):
    for slug in ("tokyo", "delhi"):
        land(tmp_path / "air", AIR, slug)
    for slug in ("tokyo", "cairo"):
        land(tmp_path / "wx", WEATHER, slug)
    wx, air = responses.read_weather(spark, str(tmp_path / "wx")), responses.read_air(spark, str(tmp_path / "air"))
    found = joins.weather_with_air(wx, air)
    # Weather decides which moments are kept; a station without weather keeps its air rows.
    assert {(r.city_slug, r.dt, r.temp_c, r.co) for r in found.collect()} == {
        ("tokyo", 1767225600, 20.0, 1.5), ("tokyo", 1767232800, 20.0, None),
        ("cairo", 1767225600, 20.0, None), ("cairo", 1767232800, 20.0, None),
        ("delhi", 1767225600, None, 1.5), ("delhi", 1767229200, None, None),
    }
    assert found.columns.count("timestamp") == 1


def test_prediction_lines(spark):
    good = {"city_slug": "a'b", "as_of": "2026-01-01T00:00:00+00:00", "forecast_for": "2026-01-01 01:00:00", "predicted": 3,
            "confidence": 0.12345678}
    lines = [json.dumps(good), "{bad", json.dumps({k: v for k, v in good.items() if k != "predicted"}),
             json.dumps(good | {"as_of": "soon"})]
    rows, rejects = responses.parse_predictions(spark.createDataFrame([(x,) for x in lines], "value string"))
    row = rows.first()
    assert rows.count() == 1 and rejects.count() == 3
    assert (row.city_slug, row.confidence, row.forecast_for) == ("a'b", 0.123457, dt.datetime(2026, 1, 1, 1))


def test_chunks(spark):
    df = spark.createDataFrame([("a", dt.datetime(2025, 3, 20), dt.datetime(2026, 3, 20)), ("b", dt.datetime(2025, 3, 20), dt.datetime(2025, 3, 20))], "k string, s timestamp, e timestamp")
    found = chunks.chunk_plan(df, "s", "e").orderBy("chunk_start").collect()
    assert len(found) == 53 and found[-1].chunk_end - found[-1].chunk_start == dt.timedelta(days=1)
    assert {b.chunk_start - a.chunk_end for a, b in zip(found, found[1:])} == {dt.timedelta(0)}


def test_dimensions(spark, tmp_path):
    stations = dimensions.stations(spark)
    assert stations.count() == stations.select("slug").distinct().count() == 99
    assert stations.where("slug = 'tokyo'").first().timezone == "Asia/Tokyo"
    assert dimensions.classes(spark).count() == 5
    (tmp_path / "s.csv").write_text("name,slug,lat,lon,timezone\nHere,here,1.5,2.5,\n")
    assert dimensions.read_stations(spark, str(tmp_path / "s.csv")).first().timezone == "UTC"
    zones = spark.createDataFrame([("tokyo", "Asia/Tokyo")], "slug string, timezone string")
    named = {r.slug: r.timezone for r in dimensions.with_timezones(stations, zones).collect()}
    assert (named["tokyo"], named["delhi"]) == ("Asia/Tokyo", "UTC")


def test_snapshots_show_the_newest(spark, tmp_path):
    path = str(tmp_path / "imp")
    one = spark.createDataFrame([("pm10", 1.0, 1.0, 1.0)], "feature string, weight double, gain double, cover double")
    for day in (3, 1, 2, 2):
        sinks.append_snapshot(one, path, f"2026-01-0{day}")
    found = sinks.last_snapshots(spark.read.parquet(path), 2)
    assert sorted(r.computed_at for r in found.collect()) == ["2026-01-02", "2026-01-03"]


def test_window_over_equal_forecasts_keeps_the_newest(spark):
    rows = [(at(1), "a", 1, 0.5, at(0)), (at(1), "a", 2, 0.5, at(0.5)), (at(2), "a", 3, 0.5, at(1))]
    df = spark.createDataFrame(rows, "forecast_for timestamp, city_slug string, predicted int, confidence double, as_of timestamp")
    assert sorted(r.predicted for r in cleaning.newest_forecast(df).collect()) == [2, 3]


@pytest.mark.parametrize("repeat", [1, 3])
def test_gold_append_is_keyed(spark, tmp_path, repeat):
    path = str(tmp_path / "gold")
    rows = [(at(1), "a", 1, 0.1234567, at(0)), (at(2), "a", 2, 0.5, at(1))]
    df = spark.createDataFrame(rows, "forecast_for timestamp, city_slug string, predicted int, confidence double, as_of timestamp")
    for _ in range(repeat):
        sinks.append_predictions(spark, df, path)
    found = sources.read_predictions(spark, path)
    assert found.count() == 2 and found.where("predicted = 1").first().confidence == 0.123457


def test_bulk_folders_are_listed_in_few_tasks_and_swapped_only_where_months_are_replaced(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "bulk")
    slugs = [f"s{n}" for n in range(100)]
    rows = frame([reading(s, h, 2) for s in slugs for h in (0, 24 * 40)]).withColumn("dt", F.unix_timestamp("timestamp")).drop("source")
    modes, save = [], type(rows.write).mode
    monkeypatch.setattr(type(rows.write), "mode", lambda self, m: modes.append(m) or save(self, m))
    sinks.write_bulk(rows, path)
    sinks.write_bulk(rows.where("city_slug = 's7' and month(timestamp) = 1").withColumn("pm10", F.lit(1.5)), path)
    assert [m for m in modes if m] == ["append", "overwrite"]

    spark.sparkContext.setJobGroup("listing", "")
    back = sources.read_bulk(spark, path)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 64
    found = {(r.city_slug, r.month): r.pm10 for r in back.collect()}
    assert len(found) == back.count() == 200
    assert {k: v for k, v in found.items() if v != 20.0} == {("s7", "01"): 1.5}


ODD_SLUGS = ["a b", "x/y", "100%", "a+b", "%2F", "日本", "c=d", "q?#", "tab\t", "a:b*c", "", None]


def _odd_rows(spark):
    data = [(24 * i + n, at(24 * 20 * i) if n else None, s, float(i)) for i in range(4) for n, s in enumerate(ODD_SLUGS)]
    return spark.createDataFrame(data, "dt long, timestamp timestamp, city_slug string, pm10 double").withColumn("aqi", F.lit(3))


def test_a_new_bulk_table_is_written_whole_without_hadoop_files(spark, tmp_path):
    path = str(tmp_path / "bulk")
    rows = _odd_rows(spark)
    # An empty station goes to the folder of a missing one, in the same task.
    sinks.write_bulk(rows.coalesce(1), path)
    names = [n for _, _, files in os.walk(path) for n in files]
    assert sorted(n[:4] for n in names if not n.endswith(".parquet")) == ["_SUC"]
    plain = spark.read.schema(BRONZE_BULK).parquet(path)
    columns = ["dt", "timestamp", "pm10", "aqi", "city_slug", "year", "month"]
    slug = F.when(F.col("city_slug") != "", F.col("city_slug"))
    stamp = [F.date_format("timestamp", f).alias(n) for n, f in (("year", "yyyy"), ("month", "MM"))]
    wanted = sorted(map(repr, rows.select("dt", "timestamp", "pm10", F.col("aqi").cast("double"), slug.alias("city_slug"), *stamp).collect()))
    assert sorted(map(repr, plain.select(columns).collect())) == wanted

    fails = rows.withColumn("pm10", F.when(F.col("dt") == 50, F.raise_error(F.lit("no"))).otherwise(F.col("pm10")))
    with pytest.raises(Exception):
        sinks.write_bulk(fails, str(tmp_path / "part"))
    assert os.listdir(tmp_path) == ["bulk"]
    sinks.write_bulk(rows.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == ["_SUCCESS"]


def test_a_long_month_is_one_file_of_every_batch(spark, tmp_path):
    path = str(tmp_path / "bulk")
    month = spark.range(25_000).selectExpr("id AS dt", "timestamp_seconds(1767225600 + 60 * id) AS timestamp", "'a' AS city_slug", "1D AS pm10")
    sinks.write_bulk(month, path)
    back = sources.read_bulk(spark, path)
    assert back.select("_file").distinct().count() == 1
    assert [r.dt for r in back.orderBy("_row").collect()] == list(range(25_000))
    assert back.select("city_slug", "year", "month").distinct().collect() == [("a", "2026", "01")]


def test_bulk_folders_are_read_off_the_paths_without_discovery_in_the_driver(spark, tmp_path):
    path = str(tmp_path / "bulk")
    sinks.write_bulk(_odd_rows(spark), path)
    back = sources.read_bulk(spark, path)
    relation = back._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation()
    assert relation.location().partitionSpec().partitions().isEmpty()
    plain = sources.with_position(spark.read.schema(BRONZE_BULK).parquet(path))
    assert back.dtypes == plain.dtypes and rows_of(back) == rows_of(plain) and back.count() == 48
    assert back.where("city_slug = 'x/y' and year = '2026'").count() == 4
    # Files in other folders keep the station they hold.
    _odd_rows(spark).drop("aqi").where("dt < 2").write.parquet(str(tmp_path / "flat" / "year=2026"))
    flat = sources.read_bulk(spark, str(tmp_path / "flat"))
    assert {(r.city_slug, r.year, r.month) for r in flat.collect()} == {("a b", None, None), ("x/y", None, None)}
