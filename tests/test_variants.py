"""Landed JSON whose shape changes."""

import json

from stationcast.schemas import AIR_RESPONSE, WEATHER_RESPONSE
from stationcast.sources import responses, variants


def _lines(spark, docs):
    return spark.createDataFrame([(d if d is None or isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def _air(slug, **record):
    return {"city": slug, "city_slug": slug, "list": [record]}


def test_added_missing_and_retyped_fields(spark):
    docs = [
        _air("plain", dt=3600, main={"aqi": 2}, components={"co": 1.5, "pm10": 4}),
        _air("added", dt=3600, main={"aqi": 2, "scale": "eu"}, components={"pm10": 4, "dust": [1, 2]}, note=None) | {"api": 3},
        _air("missing", dt=3600),
        _air("castable", dt="3600", main={"aqi": "3"}, components={"pm10": "4.5"}),
        _air("unreadable", dt=3600, main="none", components={"pm10": "n/a", "co": None}),
        _air("dotted", **{"dt": 1, "main": {"x": 1}, "main.x": 2}),
        {"city_slug": "no records", "list": []},
    ]
    bad = [None, "", "{", "[1]", "5", '{"city_slug": "x"}', '{"city_slug": "x", "list": {"dt": 1}}']
    got, rejects = variants.read_any(_lines(spark, docs + bad), AIR_RESPONSE)
    rows = {r.city_slug: r for r in responses.flatten_air(got).collect()}
    assert set(rows) == {"plain", "added", "missing", "castable", "unreadable", "dotted"}
    assert (rows["plain"].aqi, rows["plain"].co, rows["plain"].pm10, rows["plain"].dt) == (2, 1.5, 4.0, 3600)
    assert (rows["added"].aqi, rows["added"].pm10) == (2, 4.0)
    assert (rows["missing"].aqi, rows["missing"].pm10, rows["missing"].dt) == (None, None, 3600)
    assert (rows["castable"].aqi, rows["castable"].pm10, rows["castable"].dt) == (3, 4.5, 3600)
    assert (rows["unreadable"].aqi, rows["unreadable"].pm10, rows["unreadable"].co) == (None, None, None)
    rest = {}
    for r in variants.unread_values(got).collect():
        rest.setdefault(r.city_slug, []).append((r.path, r.value))
    assert rest == {
        "added": [("api", "3"), ("list[0].components.dust", "[1,2]"), ("list[0].main.scale", '"eu"'), ("list[0].note", "null")],
        "unreadable": [("list[0].components.pm10", '"n/a"'), ("list[0].main", '"none"')],
        "dotted": [("list[0].main.x", "1"), ("list[0].main.x", "2")],
    }
    assert sorted(map(str, (r.line for r in rejects.collect()))) == sorted(map(str, bad))
    assert got.count() + rejects.count() == len(docs) + len(bad)


def test_plain_lines_equal_the_fixed_schema_and_are_parsed_once(spark):
    record = {
        "dt": 7200, "main": {"temp": 9.5, "humidity": 40}, "wind": {"speed": 2, "deg": 10}, "clouds": {"all": 5}, "visibility": 9,
        "rain": {"1h": 0.25}, "weather": [{"id": 500, "main": "Rain", "description": "light"}],
    }
    lines = _lines(spark, [{"city": "A", "city_slug": "a", "list": [record, {**record, "dt": 10800, "weather": []}]}])
    got, rejects = variants.read_any(lines, WEATHER_RESPONSE)
    fixed = responses.flatten_weather(responses.parse_responses(lines, WEATHER_RESPONSE))
    assert responses.flatten_weather(got).collect() == fixed.collect()
    assert variants.unread_values(got).count() == rejects.count() == 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1


def test_an_empty_table(spark):
    got, rejects = variants.read_any(_lines(spark, ["{}"]).limit(0), AIR_RESPONSE)
    assert got.count() == rejects.count() == responses.flatten_air(got).count() == 0
