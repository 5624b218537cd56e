"""Whole jobs: back-fill, retrain, refresh, read."""

import json

import pytest
from conftest import at, reading
from pyspark.sql import functions as F

from stationcast.operators import scoring, training
from stationcast.plans import ingest, monitor
from stationcast.plans.routes import Routes
from stationcast.plans.training import search, time_folds, train
from stationcast.schemas import FEATURES, SILVER
from stationcast.sinks import tables as sinks
from stationcast.sources import artifacts, tables as sources


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Silver with 15 days of three known stations and one unknown one."""
    from stationcast.schemas import READING

    root = tmp_path_factory.mktemp("lake")
    rows = []
    for s, slug in enumerate(["tokyo", "delhi", "cairo", "nowhere"]):
        for h in range(360):
            level = (h * 7 + s * 3 + (h // 11) * 5) % 17
            rows.append(reading(slug, h, level % 6 + 1, pm10=10.0 + level, pm2_5=5.0 + level / 2, co=200.0 + 3 * (level % 5)))
    names = ["timestamp", "city", "city_slug", "aqi", "co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3", "source"]
    df = spark.createDataFrame([tuple(dict(zip(names, r))[f.name] for f in READING.fields) for r in rows], READING)
    sinks.seed_silver(spark, df, str(root / "silver"))
    return root


@pytest.fixture(scope="module")
def fitted(spark, lake):
    model = str(lake / "model")
    learner = training.random_forest(trees=4, depth=4)
    stats = train(spark, str(lake / "silver"), model, learner=learner, snapshots_path=str(lake / "importance")).first()
    assert stats.rows == 4 * (360 - 4)
    return artifacts.load_artifacts(spark, model)


def test_backfill(spark, tmp_path):
    for kind in ("air", "wx"):
        (tmp_path / kind).mkdir()
    hours = [{"dt": 1767225600 + 3600 * h, "main": {"aqi": 2}, "components": {"pm10": 1.0}} for h in range(5)]
    for name in ("first", "again"):
        doc = {"city": "Tokyo", "city_slug": "tokyo", "list": hours}
        (tmp_path / "air" / f"{name}.json").write_text(json.dumps(doc))
    bronze, silver = str(tmp_path / "bronze"), str(tmp_path / "silver")
    ingest.land_responses(spark, str(tmp_path / "air"), None, bronze)
    assert [tuple(r) for r in ingest.backfill(spark, bronze, silver).collect()] == [("pipeline", 5)]
    hourly = spark.read.schema(SILVER).parquet(silver).limit(1).withColumn("aqi", F.lit(5)).withColumn("dt", F.lit(1).cast("long"))
    sinks.write_hourly(spark, hourly, str(tmp_path / "hourly"))
    file = sources.read_hourly(spark, str(tmp_path / "hourly")).select("_file").first()[0]
    ingest.merge_file(spark, str(tmp_path / "hourly"), file, silver)
    found = sources.read_silver(spark, silver)
    assert found.count() == 5 and found.where("source = 'hourly' and aqi = 5").count() == 1


def test_model_scores(spark, lake, fitted):
    model, medians = fitted
    assert set(medians) == set(FEATURES)
    readings = sources.read_silver(spark, str(lake / "silver"))
    made = scoring.latest_forecast(readings, scoring.forecaster(model), medians).collect()
    assert len(made) == 4
    for r in made:
        assert 1 <= r.predicted <= 5 and abs(sum(r.probabilities.values()) - 1) < 1e-3
        assert r.confidence == max(r.probabilities.values()) == r.probabilities[str(r.predicted)]
    assert scoring.backtest(readings, scoring.forecaster(model), medians).count() == 4 * 356


def test_importance(spark, lake, fitted):
    routes = Routes(spark, str(lake / "silver"), snapshots_path=str(lake / "importance"))
    rows = routes.feature_importance().collect()
    assert rows and {r.feature for r in rows} <= set(FEATURES)
    for kind in ("weight", "gain", "cover"):
        assert abs(sum(r[kind] for r in rows) - 1) < 0.002
    assert routes.feature_importance_history().count() == len(rows)


def test_other_learners(spark, lake):
    from stationcast.operators.features import training_features

    rows = training.with_weights(training.label_rows(training_features(sources.read_silver(spark, str(lake / "silver")))))
    rows = training.impute(rows, {}).where(F.col("city_slug") == "tokyo").cache()
    for learner in (training.logistic(), training.boosted_trees(rounds=2, depth=2)):
        made = scoring.forecaster(training.fit(rows, learner))(rows)
        bad = made.where(~F.col("predicted").between(1, 5) | (F.abs(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, b: a + b) - 1) > 1e-3))
        assert made.count() == rows.count() and bad.count() == 0


def test_search(spark, lake):
    readings = sources.read_silver(spark, str(lake / "silver"), keys=["tokyo", "delhi"])
    found = search(readings, {"deep": training.random_forest(2, 4), "flat": training.random_forest(2, 1)}, folds=2).collect()
    assert {r.learner for r in found} == {"deep", "flat"} and found[0].f1 >= found[1].f1
    for before, after in time_folds(readings, 2):
        start = after.agg(F.min("timestamp")).first()[0]
        assert before.agg(F.max("timestamp")).first()[0] < start
        # The newest reading before the cut has its label behind it.
        earlier = readings.where(F.col("timestamp") < start).groupBy("city_slug").count()
        known = before.groupBy("city_slug").count()
        assert sorted((r.city_slug, r["count"] + 1) for r in known.collect()) == sorted(map(tuple, earlier.collect()))


def test_warm(spark, lake):
    out, gold = str(lake / "out"), str(lake / "gold")
    for _ in range(2):
        done = monitor.warm(spark, str(lake / "silver"), out, gold_path=gold).first()
        assert (done.cached, done.skipped, done.rows_fetched) == (3, 0, 3 * 341)
        assert sources.read_predictions(spark, gold).count() == 3
    latest = spark.read.parquet(f"{out}/latest")
    assert {r.timezone for r in latest.collect()} == {"Asia/Tokyo", "Asia/Kolkata", "Africa/Cairo"}
    assert {tuple(r) for r in spark.read.parquet(f"{out}/history").groupBy("city_slug").count().collect()} == {
        ("tokyo", 168), ("delhi", 168), ("cairo", 168)
    }
    documents = {(r.city_slug, r.hours): json.loads(r.document) for r in spark.read.parquet(f"{out}/history_documents").collect()}
    assert {k: len(v) for k, v in documents.items()} == {
        (s, h): h for s in ("tokyo", "delhi", "cairo") for h in (24, 48, 72, 168)
    }
    assert documents["tokyo", 24] == documents["tokyo", 168][-24:]
    scores = spark.read.parquet(f"{out}/metrics")
    assert {r.window_hours: r.n_predictions for r in scores.collect()} == {h: 3 * (h + 3) for h in (24, 48, 72, 168)}
    assert spark.read.parquet(f"{out}/drift_features").select("window").distinct().count() == 2
    assert spark.read.parquet(f"{out}/global_drift_windows").count() == 2


def test_routes(spark, lake, fitted):
    routes = Routes(spark, str(lake / "silver"), as_of=at(359).replace(tzinfo=None))
    assert routes.cities().count() == 99
    assert routes.predict("tokyo").first().city == "Tokyo"
    assert routes.history("tokyo", 48).count() == 49
    assert routes.drift("1d", "delhi")["windows"].first().ref_label == "yesterday"
    assert routes.drift("7d")["features"].count() == 10
    assert routes.model_metrics(24)["per_class"].count() == 5
    assert routes.accuracy_trend(2)["summary"].count() == 1
    for bad in (lambda: routes.predict("nowhere"), lambda: routes.history("tokyo", 0), lambda: routes.drift("2d"),
                lambda: routes.model_metrics(12), lambda: routes.accuracy_trend(1)):
        with pytest.raises(ValueError):
            bad()
