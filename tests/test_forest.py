"""A forest as a relation against the fitted model it comes from."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stationcast.operators import features, forest, importance, scoring, training
from stationcast.schemas import FEATURES
from stationcast.sources.artifacts import load_artifacts, save_artifacts
from tests.conftest import reading


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [reading(f"s{s}", h, rng.randrange(1, 6), co=rng.uniform(100, 400), pm10=rng.uniform(5, 90), o3=rng.uniform(1, 90)) for s in range(4) for h in range(60)]
    columns = ["timestamp", "city", "city_slug", "aqi", "co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3", "source"]
    readings = spark.createDataFrame(rows, columns).withColumn("aqi", F.col("aqi").cast("int"))
    made = training.label_rows(features.training_features(readings))
    known = training.impute(training.with_weights(made), dict.fromkeys(FEATURES, 0.0))
    model = training.fit(known, training.random_forest(trees=7, depth=4))
    path = str(tmp_path_factory.mktemp("model"))
    save_artifacts(spark, model, dict.fromkeys(FEATURES, 0.0), path)
    return load_artifacts(spark, path)[0], forest.read_forest(spark, f"{path}/model"), known, readings


@pytest.mark.parametrize("most", [1, 60, 50_000])
def test_shares_equal_the_model(fitted, most):
    model, nodes, rows, _ = fitted
    both = forest.shares(model.transform(rows), nodes, most=most, to="mine").withColumn("theirs", vector_to_array("probability"))
    worst = both.agg(F.max(F.expr("array_max(zip_with(mine, theirs, (a, b) -> abs(a - b)))"))).first()[0]
    assert worst < 1e-9


def test_forecasts_equal_the_model(fitted):
    model, nodes, _, readings = fitted
    one = scoring.backtest(readings, scoring.forecaster(model)).collect()
    two = scoring.backtest(readings, forest.forest_forecaster(nodes)).collect()
    assert sorted(one) == sorted(two)


def test_plan_holds_the_trees_as_a_constant(fitted):
    _, nodes, _, readings = fitted
    plan = forest.shares(features.serving_features(readings), nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "from_json" not in plan


def test_paths_count_every_row_on_every_level(fitted):
    _, nodes, rows, _ = fitted
    n = rows.count()
    for most in (60, 50_000):
        passed = {(r.tree, r.node): r.rows for r in forest.paths(rows, nodes, most=most).collect()}
        for r in nodes.collect():
            if r.node == 0:
                assert passed[r.tree, 0] == n
            if r.left >= 0:
                assert passed[r.tree, r.node] == passed[r.tree, r.left] + passed[r.tree, r.right]
    found = importance.importances(forest.with_cover(nodes, forest.paths(rows, nodes))).collect()
    assert sum(r.cover for r in found) == pytest.approx(1, abs=1e-3)


def test_depth_missing_values_and_faults(spark):
    def nodes(rows):
        return spark.createDataFrame(rows, forest.NODE)

    chain = [(0, 2 * k, 0, float(k), 2 * k + 1, 2 * k + 2, 1.0, [1.0, 1.0]) for k in range(9)]
    chain += [(0, 2 * k + 1, -1, None, -1, -1, None, [1.0, float(k)]) for k in range(9)] + [(0, 18, -1, None, -1, -1, None, [0.0, 0.0])]
    deep = nodes(chain)
    assert forest.depth(deep) == 9
    rows = spark.createDataFrame([(float(k),) for k in range(-1, 12)] + [(None,), (float("nan"),)], "a double")
    got = {r.a: r.p for r in forest.shares(rows, deep, ["a"], 2, to="p").where("a is not null and not isnan(a)").collect()}
    assert got[-1.0] == got[0.0] == [1.0, 0.0] and got[3.0] == [0.25, 0.75] and got[11.0] == [0.0, 0.0]
    lost = [r.p for r in forest.shares(rows, deep, ["a"], 2, to="p").where("a is null or isnan(a)").collect()]
    assert lost == [[0.0, 0.0]] * 2
    with pytest.raises(ValueError):
        forest.depth(nodes([(0, 0, 0, 1.0, 0, 0, 1.0, [1.0])]))
    with pytest.raises(ValueError):
        forest.shares(rows, deep.limit(0), ["a"], 2)
