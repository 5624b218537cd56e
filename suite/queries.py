"""Every operator as a query over the test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast import tune, workspace
from stationcast.functions import cyclic, dew_point, half_even, share_of_total
from stationcast.operators import (
    cleaning,
    drift as drift_ops,
    features as feature_ops,
    forest as forest_ops,
    importance as importance_ops,
    increments,
    joins,
    metrics,
    moments,
    quantiles,
    reports,
    rolling,
    scoring,
    series,
    training,
    upsert as upsert_ops,
)
from stationcast.plans import scores as score_plans
from stationcast.plans.routes import Routes
from stationcast.schemas import AIR_RESPONSE, FEATURES, POLLUTANTS, PREDICTION, READING, SILVER, WEATHER_RESPONSE
from stationcast.sinks import tables as sinks
from stationcast.sources import artifacts, chunks, dimensions, responses, tables as sources, variants
from stationcast.streaming import ingest, joins as stream_joins, lag_state, predictions as drain
from suite import forest as small_forest
from suite.folder import with_folder
from suite.adapter import events_as_readings, for_compare, readings, silver, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return for_compare(fn(with_folder(tune(spark)), sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Written once, for queries that pass over it several times."""
    path = workspace(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- features -------------------------------------------------------------------------------------


@query
def features_train(spark, d):
    """F1 train, W1-W4, P11"""
    return feature_ops.training_features(readings(spark, d))


@query
def features_train_cut(spark, d):
    """F1 train, W1-W4 with every series above 20 rows cut into pieces"""
    return feature_ops.training_features(readings(spark, d), max_rows=20)


@query
def features_serve(spark, d):
    """F1 serve, P13"""
    return feature_ops.serving_features(readings(spark, d)).drop("ts_next")


@query
def features_drift(spark, d):
    """F1 drift variant"""
    rows = feature_ops.drift_features(readings(spark, d))
    return rows.select("city_slug", "timestamp", "pm10_lag1", "pm25_ratio", "aqi_roll_std4")


@query
def features_max_gap(spark, d):
    """C2 option: neighbours further away than 12 hours per step do not count"""
    return feature_ops.training_features(readings(spark, d), max_gap="12 HOURS")


@query
def feature_medians(spark, d):
    """A1"""
    values = quantiles.median_values(_stored(spark, feature_ops.training_features(readings(spark, d))), FEATURES)
    return spark.createDataFrame(list(values.items()), "feature string, median double")


# Fixed times of the query; ``suite/oracle.py`` uses the same.
ROLLING_ENDS, ROLLING_DAYS = ("2024-01-15 07:30:00", "2024-01-16 07:30:00", "2024-01-17 07:30:00"), 10


@query
def rolling_medians(spark, d):
    """A1, M8: medians of a window that moves on by a day, from sketches kept per day"""
    rows = _stored(spark, feature_ops.training_features(readings(spark, d)))
    path, out = workspace(spark, "sketches"), []
    for until in ROLLING_ENDS:
        end = dt.datetime.fromisoformat(until).replace(tzinfo=dt.timezone.utc)
        start = end - dt.timedelta(days=ROLLING_DAYS)
        rolling.refresh(rows, path, FEATURES, start, end, unit="day")
        out += [(until, c, m) for c, m in rolling.window_medians(rows, path, FEATURES, start, end, unit="day").items()]
    return spark.createDataFrame(out, "until string, feature string, median double")


@query
def cyclic_time(spark, d):
    """H3, H4"""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hour, month = cyclic("hour(ts)", 24), cyclic("month(ts)", 12)
    return rows.select(
        "event_id", hour[0].alias("hour_sin"), hour[1].alias("hour_cos"),
        month[0].alias("month_sin"), month[1].alias("month_cos"),
    )


@query
def pollutant_share(spark, d):
    """H7 with both null rules"""
    rows = silver(spark, d)
    others = ["pm10", "no2", "o3", "so2"]
    return rows.select(
        "city_slug", "timestamp",
        half_even(share_of_total("pm2_5", others), 4).alias("share_zero"),
        share_of_total("pm2_5", others, "null").alias("share_null"),
    )


@query
def dew_points(spark, d):
    """H12 with value as temperature and k as humidity"""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select("event_id", dew_point("value", k).alias("dew_point_c"))


# --- training rows --------------------------------------------------------------------------------


def _labelled(spark, d):
    return training.label_rows(feature_ops.training_features(readings(spark, d)))


@query
def transition_weights(spark, d):
    """A4, A5, W8"""
    return training.weight_table(_labelled(spark, d))


@query
def training_rows(spark, d):
    """A4, A5, W8, P12, J6, H19"""
    rows = _stored(spark, _labelled(spark, d))
    filled = training.impute(training.with_weights(rows), quantiles.median_values(rows, FEATURES))
    return filled.select("city_slug", "timestamp", "label", "kind", "weight", *FEATURES)


@query
def transition_stats(spark, d):
    """A6"""
    return training.transition_stats(_labelled(spark, d))


@query
def class_distribution(spark, d):
    """A2"""
    return training.class_distribution(feature_ops.training_features(readings(spark, d)))


@query
def load_stats(spark, d):
    """A7"""
    return training.load_stats(silver(spark, d))


# --- forecasts ------------------------------------------------------------------------------------


@query
def latest_n_per_key(spark, d):
    """W5"""
    return series.latest_per_key(readings(spark, d), "city_slug", "timestamp", 4).select(
        "city_slug", "timestamp", "aqi", "pm10"
    )


@query
def latest_forecast(spark, d):
    """M4, M10, J4"""
    return scoring.latest_forecast(readings(spark, d)).drop("probabilities")


@query
def backtest(spark, d):
    """M5, W9, M10"""
    return scoring.backtest(readings(spark, d))


@query
def backtest_cut(spark, d):
    """M5, W9 with every series above 20 rows cut into pieces"""
    return scoring.backtest(readings(spark, d), max_rows=20)


@query
def history_window(spark, d):
    """M6, P2"""
    return scoring.history(readings(spark, d), hours=168)


@query
def last_forecasts(spark, d):
    """W6"""
    return scoring.last_forecasts(scoring.backtest(readings(spark, d)), 48)


@query
def look_back_rows(spark, d):
    """S5, P1-P3"""
    rows = cleaning.look_back(readings(spark, d), 340)
    return rows.select("timestamp", "city_slug", "aqi", *POLLUTANTS)


# --- metrics --------------------------------------------------------------------------------------


@query
def prf_per_class(spark, d):
    """A12"""
    return metrics.per_class_scores(scoring.backtest(readings(spark, d)))


@query
def prf_weighted(spark, d):
    """A12"""
    return metrics.overall_scores(scoring.backtest(readings(spark, d)))


@query
def prf_by_window(spark, d):
    """A12 for 24, 48, 72 and 168 hours"""
    rows = readings(spark, d)
    windows = metrics.by_window(scoring.backtest(rows), newest=rows)
    return metrics.overall_scores(windows, ["window_hours"])


@query
def daily_accuracy(spark, d):
    """A13"""
    return metrics.daily_accuracy(scoring.backtest(readings(spark, d)))


@query
def accuracy_trend(spark, d):
    """A13 over the last two weeks"""
    return metrics.accuracy_trend(scoring.backtest(readings(spark, d)), weeks=2)


@query
def accuracy_summary(spark, d):
    """A14"""
    return metrics.accuracy_summary(metrics.daily_accuracy(scoring.backtest(readings(spark, d))))


def _score_log(spark, d):
    """Silver filled by four batches, the third run twice: late hours, then corrected classes, then the newest hours."""
    rows = _stored(spark, silver(spark, d))
    part = F.crc32(F.concat("city_slug", F.unix_timestamp("timestamp").cast("string")).cast("binary")) % 5
    last = rows.agg(F.unix_micros(F.max("timestamp"))).first()[0]
    newest = F.col("timestamp") >= F.timestamp_micros(F.lit(last).cast("long")) - F.expr("INTERVAL 2 DAYS")
    first = rows.where(~newest & part.isin(0, 1)).withColumn("aqi", F.when(part == 1, 6 - F.col("aqi") % 3).otherwise(F.col("aqi")))
    batches = {
        "first": first,
        "late": rows.where(~newest & part.isin(2, 3, 4)),
        "corrected": rows.where(~newest & part.isin(1, 2)),
        "newest": rows.where(newest),
    }
    path, log = workspace(spark, "silver"), score_plans.ScoreLog(spark, workspace(spark, "scores"))
    for name, batch in batches.items():
        score_plans.merge_and_score(spark, path, log, name, batch)
        if name == "corrected":
            score_plans.merge_and_score(spark, path, log, name, batch)
            log.fold()
    return log


@query
def increment_cells(spark, d):
    """Counts by station, day, class read and class forecast after four batches"""
    return _score_log(spark, d).cells()


@query
def increment_scores(spark, d):
    """Scores per station and class from the cells"""
    return increments.per_class_scores(_score_log(spark, d).cells(), ["city_slug"])


# --- drift ----------------------------------------------------------------------------------------


@query
def drift_features_keyed(spark, d):
    """A8"""
    return drift_ops.Drift(readings(spark, d), 7).features()


@query
def drift_features_pooled(spark, d):
    """A8, C11"""
    return drift_ops.Drift(readings(spark, d), 7, pooled=True).features()


@query
def drift_features_pooled_1d(spark, d):
    """A8 with one-day windows"""
    return drift_ops.Drift(readings(spark, d), 1, pooled=True).features()


@query
def drift_class_share(spark, d):
    """A9"""
    return drift_ops.Drift(readings(spark, d), 7).classes()


@query
def drift_class_share_pooled(spark, d):
    """A9"""
    return drift_ops.Drift(readings(spark, d), 7, pooled=True).classes()


@query
def drift_prediction_share(spark, d):
    """A10"""
    return drift_ops.Drift(readings(spark, d), 7).predictions()


@query
def drift_prediction_share_pooled(spark, d):
    """A10"""
    return drift_ops.Drift(readings(spark, d), 7, pooled=True).predictions()


@query
def drift_windows(spark, d):
    """A11, W7"""
    return drift_ops.Drift(readings(spark, d), 7).windows()


# --- drift from daily moments ---------------------------------------------------------------------


def _moment_drift(spark, d, days, pooled):
    """The daily state and the rows by day, each written once."""
    rows = _stored(spark, moments.drift_rows(readings(spark, d)))
    return moments.MomentDrift(_stored(spark, moments.daily_moments(rows)), rows, days, pooled)


@query
def moments_features_keyed(spark, d):
    """A8 from daily moments, seven days"""
    return _moment_drift(spark, d, 7, False).features()


@query
def moments_features_pooled(spark, d):
    """A8, C11 from daily moments, seven days"""
    return _moment_drift(spark, d, 7, True).features()


@query
def moments_features_pooled_1d(spark, d):
    """A8 from daily moments, one day"""
    return _moment_drift(spark, d, 1, True).features()


@query
def moments_class_share(spark, d):
    """A9 from daily moments"""
    return _moment_drift(spark, d, 7, False).classes()


@query
def moments_windows(spark, d):
    """A11, W7 from daily moments"""
    return _moment_drift(spark, d, 7, False).windows()


# --- cleaning and sources -------------------------------------------------------------------------


def _changes(events: DataFrame) -> DataFrame:
    """A later delivery for every third event: new values, some of them missing, and new hours."""
    again = events.where(F.col("event_id") % 3 == 0)
    rows = events_as_readings(again)
    moved = rows.withColumn(
        "timestamp", F.when(F.col("aqi") == 6, F.col("timestamp") + F.expr("INTERVAL 100 DAYS")).otherwise(F.col("timestamp"))
    )
    return moved.withColumns(
        {"co": F.col("no"), "no": F.col("co"), "city": F.concat(F.lit("New "), F.col("city")), "source": F.lit("hourly")}
    )


def _upsert_sides(spark, d):
    events = table(spark, d, "events")
    target = events_as_readings(events.where(F.col("event_id") % 2 == 0))
    return target, _changes(events)


@query
def upsert_silver(spark, d):
    """K4, J3"""
    return upsert_ops.upsert(*_upsert_sides(spark, d))


@query
def upsert_table(spark, d):
    """K3, K4 on a table partitioned by month, written twice, S5"""
    target, changes = _upsert_sides(spark, d)
    path = workspace(spark, "silver")
    sinks.seed_silver(spark, target, path)
    upsert_ops.upsert_table(spark, path, changes, SILVER)
    return sources.read_silver(spark, path, clamp=False)


@query
def dedup_keep_first(spark, d):
    """U2"""
    lines = table(spark, d, "lineitem")
    return cleaning.dedup_keep_first(lines, ["l_orderkey", "l_linenumber"], lines.columns)


@query
def clean_bronze(spark, d):
    """P5-P10, U1, U2 on two overlapping deliveries of text"""
    rows = silver(spark, d)
    first = rows.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "city", "city_slug",
        F.when(F.col("aqi") == 6, "bad").otherwise(F.concat(F.col("aqi"), F.lit(".5"))).alias("aqi"),
        *[F.col(c).cast("string").alias(c) for c in POLLUTANTS if c != "nh3"],
        F.lit("a").alias("_file"), F.lit(0).cast("long").alias("_row"),
    )
    second = rows.where(F.col("source") == "hourly").select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "city",
        F.when(F.col("aqi") > 1, F.col("city_slug")).alias("city_slug"),
        F.lit("3").alias("aqi"), F.lit("x").alias("co"),
        F.lit("b").alias("_file"), F.lit(0).cast("long").alias("_row"),
    )
    return cleaning.clean_readings(cleaning.union_all([first, second]))


@query
def hourly_partitions(spark, d):
    """K2, S2, S4; the afternoons are delivered a second time"""
    path = workspace(spark, "hourly")
    rows = silver(spark, d).withColumn("dt", F.unix_timestamp("timestamp"))
    sinks.write_hourly(spark, rows, path)
    sinks.write_hourly(spark, rows.where(F.hour("timestamp") >= 12), path)
    back = sources.read_hourly(spark, path)
    parts = [c.alias(f"path_{n}") for c, n in zip(sources.partition_of("_file"), ("year", "month", "day"))]
    return back.select("*", *parts).groupBy("year", "month", "day", "path_year", "path_month", "path_day").agg(
        F.count("*").alias("n"), F.sum("dt").alias("sum_dt")
    )


@query
def bulk_partitions(spark, d):
    """K1, S1, H11"""
    path = workspace(spark, "bulk")
    rows = silver(spark, d).withColumn("dt", F.unix_timestamp("timestamp"))
    sinks.write_bulk(rows.drop("source"), path)
    back = sources.read_bulk(spark, path)
    return back.groupBy("city_slug", "year", "month").agg(F.count("*").alias("n"), F.sum("pm10").alias("pm10"))


@query
def json_flatten(spark, d):
    """S9, H1, H15"""
    rows = silver(spark, d)
    record = F.struct(
        F.unix_timestamp("timestamp").alias("dt"),
        F.struct("aqi").alias("main"),
        F.struct(*POLLUTANTS).alias("components"),
    )
    lines = rows.select(F.to_json(F.struct("city", "city_slug", F.array(record).alias("list"))).alias("value"))
    return responses.flatten_air(responses.parse_responses(lines, AIR_RESPONSE))


@query
def weather_flatten(spark, d):
    """S10, H12"""
    k = F.get_json_object("props", "$.k").cast("double")
    record = F.struct(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("dt"),
        F.struct(F.col("value").alias("temp"), k.alias("humidity")).alias("main"),
        F.struct(k.alias("speed")).alias("wind"),
        F.when(F.col("event_type") == "click", F.struct(F.col("value").alias("1h"))).alias("rain"),
        F.array(F.struct(F.col("user_id").cast("int").alias("id"), F.col("event_type").alias("main"))).alias("weather"),
    )
    lines = table(spark, d, "events").select(
        F.to_json(F.struct(F.col("event_id").cast("string").alias("city_slug"), F.array(record).alias("list"))).alias("value")
    )
    return responses.flatten_weather(responses.parse_responses(lines, WEATHER_RESPONSE)).select(
        "city_slug", "dt", "timestamp", "temp_c", "humidity_pct", "dew_point_c", "wind_speed_ms", "wind_gust_ms",
        "rain_1h_mm", "snow_1h_mm", "weather_id", "weather_main",
    )


def _lines_of_any_shape(spark, d):
    """One air response per event, its shape by the event's number: cut off, no list, added, missing and retyped fields."""
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).selectExpr(
        """CASE WHEN k % 8 = 0 THEN '{"city_slug":"user-' || user_id ELSE
           '{"city":"User ' || user_id || '","city_slug":"user-' || user_id || '","list":' ||
           CASE WHEN k % 8 = 5 THEN '5}' ELSE
             '[{"dt":' || unix_timestamp(CAST(ts AS TIMESTAMP)) || ',"main":' ||
             CASE k % 8 WHEN 3 THEN '{"aqi":"' || (1 + k % 6) || '"}' WHEN 4 THEN '"none"' ELSE '{"aqi":' || (1 + k % 6) || '}' END ||
             CASE k % 8 WHEN 1 THEN ',"components":{"co":' || k || '.5,"dust":' || k || '},"note":"n"'
                        WHEN 2 THEN ''
                        WHEN 3 THEN ',"components":{"pm10":"' || k || '.25"}'
                        WHEN 4 THEN ',"components":{"pm10":"n/a","o3":null}'
                        ELSE ',"components":{"pm10":' || k || '}' END || '}]}' END END AS value"""
    )


@query
def landed_any_shape(spark, d):
    """Known fields of responses whose shape changes"""
    return responses.flatten_air(variants.read_any(_lines_of_any_shape(spark, d), AIR_RESPONSE)[0])


@query
def landed_unread(spark, d):
    """What the known fields leave out"""
    return variants.unread_values(variants.read_any(_lines_of_any_shape(spark, d), AIR_RESPONSE)[0])


@query
def landed_rejects(spark, d):
    """Lines that hold no records"""
    return variants.read_any(_lines_of_any_shape(spark, d), AIR_RESPONSE)[1]


def _prediction_lines(spark, d):
    """One buffered line per event; some are cut off, some lack a field."""
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    later = F.date_format(F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, d, "events").select(
        F.concat(F.lit("user-"), "user_id").alias("city_slug"),
        iso.alias("as_of"),
        later.alias("forecast_for"),
        F.when(F.col("event_type") != "error", 1 + k % 5).alias("predicted"),
        (k / 128.0).alias("confidence"),
        k.alias("k"),
    )
    whole = F.to_json(F.struct("city_slug", "as_of", "forecast_for", "predicted", "confidence"))
    return rows.select(F.when(F.col("k") % 11 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))


@query
def parse_predictions(spark, d):
    """S13, H13"""
    return responses.parse_predictions(_prediction_lines(spark, d))[0]


@query
def rejected_predictions(spark, d):
    """S13, C15"""
    rejects = responses.parse_predictions(_prediction_lines(spark, d))[1]
    return rejects.groupBy(F.length("line").alias("chars")).agg(F.count("*").alias("n"))


@query
def append_predictions(spark, d):
    """The same batch appended twice"""
    path = workspace(spark, "gold")
    good = responses.parse_predictions(_prediction_lines(spark, d))[0]
    for _ in range(2):
        sinks.append_predictions(spark, good, path)
    return sources.read_predictions(spark, path)


@query
def append_horizons(spark, d):
    """K5: three hours forecast at each moment, appended twice"""
    path = workspace(spark, "gold")
    good = responses.parse_predictions(_prediction_lines(spark, d))[0]
    hours = F.explode(F.sequence(F.lit(0), F.lit(2)))
    later = F.col("forecast_for") + F.make_interval(hours=F.col("h"))
    rows = good.withColumn("h", hours).withColumn("forecast_for", later).drop("h")
    for _ in range(2):
        sinks.append_predictions(spark, rows, path)
    return sources.read_predictions(spark, path)


@query
def hourly_split_delivery(spark, d):
    """K2: stations of the same hours arrive in two batches, the first batch twice"""
    path = workspace(spark, "hourly")
    rows = silver(spark, d).withColumn("dt", F.unix_timestamp("timestamp"))
    first = F.crc32(F.col("city_slug").cast("binary")) % 2 == 0
    for part in (first, ~first, first):
        sinks.write_hourly(spark, rows.where(part), path)
    back = sources.read_hourly(spark, path)
    return back.select("city_slug", "timestamp", "aqi", "pm10", "year", "month", "day")


# --- joins and reports ----------------------------------------------------------------------------


def _forecasts(spark, d):
    """Two forecasts for every event hour: the second was made later."""
    rows = readings(spark, d)
    first = rows.select(
        F.col("timestamp").alias("forecast_for"), "city_slug",
        F.when(F.col("aqi") < 5, F.col("aqi") + 1).otherwise(1).alias("predicted"),
        (F.col("no") / 4).alias("confidence"),
        (F.col("timestamp") - F.expr("INTERVAL 2 HOURS")).alias("as_of"),
    )
    second = first.withColumn("predicted", F.lit(3)).withColumn("as_of", F.col("as_of") + F.expr("INTERVAL 1 HOUR"))
    return first.unionByName(second.where(F.col("confidence") < 0.5))


@query
def dedup_predictions(spark, d):
    """U3"""
    return cleaning.newest_forecast(_forecasts(spark, d))


@query
def predicted_vs_actual(spark, d):
    """J1"""
    return joins.predicted_vs_actual(_forecasts(spark, d), readings(spark, d))


@query
def predicted_vs_actual_latest(spark, d):
    """J1 + T1: the twenty newest"""
    joined = joins.predicted_vs_actual(_forecasts(spark, d), readings(spark, d))
    return reports.latest_readings(joined, 20, "forecast_for")


@query
def dimension_lookup(spark, d):
    """J4"""
    nation = table(spark, d, "nation").where(F.col("n_regionkey") != 2)
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return joins.lookup(customers, nation, "c_nationkey", "n_nationkey", {"n_name": "—"})


@query
def known_keys_only(spark, d):
    """P4, J5"""
    nation = table(spark, d, "nation").where(F.col("n_regionkey") != 2)
    return cleaning.known_keys(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "n_nationkey")


@query
def unknown_keys(spark, d):
    """P4"""
    nation = table(spark, d, "nation").where(F.col("n_regionkey") != 2)
    return cleaning.unknown_keys(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "n_nationkey")


@query
def left_enrich_by_time(spark, d):
    """J2 with orders as weather and shipped lines as air, per customer and order"""
    orders = table(spark, d, "orders")
    wx = orders.where(F.col("o_custkey") % 5 != 0).select(
        F.col("o_custkey").alias("station"), F.col("o_orderkey").alias("dt"), F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("temp_c"),
    )
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("co"), F.max("l_shipdate").alias("timestamp")
    )
    air = lines.join(orders.select("o_orderkey", "o_custkey"), lines.l_orderkey == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("station"), F.col("o_orderkey").alias("dt"), "timestamp", "co"
    )
    return joins.weather_with_air(wx, air, "station")


@query
def chunk_plan(spark, d):
    """One plan per order priority"""
    ranges = table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.min("o_orderdate").cast("timestamp").alias("start"), F.max("o_orderdate").cast("timestamp").alias("end")
    )
    return chunks.chunk_plan(ranges, "start", "end").select("o_orderpriority", "chunk_start", "chunk_end")


@query
def rows_by_source(spark, d):
    """A3"""
    return reports.rows_by_source(table(spark, d, "documents"))


@query
def latest_readings(spark, d):
    """T1"""
    return reports.latest_readings(readings(spark, d).select("city", "city_slug", "aqi", "timestamp"), 10)


@query
def freshness(spark, d):
    """A17"""
    return reports.freshness(readings(spark, d))


@query
def forecast_counts(spark, d):
    """A18"""
    return reports.forecast_counts(_forecasts(spark, d))


@query
def coverage(spark, d):
    """A16, K9"""
    return reports.coverage(readings(spark, d))


# --- streams --------------------------------------------------------------------------------------


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return ingest.new_readings(spark, d, schema, glob="events.parquet")


@query
def stream_upsert(spark, d):
    """The events as a stream, merged into a table that already holds half of them"""
    path = workspace(spark, "silver")
    events = table(spark, d, "events")
    half = events_as_readings(events.where(F.col("event_id") % 2 == 0)).withColumn("city", F.lit("old"))
    sinks.seed_silver(spark, half.withColumn("aqi", F.lit(6)), path)
    query = ingest.upsert_stream(
        _event_stream(spark, d), path, workspace(spark, "checkpoint"), to_reading=events_as_readings
    )
    query.awaitTermination()
    return sources.read_silver(spark, path, clamp=False)


# Files that a delivery lands in, at most: a batch per file rewrites the months it touches, so their number must not grow with the rows.
LANDED_FILES = 4


def _redelivered(spark, d, files_per_batch):
    """The events, then those with an even id again with class 1; merged as a stream after each delivery."""
    land, path, checkpoint = (workspace(spark, n) for n in ("land", "silver", "checkpoint"))
    events = table(spark, d, "events")
    again = events.where(F.col("event_id") % 2 == 0).withColumn("props", F.lit('{"k": 0}'))
    for delivery in (events, again):
        delivery.coalesce(LANDED_FILES).write.mode("append").parquet(land)
        stream = ingest.new_readings(spark, land, events.schema, files_per_batch)
        ingest.upsert_stream(stream, path, checkpoint, to_reading=events_as_readings).awaitTermination()
    return sources.read_silver(spark, path, clamp=False).select("city_slug", "timestamp", "aqi", "no")


@query
def stream_redelivery(spark, d):
    """R2: the newest delivery wins, file by file and in one batch"""
    return _redelivered(spark, d, 1).withColumn("files", F.lit(1)).unionByName(
        _redelivered(spark, d, 1000).withColumn("files", F.lit(1000))
    )


@query
def stream_forecasts(spark, d):
    """Forecasts appended after the micro-batch"""
    silver_path, gold_path = workspace(spark, "silver"), workspace(spark, "gold")
    query = ingest.upsert_stream(
        _event_stream(spark, d), silver_path, workspace(spark, "checkpoint"), gold_path, to_reading=events_as_readings
    )
    query.awaitTermination()
    return sources.read_predictions(spark, gold_path)


@query
def stream_lag_state(spark, d):
    """Forecasts from stream state after three deliveries: the newest days, then late ones and the last day again"""
    land, gold, checkpoint = (workspace(spark, n) for n in ("land", "gold", "checkpoint"))
    events = table(spark, d, "events")
    newest = events.agg(F.max("ts")).first()[0]
    at = {n: F.col("ts") < F.lit(newest - dt.timedelta(days=n)) for n in (1, 2, 4)}
    again = events.where(~at[1]).withColumn("props", F.lit('{"k": 0}'))
    for delivery in (events.where(at[4]), events.where(~at[2]), events.where(~at[4] & at[2]).unionByName(again)):
        delivery.write.mode("append").parquet(land)
        stream = events_as_readings(ingest.new_readings(spark, land, events.schema))
        lag_state.forecast_stream(stream, gold, checkpoint).awaitTermination()
    return sources.read_predictions(spark, gold)


def _joined_streams(spark, d, first):
    """Forecasts and readings as streams, ``first`` a delivery before the other; one far row of each moves the watermarks on."""
    known = readings(spark, d).select(*READING.fieldNames())
    whole = {"forecasts": _forecasts(spark, d).select(*PREDICTION.fieldNames()), "readings": known}
    later = F.expr("INTERVAL 1000 DAYS")
    ahead = {
        "forecasts": whole["forecasts"].limit(1).withColumn("forecast_for", F.col("forecast_for") + later),
        "readings": known.limit(1).withColumn("timestamp", F.col("timestamp") + later + F.expr("INTERVAL 1 SECOND")),
    }
    land = {n: workspace(spark, n) for n in whole}
    out, checkpoint = workspace(spark, "joined"), workspace(spark, "checkpoint")
    second = next(n for n in whole if n != first)
    for step in ([(first, whole)], [(second, whole)], [(n, ahead) for n in whole]):
        for n, path in land.items():
            # An empty file at first: a stream needs its folder.
            (dict(step)[n][n] if n in dict(step) else whole[n].limit(0)).write.mode("append").parquet(path)
        sides = [spark.readStream.schema(whole[n].schema).parquet(land[n]) for n in whole]
        stream_joins.write_joined(stream_joins.predicted_vs_actual_stream(*sides), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).withColumn("first", F.lit(first))


@query
def stream_join(spark, d):
    """J1 on streams: forecasts before readings, and readings before forecasts"""
    return _joined_streams(spark, d, "forecasts").unionByName(_joined_streams(spark, d, "readings"))


def _repeating(spark, d):
    """Every order line as a reading of its part; a part's readings of one day repeat."""
    lines = table(spark, d, "lineitem")
    return lines.select(
        F.concat(F.lit("part-"), "l_partkey").alias("city_slug"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_quantity").alias("pm10"),
    )


@query
def stream_drop_repeats(spark, d):
    """Lines as readings of their part; one row per part and day is left of a stream"""
    land, out = workspace(spark, "land"), workspace(spark, "out")
    rows = _repeating(spark, d)
    rows.write.parquet(land)
    stream = ingest.drop_repeats(spark.readStream.schema(rows.schema).parquet(land), delay="5000 days")
    stream.select("city_slug", "timestamp").writeStream.format("parquet").option(
        "checkpointLocation", workspace(spark, "checkpoint")
    ).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@query
def one_file(spark, d):
    """S3: of two delivered files the rows of one, all columns"""
    path = workspace(spark, "land")
    for name, source in (("first", "pipeline"), ("second", "hourly")):
        silver(spark, d).where(F.col("source") == source).write.parquet(f"{path}/{name}")
    both = spark.read.parquet(f"{path}/first", f"{path}/second")
    files = [f for f in both.inputFiles() if "/second/" in f]
    return cleaning.union_all([sources.only_file(both, f) for f in files])


@query
def station_zones(spark, d):
    """Customers as stations, nations as their zones; UTC where there is none"""
    customers = table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.concat(F.lit("c-"), "c_custkey").alias("slug"), F.col("c_acctbal").alias("lat"),
        (F.col("c_acctbal") / 2).alias("lon"), F.lit("none").alias("timezone"),
    )
    nation = table(spark, d, "nation").where(F.col("n_regionkey") != 2)
    zones = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("c-"), "c_custkey").alias("slug"), F.col("n_name").alias("timezone")
    )
    return dimensions.with_timezones(customers, zones)


@query
def silver_of_stations(spark, d):
    """The look-back of some stations from silver, all columns"""
    path = workspace(spark, "silver")
    sinks.seed_silver(spark, silver(spark, d), path)
    return sources.read_silver(spark, path, 200, [f"user-{n}" for n in range(1, 60, 2)])


@query
def weather_all_columns(spark, d):
    """All 21 columns, every one of them filled from the events"""
    k = F.get_json_object("props", "$.k").cast("double")
    v = F.col("value")
    main = {"temp": v, "feels_like": v - 1, "temp_min": v - 2, "temp_max": v + 2, "pressure": k + 1000, "sea_level": k + 1001, "grnd_level": k + 990, "humidity": k}
    record = F.struct(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("dt"),
        F.struct(*[x.alias(n) for n, x in main.items()]).alias("main"),
        F.struct(k.alias("speed"), (k * 3).alias("deg"), F.when(k > 50, k + 5).alias("gust")).alias("wind"),
        F.struct((k / 2).alias("all")).alias("clouds"),
        (k * 100).alias("visibility"),
        F.when(F.col("event_type") == "click", F.struct(v.alias("1h"))).alias("rain"),
        F.when(F.col("event_type") == "view", F.struct((v / 2).alias("1h"))).alias("snow"),
        F.when(k > 3, F.array(F.struct(F.col("user_id").cast("int").alias("id"), F.col("event_type").alias("main"), F.concat(F.lit("about "), "event_type").alias("description")), F.struct(F.lit(0).alias("id"), F.lit("x").alias("main"), F.lit("y").alias("description")))).alias("weather"),
    )
    lines = table(spark, d, "events").select(
        F.to_json(F.struct(F.col("event_type").alias("city"), F.col("event_id").cast("string").alias("city_slug"), F.array(record).alias("list"))).alias("value")
    )
    return responses.flatten_weather(responses.parse_responses(lines, WEATHER_RESPONSE))


@query
def hourly_rows(spark, d):
    """Every row and column read back after two deliveries"""
    path = workspace(spark, "hourly")
    rows = silver(spark, d).withColumn("dt", F.unix_timestamp("timestamp"))
    sinks.write_hourly(spark, rows, path)
    sinks.write_hourly(spark, rows.where(F.hour("timestamp") >= 12), path)
    return sources.read_hourly(spark, path).drop("_file", "_row")


@query
def bulk_rows(spark, d):
    """Every row and column read back"""
    path = workspace(spark, "bulk")
    sinks.write_bulk(silver(spark, d).withColumn("dt", F.unix_timestamp("timestamp")).drop("source"), path)
    return sources.read_bulk(spark, path).drop("_file", "_row")


@query
def upsert_all_rows(spark, d):
    """All events as the target, every third again and another tenth only in the batch"""
    events = table(spark, d, "events")
    only_new = F.pmod(F.col("event_id"), F.lit(10)) == 7
    changes = _changes(events).unionByName(events_as_readings(events.where(only_new & (F.col("event_id") % 3 != 0))))
    return upsert_ops.upsert(events_as_readings(events.where(~only_new)), changes)


@query
def stream_predictions(spark, d):
    """Buffered lines drained to gold; the number of rejects rides along"""
    land, gold, rejects = (workspace(spark, n) for n in ("land", "gold", "rejects"))
    _prediction_lines(spark, d).write.text(land)
    drain.drain(drain.prediction_lines(spark, land), gold, rejects, workspace(spark, "checkpoint")).awaitTermination()
    rejected = spark.read.parquet(rejects).agg(F.count("*").alias("rejected"))
    return sources.read_predictions(spark, gold).withColumn("rejected", rejected.scalar())


# --- a forest as a relation -----------------------------------------------------------------------


def _nodes(spark):
    return spark.createDataFrame(small_forest.rows(), forest_ops.NODE)


@query
def forest_shares(spark, d):
    """Shares of every class for every reading, trees walked in one block and one by one"""
    rows = feature_ops.serving_features(readings(spark, d))
    made = forest_ops.shares(forest_ops.shares(rows, _nodes(spark), to="at_once"), _nodes(spark), most=1, to="by_tree")
    parts = [c.alias(f"{n}_{c_}") for n in ("at_once", "by_tree") for c, c_ in zip(forest_ops.share_columns(F.col(n)), range(1, 6))]
    return made.select("city_slug", "timestamp", *parts)


@query
def forest_forecasts(spark, d):
    """Back-test of the forest"""
    return scoring.backtest(readings(spark, d), forest_ops.forest_forecaster(_nodes(spark)))


@query
def forest_latest(spark, d):
    """Latest forecasts with confidence and all probabilities"""
    made = scoring.latest_forecast(readings(spark, d), forest_ops.forest_forecaster(_nodes(spark)))
    return made.select(
        "city_slug", "as_of", "forecast_for", "predicted", "predicted_label", "predicted_color", "confidence",
        *[F.element_at("probabilities", str(c)).alias(f"p{c}") for c in range(1, 6)],
    )


@query
def forest_importance(spark, d):
    """Importances with the cover counted on the readings"""
    rows = feature_ops.serving_features(readings(spark, d))
    nodes = _nodes(spark)
    return importance_ops.importances(forest_ops.with_cover(nodes, forest_ops.paths(rows, nodes)))


# --- read side ------------------------------------------------------------------------------------


def _routes(spark, d):
    """Routes over silver; every user is a station, those with an odd number without a time zone."""
    path = workspace(spark, "silver")
    sinks.seed_silver(spark, silver(spark, d), path)
    users = table(spark, d, "events").select("user_id").distinct()
    stations = users.select(
        F.concat(F.lit("Place "), "user_id").alias("name"), F.concat(F.lit("user-"), "user_id").alias("slug"),
        F.col("user_id").cast("double").alias("lat"), (-F.col("user_id")).cast("double").alias("lon"),
        F.when(F.col("user_id") % 2 == 0, "Asia/Tokyo").alias("timezone"),
    )
    return Routes(spark, path, stations=stations)


@query
def route_cities(spark, d):
    """Section 2.13, cities; S7"""
    return _routes(spark, d).cities()


@query
def route_predict(spark, d):
    """Section 2.13, predict: one station's forecast with its name and zone"""
    made = _routes(spark, d).predict("user-7")
    return made.select(*[c for c in made.columns if c != "probabilities"], *[F.element_at("probabilities", str(c)).alias(f"p{c}") for c in range(1, 6)])


@query
def route_history(spark, d):
    """Section 2.13, history: one station's last 168 hours"""
    return _routes(spark, d).history("user-7", 168)


@query
def route_drift(spark, d):
    """Section 2.13, drift over all stations, seven days"""
    return _routes(spark, d).drift("7d")["features"]


@query
def route_model_metrics(spark, d):
    """Section 2.13, model-metrics over 168 hours"""
    return _routes(spark, d).model_metrics(168)["weighted"]


@query
def route_accuracy_trend(spark, d):
    """Section 2.13, accuracy-trend over two weeks"""
    return _routes(spark, d).accuracy_trend(2)["trend"]


# --- models (no SQL form) -------------------------------------------------------------------------


def _fitted(spark, d, path):
    rows = _stored(spark, _labelled(spark, d))
    medians = quantiles.median_values(rows, FEATURES)
    model = training.fit(training.impute(training.with_weights(rows), medians))
    artifacts.save_artifacts(spark, model, medians, path)
    return artifacts.load_artifacts(spark, path)


@query
def train_and_score(spark, d):
    """M1-M5, K7, S12, H16"""
    model, medians = _fitted(spark, d, workspace(spark, "model"))
    return scoring.backtest(readings(spark, d), scoring.forecaster(model), medians)


@query
def importance(spark, d):
    """A15, M7, K8"""
    path = workspace(spark, "model")
    _fitted(spark, d, path)
    found = importance_ops.importances(importance_ops.read_nodes(spark, f"{path}/model"))
    snapshots = workspace(spark, "importance")
    for at in ("2026-01-01T00", "2026-01-02T00"):
        sinks.append_snapshot(found, snapshots, at)
    return sinks.last_snapshots(spark.read.parquet(snapshots))
