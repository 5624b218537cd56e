"""Model inputs from readings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from stationcast.functions import clamp_class, cyclic, half_even, sample_std, share_of_total
from stationcast.operators.series import MAX_SERIES_ROWS, Profile, over_series
from stationcast.schemas import DEFAULT_MEDIANS, FEATURES, POLLUTANTS, RATIO_EPSILON, TARGET

# One number per feature.
Medians = Mapping[str, float]

LOOK_BACK, LOOK_AHEAD = 3, 2
NEED = ["pm10_lag1", "aqi_lag3", "aqi_roll_std4", TARGET]


def median_of(medians: Medians | None, feature: str) -> float:
    known = DEFAULT_MEDIANS if medians is None else medians
    return float(known.get(feature, 0.1 if feature == "pm25_ratio" else 0.0))


def neighbour_columns(ts: str) -> dict[str, str | tuple[str, str]]:
    """Everything the features need from neighbouring rows, by position."""
    return {
        "aqi_lag1": "lag(aqi, 1)",
        "aqi_lag2": "lag(aqi, 2)",
        "aqi_lag3": "lag(aqi, 3)",
        "pm10_lag1": "lag(pm10, 1)",
        "pm25_lag1": "lag(pm2_5, 1)",
        "aqi_std4": ("stddev_samp(aqi)", "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW"),
        "aqi_next": "lead(aqi, 1)",
        "aqi_next2": "lead(aqi, 2)",
        "ts_lag1": f"lag(`{ts}`, 1)",
        "ts_lag2": f"lag(`{ts}`, 2)",
        "ts_lag3": f"lag(`{ts}`, 3)",
        "ts_next": f"lead(`{ts}`, 1)",
    }


def with_neighbours(
    df: DataFrame,
    key: str = "city_slug",
    ts: str = "timestamp",
    stats: Profile | None = None,
    max_rows: int = MAX_SERIES_ROWS,
    max_gap: str | None = None,
    only: list[str] | None = None,
) -> DataFrame:
    """Readings with lagged and leading values.

    Neighbours are positional: a missing hour is not noticed unless ``max_gap`` (such as
    ``'1 hour'``) is given, which empties values that lie further away than that per step.
    """
    columns = neighbour_columns(ts)
    if only is not None and max_gap is None:
        columns = {name: columns[name] for name in only}
    rows = over_series(df, key, ts, columns, LOOK_BACK, LOOK_AHEAD, stats, max_rows)
    if max_gap is None:
        return rows
    gap = F.expr(f"INTERVAL {max_gap}")
    near = {k: F.col(ts) - F.col(f"ts_lag{k}") <= gap * k for k in (1, 2, 3)}
    blank = {f"aqi_lag{k}": near[k] for k in near}
    blank |= {"pm10_lag1": near[1], "pm25_lag1": near[1]}
    blank["aqi_next"] = F.col("ts_next") - F.col(ts) <= gap
    rows = rows.withColumns({name: F.when(ok, F.col(name)) for name, ok in blank.items()})
    return rows.withColumn("aqi_std4", sample_std(["aqi", "aqi_lag1", "aqi_lag2", "aqi_lag3"]))


def _calendar(ts: str, digits: int | None) -> dict[str, Column]:
    hour, month = cyclic(f"hour(`{ts}`)", 24), cyclic(f"month(`{ts}`)", 12)
    columns = {"hour_sin": hour[0], "hour_cos": hour[1], "month_sin": month[0], "month_cos": month[1]}
    return columns if digits is None else {n: half_even(c, digits) for n, c in columns.items()}


def _sql(expressions: Mapping[str, str]) -> dict[str, Column]:
    return {name: F.expr(e) for name, e in expressions.items()}


def training_features(
    df: DataFrame,
    key: str = "city_slug",
    ts: str = "timestamp",
    stats: Profile | None = None,
    max_rows: int = MAX_SERIES_ROWS,
    max_gap: str | None = None,
) -> DataFrame:
    """Features and label for fitting, with rows that lack a needed neighbour dropped.

    Other nulls stay and are imputed later. ``aqi`` must be clamped already.
    """
    rows = with_neighbours(df, key, ts, stats, max_rows, max_gap)
    made = {
        "pm25_ratio": half_even(share_of_total("pm2_5", ["pm10", "no2", "o3", "so2"]), 4),
        **_calendar(ts, 6),
        "aqi_roll_std4": half_even("aqi_std4", 4),
        **_sql(
            {
                "aqi_delta_1h": "CAST(aqi - aqi_lag1 AS DOUBLE)",
                "aqi_delta_2h": "CAST(aqi - aqi_lag2 AS DOUBLE)",
                "aqi_delta_3h": "CAST(aqi - aqi_lag3 AS DOUBLE)",
                "pm10_delta_1h": "pm10 - pm10_lag1",
                "pm25_delta_1h": "pm2_5 - pm25_lag1",
            }
        ),
    }
    return (
        rows.withColumns(made)
        .dropna(subset=NEED)
        .select(key, ts, "aqi", TARGET, "aqi_next2", *FEATURES)
    )


def serving_features(
    df: DataFrame,
    medians: Medians | None = None,
    key: str = "city_slug",
    ts: str = "timestamp",
    stats: Profile | None = None,
    max_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Features for scoring every row that has three rows before it; missing inputs are filled.

    Next to the features come ``aqi`` as read, ``aqi_next`` and ``ts_next`` of the following row
    (null for the last one). NaN counts as missing.
    """
    rows = with_neighbours(
        without_nan(df), key, ts, stats, max_rows,
        only=["aqi_lag1", "aqi_lag2", "aqi_lag3", "pm10_lag1", "pm25_lag1", "aqi_next", "ts_next", "ts_lag3"],
    ).where("ts_lag3 IS NOT NULL")
    med = {f: f"{median_of(medians, f)!r}D" for f in FEATURES}
    plain = ["co", "no", "no2", "o3", "so2", "nh3", "pm10"]

    filled = rows.withColumns(
        _sql(
            {
                **{f"_{c}": f"coalesce({c}, {med[c]})" for c in plain},
                # A missing class is taken as the median of the one-hour change.
                "_aqi": f"coalesce(CAST(aqi AS DOUBLE), {med['aqi_delta_1h']})",
                "_lag1": f"coalesce(CAST(aqi_lag1 AS DOUBLE), {med['aqi_delta_1h']})",
                "_pm10_lag1": f"coalesce(pm10_lag1, {med['pm10_lag1']})",
            }
        )
    )
    filled = filled.withColumns(
        _sql(
            {
                "_pm2_5": f"coalesce(pm2_5, {med['pm25_ratio']} * (_pm10 + _no2 + _o3 + _so2 + {RATIO_EPSILON!r}D))",
                "_lag2": "coalesce(CAST(aqi_lag2 AS DOUBLE), _lag1)",
                "_lag3": "coalesce(CAST(aqi_lag3 AS DOUBLE), _lag1)",
            }
        )
    ).withColumns(
        _sql(
            {
                # The four values are whole numbers or a median, so this loses no digits that count.
                "_sum": "_aqi + _lag1 + _lag2 + _lag3",
                "_squares": "_aqi * _aqi + _lag1 * _lag1 + _lag2 * _lag2 + _lag3 * _lag3",
            }
        )
    )
    share = share_of_total("pm2_5", ["_pm10", "_no2", "_o3", "_so2"])
    made = {
        "aqi_roll_std4": half_even(F.sqrt(F.greatest((F.col("_squares") - F.col("_sum") * F.col("_sum") / 4) / 3, F.lit(0.0))), 4),
        "pm25_ratio": half_even(F.coalesce(share, F.expr(med["pm25_ratio"])), 4),
        **_calendar(ts, None),
        **_sql(
            {
                "pm10_lag1": "_pm10_lag1",
                "aqi_delta_1h": "bround(_aqi - _lag1, 4)",
                "aqi_delta_2h": "bround(_aqi - _lag2, 4)",
                "aqi_delta_3h": "bround(_aqi - _lag3, 4)",
                "pm10_delta_1h": "bround(_pm10 - _pm10_lag1, 4)",
                "pm25_delta_1h": "bround(_pm2_5 - coalesce(pm25_lag1, _pm2_5), 4)",
                **{c: f"_{c}" for c in plain},
            }
        ),
    }
    return filled.select(key, ts, "aqi", TARGET, "ts_next", *[made[f].alias(f) for f in FEATURES])


def drift_features(
    df: DataFrame,
    key: str = "city_slug",
    ts: str = "timestamp",
    stats: Profile | None = None,
    max_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Inputs as the drift monitor reads them: nothing filled, nothing rounded."""
    rows = with_neighbours(
        df, key, ts, stats, max_rows, only=["pm10_lag1", "aqi_std4"]
    )
    return rows.withColumns(
        {
            "pm25_ratio": share_of_total("pm2_5", ["pm10", "no2", "o3", "so2"], nulls="null"),
            "aqi_roll_std4": F.col("aqi_std4"),
        }
    )


def without_nan(df: DataFrame) -> DataFrame:
    """Readings with NaN as null."""
    fractions = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float") and f.name in (*POLLUTANTS, "aqi")]
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in fractions})


def readable(df: DataFrame, known_low: bool = False) -> DataFrame:
    """Silver as the operators read it: class cut at 5 (P5)."""
    return df.withColumn("aqi", clamp_class("aqi", 1 if known_low else None))
