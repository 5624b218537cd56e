"""The same results in SQL over the test tables."""

from __future__ import annotations

from stationcast.schemas import CLASSES, DEFAULT_MEDIANS, DRIFT_FEATURES, FEATURES, POLLUTANTS, UNKNOWN_COLOR, UNKNOWN_LABEL
from suite.adapter import READINGS_SQL, sql_round
from suite.forest import values_sql

ORACLE: dict[str, str] = {}

_PI2 = "2 * pi()"


def _settled(x: str, digits: int) -> str:
    """Half-even rounding of a value first settled to five more digits, in whole numbers."""
    v = f"CAST(round(abs({x}) * 1e{digits + 5}) AS BIGINT)"
    up = f"{v} % 100000 > 50000 OR ({v} % 100000 = 50000 AND {v} // 100000 % 2 = 1)"
    return f"(({v} // 100000 + CASE WHEN {up} THEN 1 ELSE 0 END) / 1e{digits} * sign({x}) + 0.0)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _cyclic(part: str, period: int, fn: str, ts: str = '"timestamp"') -> str:
    return f"{fn}({part}({ts}) * ({_PI2} / {period}))"


# --- features -------------------------------------------------------------------------------------

LAGGED = """
lagged AS (
  SELECT *,
    lag(aqi, 1) OVER w AS aqi_lag1, lag(aqi, 2) OVER w AS aqi_lag2, lag(aqi, 3) OVER w AS aqi_lag3,
    lag(pm10, 1) OVER w AS pm10_lag1, lag(pm2_5, 1) OVER w AS pm25_lag1,
    lead(aqi, 1) OVER w AS aqi_next, lead(aqi, 2) OVER w AS aqi_next2,
    lag("timestamp", 1) OVER w AS ts_lag1, lag("timestamp", 2) OVER w AS ts_lag2,
    lag("timestamp", 3) OVER w AS ts_lag3, lead("timestamp", 1) OVER w AS ts_next,
    stddev_samp(aqi) OVER (PARTITION BY city_slug ORDER BY "timestamp" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS std4
  FROM raw
  WINDOW w AS (PARTITION BY city_slug ORDER BY "timestamp")
)"""

_SUM0 = "(coalesce(pm2_5, 0) + coalesce(pm10, 0) + coalesce(no2, 0) + coalesce(o3, 0) + coalesce(so2, 0) + 1e-9::DOUBLE)"


def _train(source: str = "lagged") -> str:
    return f"""
train AS (
  SELECT city_slug, "timestamp", aqi, CAST(aqi_next AS INTEGER) AS aqi_next, aqi_next2,
    pm10_lag1,
    CAST(aqi - aqi_lag1 AS DOUBLE) AS aqi_delta_1h, pm10 - pm10_lag1 AS pm10_delta_1h,
    CAST(aqi - aqi_lag2 AS DOUBLE) AS aqi_delta_2h, CAST(aqi - aqi_lag3 AS DOUBLE) AS aqi_delta_3h,
    round_even(std4, 4) AS aqi_roll_std4, pm2_5 - pm25_lag1 AS pm25_delta_1h,
    round_even({_cyclic('hour', 24, 'sin')}, 6) AS hour_sin, round_even({_cyclic('hour', 24, 'cos')}, 6) AS hour_cos,
    round_even({_cyclic('month', 12, 'sin')}, 6) AS month_sin, round_even({_cyclic('month', 12, 'cos')}, 6) AS month_cos,
    round_even(pm2_5 / {_SUM0}, 4) AS pm25_ratio,
    co, no, no2, o3, so2, nh3, pm10
  FROM {source}
  WHERE pm10_lag1 IS NOT NULL AND aqi_lag3 IS NOT NULL AND std4 IS NOT NULL AND aqi_next IS NOT NULL
)"""


TRAIN = _with(READINGS_SQL, LAGGED, _train())
ORACLE["features_train"] = f'{TRAIN} SELECT city_slug, "timestamp", aqi, aqi_next, aqi_next2, {sql_round(*FEATURES)} FROM train'
ORACLE["features_train_cut"] = ORACLE["features_train"]

_NEAR = """
gapped AS (
  SELECT * REPLACE (
    CASE WHEN n1 THEN aqi_lag1 END AS aqi_lag1, CASE WHEN n2 THEN aqi_lag2 END AS aqi_lag2,
    CASE WHEN n3 THEN aqi_lag3 END AS aqi_lag3, CASE WHEN n1 THEN pm10_lag1 END AS pm10_lag1,
    CASE WHEN n1 THEN pm25_lag1 END AS pm25_lag1,
    CASE WHEN ts_next - "timestamp" <= INTERVAL 12 HOURS THEN aqi_next END AS aqi_next,
    (SELECT stddev_samp(x) FROM unnest([aqi, CASE WHEN n1 THEN aqi_lag1 END, CASE WHEN n2 THEN aqi_lag2 END,
       CASE WHEN n3 THEN aqi_lag3 END]) AS u(x)) AS std4)
  FROM (SELECT *, "timestamp" - ts_lag1 <= INTERVAL 12 HOURS AS n1, "timestamp" - ts_lag2 <= INTERVAL 24 HOURS AS n2,
               "timestamp" - ts_lag3 <= INTERVAL 36 HOURS AS n3 FROM lagged)
)"""
ORACLE["features_max_gap"] = (
    _with(READINGS_SQL, LAGGED, _NEAR, _train("gapped"))
    + f'SELECT city_slug, "timestamp", aqi, aqi_next, aqi_next2, {sql_round(*FEATURES)} FROM train'
)

_M = {f: f"{v}::DOUBLE" for f, v in DEFAULT_MEDIANS.items()}
_PLAIN = ["co", "no", "no2", "o3", "so2", "nh3", "pm10"]
SERVE = f"""
filled AS (
  SELECT city_slug, "timestamp", aqi, aqi_next, ts_next, pm2_5 AS pm25_read,
    {", ".join(f"coalesce({c}, {_M[c]}) AS {c}" for c in _PLAIN)},
    CAST(coalesce(aqi, {_M['aqi_delta_1h']}) AS DOUBLE) AS a0, CAST(coalesce(aqi_lag1, {_M['aqi_delta_1h']}) AS DOUBLE) AS a1,
    CAST(coalesce(aqi_lag2, aqi_lag1, {_M['aqi_delta_1h']}) AS DOUBLE) AS a2,
    CAST(coalesce(aqi_lag3, aqi_lag1, {_M['aqi_delta_1h']}) AS DOUBLE) AS a3,
    coalesce(pm10_lag1, {_M['pm10_lag1']}) AS pm10_lag1, pm25_lag1
  FROM lagged WHERE ts_lag3 IS NOT NULL
),
burden AS (
  SELECT *, coalesce(pm25_read, {_M['pm25_ratio']} * (pm10 + no2 + o3 + so2 + 1e-9::DOUBLE)) AS pm2_5 FROM filled
),
serve AS (
  SELECT city_slug, "timestamp", aqi, aqi_next, ts_next,
    pm10_lag1, round_even(a0 - a1, 4) AS aqi_delta_1h, round_even(pm10 - pm10_lag1, 4) AS pm10_delta_1h,
    round_even(a0 - a2, 4) AS aqi_delta_2h, round_even(a0 - a3, 4) AS aqi_delta_3h,
    round_even(sqrt(((a0 - m) ** 2 + (a1 - m) ** 2 + (a2 - m) ** 2 + (a3 - m) ** 2) / 3), 4) AS aqi_roll_std4,
    round_even(pm2_5 - coalesce(pm25_lag1, pm2_5), 4) AS pm25_delta_1h,
    {_cyclic('hour', 24, 'sin')} AS hour_sin, {_cyclic('hour', 24, 'cos')} AS hour_cos,
    {_cyclic('month', 12, 'sin')} AS month_sin, {_cyclic('month', 12, 'cos')} AS month_cos,
    CASE WHEN pm25_read IS NOT NULL THEN round_even(pm25_read / (pm25_read + pm10 + no2 + o3 + so2 + 1e-9::DOUBLE), 4)
         ELSE {_M['pm25_ratio']} END AS pm25_ratio,
    co, no, no2, o3, so2, nh3, pm10
  FROM (SELECT *, (a3 + a2 + a1 + a0) / 4 AS m FROM burden)
)"""
ORACLE["features_serve"] = (
    _with(READINGS_SQL, LAGGED, SERVE) + f'SELECT city_slug, "timestamp", aqi, aqi_next, {sql_round(*FEATURES)} FROM serve'
)

ORACLE["features_drift"] = _with(READINGS_SQL, LAGGED) + f"""
SELECT city_slug, "timestamp", {sql_round('pm10_lag1')},
  round(pm2_5 / (pm2_5 + pm10 + no2 + o3 + so2 + 1e-9::DOUBLE), 6) + 0.0 AS pm25_ratio,
  round(std4, 6) + 0.0 AS aqi_roll_std4
FROM lagged"""

ORACLE["feature_medians"] = TRAIN + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(median({f}), 6) + 0.0 AS median FROM train" for f in FEATURES
)

ORACLE["rolling_medians"] = TRAIN + " UNION ALL ".join(
    f"SELECT '{until}' AS until, '{f}' AS feature, round(median({f}), 6) + 0.0 AS median FROM train "
    f"WHERE \"timestamp\" > TIMESTAMP '{until}' - INTERVAL 10 DAY AND \"timestamp\" <= TIMESTAMP '{until}'"
    for until in ("2024-01-15 07:30:00", "2024-01-16 07:30:00", "2024-01-17 07:30:00") for f in FEATURES
)

ORACLE["cyclic_time"] = f"""
SELECT event_id, round({_cyclic('hour', 24, 'sin', 'ts')}, 6) + 0.0 AS hour_sin,
  round({_cyclic('hour', 24, 'cos', 'ts')}, 6) + 0.0 AS hour_cos,
  round({_cyclic('month', 12, 'sin', 'ts')}, 6) + 0.0 AS month_sin,
  round({_cyclic('month', 12, 'cos', 'ts')}, 6) + 0.0 AS month_cos
FROM events"""

ORACLE["pollutant_share"] = _with(READINGS_SQL) + f"""
SELECT city_slug, "timestamp", round(round_even(pm2_5 / {_SUM0}, 4), 6) + 0.0 AS share_zero,
  round(pm2_5 / (pm2_5 + pm10 + no2 + o3 + so2 + 1e-9::DOUBLE), 6) + 0.0 AS share_null
FROM raw"""

ORACLE["dew_points"] = """
SELECT event_id, CASE WHEN k <> 0 THEN round(round_even(value - (100 - k) / 5.0::DOUBLE, 2), 6) + 0.0 END AS dew_point_c
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""

# --- training rows --------------------------------------------------------------------------------

LABELLED = """
labelled AS (
  SELECT *, CAST(aqi_next - 1 AS DOUBLE) AS label,
    CASE WHEN aqi IS NOT DISTINCT FROM aqi_next THEN 'steady'
         WHEN aqi_next = coalesce(aqi_next2, aqi_next) THEN 'sustained' ELSE 'single_hop' END AS kind
  FROM train
)"""
WEIGHTED = """
base AS (
  SELECT *, count(*) OVER () / ((SELECT count(DISTINCT label) FROM labelled) * count(*) OVER (PARTITION BY label))::DOUBLE
    * CASE kind WHEN 'sustained' THEN 5 WHEN 'single_hop' THEN 2 ELSE 1 END AS w
  FROM labelled
),
weighted AS (SELECT *, w / (SELECT avg(w) FROM base) AS weight FROM base)"""
_T = [READINGS_SQL, LAGGED, _train(), LABELLED]
ORACLE["transition_weights"] = _with(*_T, WEIGHTED) + """
SELECT label, kind, count(*) AS n, round(avg(weight), 6) + 0.0 AS weight FROM weighted GROUP BY label, kind"""
ORACLE["training_rows"] = (
    _with(*_T, WEIGHTED)
    + ', med AS (SELECT '
    + ", ".join(f"median({f}) AS {f}" for f in FEATURES)
    + ' FROM train) SELECT w.city_slug, w."timestamp", w.label, w.kind, round(w.weight, 6) + 0.0 AS weight, '
    + ", ".join(f"round(coalesce(w.{f}, med.{f}), 6) + 0.0 AS {f}" for f in FEATURES)
    + " FROM weighted w CROSS JOIN med"
)
ORACLE["transition_stats"] = _with(*_T) + """
SELECT count(*) AS rows, count(*) FILTER (kind <> 'steady') AS transitions,
  round(avg(CASE WHEN kind <> 'steady' THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS share,
  count(*) FILTER (kind = 'sustained') AS sustained, count(*) FILTER (kind = 'single_hop') AS single_hop
FROM labelled"""
ORACLE["class_distribution"] = TRAIN + """
SELECT aqi_next, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS pct
FROM train GROUP BY aqi_next"""
ORACLE["load_stats"] = _with(READINGS_SQL) + """
SELECT count(*) AS rows, count(DISTINCT city_slug) AS series, count(*) FILTER (aqi_raw > 5) AS out_of_range FROM raw"""

# --- forecasts ------------------------------------------------------------------------------------

RANKED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY city_slug ORDER BY "timestamp" DESC) AS rn,
                  count(*) OVER (PARTITION BY city_slug) AS n_rows FROM raw)"""
ORACLE["latest_n_per_key"] = _with(READINGS_SQL, RANKED) + f"""
SELECT city_slug, "timestamp", aqi, {sql_round('pm10')} FROM ranked WHERE rn <= 4"""


def _text(c: str, at: int, default: str) -> str:
    cases = " ".join(f"WHEN {row[0]} THEN '{row[at]}'" for row in CLASSES)
    return f"CASE {c} {cases} ELSE '{default}' END"


ORACLE["latest_forecast"] = _with(READINGS_SQL, RANKED) + f"""
SELECT city_slug, "timestamp" AS as_of, "timestamp" + INTERVAL 1 HOUR AS forecast_for,
  aqi AS current_aqi, {_text('aqi', 1, '—')} AS current_label, {_text('aqi', 2, '#ccc')} AS current_color,
  aqi AS predicted, {_text('aqi', 1, '—')} AS predicted_label, {_text('aqi', 2, '#ccc')} AS predicted_color,
  1.0::DOUBLE AS confidence
FROM ranked WHERE rn = 1 AND n_rows >= 4"""

BACKTEST = """
preds AS (
  SELECT city_slug, ts_next AS "timestamp", aqi AS predicted, aqi_next AS actual, aqi AS current_aqi
  FROM lagged WHERE ts_lag3 IS NOT NULL AND ts_next IS NOT NULL
)"""
_B = [READINGS_SQL, LAGGED, BACKTEST]
ORACLE["backtest"] = _with(*_B) + "SELECT * FROM preds"
ORACLE["backtest_cut"] = ORACLE["backtest"]
ORACLE["history_window"] = (
    _with(READINGS_SQL.replace("raw AS", "every AS", 1),
          'raw AS (SELECT * FROM every WHERE "timestamp" >= (SELECT max("timestamp") FROM every) - INTERVAL 172 HOURS)',
          LAGGED, BACKTEST)
    + "SELECT * FROM preds"
)
ORACLE["last_forecasts"] = _with(*_B) + """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY city_slug ORDER BY "timestamp" DESC) AS INTEGER) AS rn FROM preds)
WHERE rn <= 48"""
ORACLE["look_back_rows"] = _with(READINGS_SQL) + f"""
SELECT "timestamp", city_slug, aqi, {sql_round(*POLLUTANTS)} FROM raw
WHERE "timestamp" >= (SELECT max("timestamp") FROM raw) - INTERVAL 340 HOURS"""

# --- metrics --------------------------------------------------------------------------------------

CLASS_TABLE = 'classes AS (SELECT CAST(c AS INTEGER) AS "class" FROM range(1, 6) t(c))'


def _scores(by: str = "", source: str = "preds") -> str:
    keys, using = (f"{by}, ", f"AND p.{by} = g.{by}") if by else ("", "")
    groups = f"(SELECT {by}, count(*) AS n_predictions FROM {source} GROUP BY {by})" if by else f"(SELECT count(*) AS n_predictions FROM {source})"
    return f"""
tally AS (
  SELECT {'g.' + by + ',' if by else ''} g.n_predictions, c."class",
    count(*) FILTER (p.actual = c."class" AND p.predicted = c."class") AS tp,
    count(*) FILTER (p.predicted = c."class") AS said,
    count(*) FILTER (p.actual = c."class") AS support
  FROM classes c CROSS JOIN {groups} g
  LEFT JOIN {source} p ON (p.actual = c."class" OR p.predicted = c."class") {using}
  WHERE g.n_predictions >= 10
  GROUP BY ALL
),
scores AS (
  SELECT {keys}n_predictions, "class", support,
    CASE WHEN said = 0 THEN 0 ELSE tp / said::DOUBLE END AS "precision",
    CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall,
    CASE WHEN said + support = 0 THEN 0 ELSE 2 * tp / (said + support)::DOUBLE END AS f1
  FROM tally
)"""


def _overall(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    total = ", ".join(
        f'{_settled(f"sum({m} * support) / max(n_predictions)", 4)} AS {m}' for m in ('"precision"', "recall", "f1")
    )
    return (
        f"SELECT {keys}max(n_predictions) AS n_predictions, {total}, "
        f"{_settled('sum(f1) / 5', 4)} AS f1_macro FROM scores {'GROUP BY ' + by if by else 'HAVING count(*) > 0'}"
    )


ORACLE["prf_per_class"] = _with(*_B, CLASS_TABLE, _scores()) + """
SELECT n_predictions, "class", support, round(round_even("precision", 4), 6) + 0.0 AS "precision",
  round(round_even(recall, 4), 6) + 0.0 AS recall, round(round_even(f1, 4), 6) + 0.0 AS f1 FROM scores"""
ORACLE["prf_per_class"] = ORACLE["prf_per_class"].replace('SELECT n_predictions, "class", support, round', 'SELECT "class", support, round')
ORACLE["prf_weighted"] = _with(*_B, CLASS_TABLE, _scores()) + _overall()
ORACLE["prf_by_window"] = (
    _with(*_B, CLASS_TABLE,
          """windowed AS (
  SELECT h.window_hours, p.* FROM preds p JOIN (VALUES (24), (48), (72), (168)) h(window_hours)
    ON p."timestamp" >= (SELECT max("timestamp") FROM raw) - to_hours(h.window_hours + 2)
)""", _scores("window_hours", "windowed"))
    + _overall("window_hours")
)
DAILY = """
daily AS (
  SELECT CAST("timestamp" AS DATE) AS day, count(*) AS total,
    round_even(count(*) FILTER (predicted = actual) / count(*)::DOUBLE, 4) AS accuracy
  FROM preds GROUP BY 1
)"""
ORACLE["daily_accuracy"] = _with(*_B, DAILY) + "SELECT day, total, round(accuracy, 6) + 0.0 AS accuracy FROM daily"
ORACLE["accuracy_trend"] = _with(
    READINGS_SQL, LAGGED, BACKTEST.replace("preds AS", "every_pred AS", 1),
    'preds AS (SELECT * FROM every_pred WHERE "timestamp" >= (SELECT max("timestamp") FROM every_pred) - INTERVAL 336 HOURS)',
    DAILY,
) + "SELECT day, total, round(accuracy, 6) + 0.0 AS accuracy FROM daily"
ORACLE["accuracy_summary"] = _with(*_B, DAILY, "numbered AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS rn FROM daily)",
    """sides AS (
  SELECT avg(accuracy) FILTER (rn <= 7) AS a, CASE WHEN count(*) >= 14 THEN avg(accuracy) FILTER (rn BETWEEN 8 AND 14) END AS b
  FROM numbered HAVING count(*) >= 2
)""") + f"""
SELECT {_settled('a', 4)} AS last_7d_accuracy, {_settled('b', 4)} AS prior_7d_accuracy,
  {_settled('a - b', 4)} AS wow_delta, coalesce({_settled('a - b', 4)} < -0.10, false) AS concept_drift_flag
FROM sides"""

# --- drift ----------------------------------------------------------------------------------------


def _two_windows(days: int, pooled: bool) -> list[str]:
    last = '(SELECT max("timestamp") FROM every)' if pooled else 'max("timestamp") OVER (PARTITION BY city_slug)'
    return [
        READINGS_SQL.replace("raw AS", "every AS", 1),
        f"""raw AS (
  SELECT *, "timestamp" >= last_ts - INTERVAL {days} DAYS AS recent
  FROM (SELECT *, {last} AS last_ts FROM every) WHERE "timestamp" >= last_ts - INTERVAL {2 * days} DAYS
)""",
        LAGGED,
        """inputs AS (
  SELECT *, pm2_5 / (pm2_5 + pm10 + no2 + o3 + so2 + 1e-9::DOUBLE) AS pm25_ratio, std4 AS aqi_roll_std4 FROM lagged
)""",
        f"""passed AS (
  SELECT {'' if pooled else 'city_slug,'} count(*) FILTER (NOT recent) AS ref_rows, count(*) FILTER (recent) AS recent_rows,
    min("timestamp") FILTER (NOT recent) AS ref_from, max("timestamp") FILTER (NOT recent) AS ref_to,
    min("timestamp") FILTER (recent) AS recent_from, max("timestamp") FILTER (recent) AS recent_to
  FROM raw {'' if pooled else 'GROUP BY city_slug'} HAVING ref_rows >= 5 AND recent_rows >= 5 AND ref_rows + recent_rows >= 10
)""",
    ]


def _drift_features(days: int, pooled: bool) -> str:
    key = "" if pooled else "city_slug,"
    group = "" if pooled else "GROUP BY city_slug"
    long = " UNION ALL ".join(
        f"""SELECT {key} '{f}' AS feature, count({f}) FILTER (NOT recent) AS n, avg({f}) FILTER (NOT recent) AS m,
        stddev_samp({f}) FILTER (NOT recent) AS s, avg({f}) FILTER (recent) AS r FROM inputs {group}"""
        for f in DRIFT_FEATURES
    )
    gate = "EXISTS (SELECT 1 FROM passed)" if pooled else "city_slug IN (SELECT city_slug FROM passed)"
    return _with(*_two_windows(days, pooled), f"long AS ({long})", f"""
scored AS (
  SELECT {key} feature, m, r,
    {_settled("CASE WHEN r IS NOT NULL THEN greatest(-10, least(10, (r - m) / "
              "greatest(s, 0.01::DOUBLE * greatest(abs(m), 1.0::DOUBLE)))) END", 3)} AS drift_score
  FROM long WHERE n >= 2 AND {gate}
)""") + f"""
SELECT {key} feature, {_settled('m', 4)} AS ref_mean, {_settled('r', 4)} AS recent_mean, drift_score, coalesce(abs(drift_score) > 1.0, false) AS flag
FROM scored"""


ORACLE["drift_features_keyed"] = _drift_features(7, False)
ORACLE["drift_features_pooled"] = _drift_features(7, True)
ORACLE["drift_features_pooled_1d"] = _drift_features(1, True)


def _shift(column: str, source: str, pooled: bool, days: int = 7, extra: tuple[str, ...] = (), gate: str = "") -> str:
    key = "" if pooled else "city_slug,"
    on = "" if pooled else "WHERE p.city_slug IN (SELECT city_slug FROM passed)"
    if pooled:
        on = "WHERE EXISTS (SELECT 1 FROM passed)"

    def pct(flag):
        part = f"count(*) FILTER ({flag} AND p.{column} = c.\"class\")"
        whole = f"count(p.{column}) FILTER ({flag})"
        return f"round(round_even(CASE WHEN {whole} = 0 THEN 0 ELSE {part} / ({whole})::DOUBLE END * 100, 1), 6) + 0.0"

    return _with(*_two_windows(days, pooled), *extra, CLASS_TABLE) + f"""
SELECT {'' if pooled else 'p.city_slug,'} c."class", {pct('NOT p.recent')} AS ref_pct, {pct('p.recent')} AS recent_pct
FROM {source} p CROSS JOIN classes c {on} GROUP BY {'' if pooled else 'p.city_slug,'} c."class" {gate}"""


_SPLIT = """
halves AS (
  SELECT city_slug, recent, aqi AS predicted FROM (
    SELECT *, lag("timestamp", 3) OVER w AS before3, lead("timestamp", 1) OVER w AS after1 FROM raw
    WINDOW w AS (PARTITION BY city_slug, recent ORDER BY "timestamp"))
  WHERE before3 IS NOT NULL AND after1 IS NOT NULL
)"""
_BOTH = "HAVING count(*) FILTER (NOT p.recent) > 0 AND count(*) FILTER (p.recent) > 0"
ORACLE["drift_class_share"] = _shift("aqi", "raw", False)
ORACLE["drift_class_share_pooled"] = _shift("aqi", "raw", True)
ORACLE["drift_prediction_share"] = _shift("predicted", "halves", False, extra=(_SPLIT,), gate=_BOTH)
ORACLE["drift_prediction_share_pooled"] = _shift("predicted", "halves", True, extra=(_SPLIT,), gate=_BOTH)
ORACLE["drift_windows"] = _with(*_two_windows(7, False)) + "SELECT * FROM passed"

# --- cleaning and sources -------------------------------------------------------------------------

_COLS = ["city", "aqi", *POLLUTANTS, "source"]
MERGED = f"""
stored AS (SELECT "timestamp", city, city_slug, aqi_raw AS aqi, {", ".join(POLLUTANTS)}, source FROM raw WHERE event_id % 2 = 0),
changes AS (
  SELECT CASE WHEN aqi_raw = 6 THEN "timestamp" + INTERVAL 100 DAYS ELSE "timestamp" END AS "timestamp",
    'New ' || city AS city, city_slug, aqi_raw AS aqi, no AS co, co AS no,
    {", ".join(c for c in POLLUTANTS if c not in ("co", "no"))}, 'hourly' AS source
  FROM raw WHERE event_id % 3 = 0
),
merged AS (
  SELECT s."timestamp", s.city_slug, coalesce(t.city, s.city) AS city, {", ".join(f"s.{c}" for c in _COLS if c != "city")}
  FROM changes s LEFT JOIN stored t ON s.city_slug = t.city_slug AND s."timestamp" = t."timestamp"
  UNION ALL
  SELECT t."timestamp", t.city_slug, {", ".join(f"t.{c}" for c in _COLS)}
  FROM stored t ANTI JOIN changes s ON s.city_slug = t.city_slug AND s."timestamp" = t."timestamp"
)"""
_READING = f'"timestamp", city, city_slug, aqi, {sql_round(*POLLUTANTS)}, source'
ORACLE["upsert_silver"] = _with(READINGS_SQL, MERGED) + f"SELECT {_READING} FROM merged"
ORACLE["upsert_table"] = _with(READINGS_SQL, MERGED) + f"""SELECT {_READING}, strftime("timestamp", '%Y-%m') AS ym FROM merged"""

_LINE = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
_LINE_DOUBLE = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}
ORACLE["dedup_keep_first"] = (
    "SELECT " + ", ".join(sql_round(c) if c in _LINE_DOUBLE else c for c in _LINE)
    + " FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY " + ", ".join(_LINE) + ") = 1"
)

_HALF_UP = "CAST(round_even(aqi_raw + 0.5, 0) AS INTEGER)"
ORACLE["clean_bronze"] = _with(READINGS_SQL, f"""
parts AS (
  SELECT "timestamp", city, city_slug, CASE WHEN aqi_raw <> 6 THEN {_HALF_UP} END AS aqi,
    {", ".join(c if c != "nh3" else "NULL::DOUBLE AS nh3" for c in POLLUTANTS)}, 1 AS file FROM raw
  UNION ALL
  SELECT "timestamp", city, CASE WHEN aqi_raw > 1 THEN city_slug END, 3,
    {", ".join("NULL" for _ in POLLUTANTS)}, 2 FROM raw WHERE source = 'hourly'
)""") + f"""
SELECT "timestamp", city, city_slug, aqi, {sql_round(*POLLUTANTS)}, 'pipeline' AS source
FROM parts QUALIFY row_number() OVER (PARTITION BY city_slug, "timestamp" ORDER BY file) = 1 AND city_slug IS NOT NULL"""

ORACLE["hourly_partitions"] = _with(READINGS_SQL) + """
SELECT strftime("timestamp", '%Y') AS year, strftime("timestamp", '%m') AS month, strftime("timestamp", '%d') AS day,
  strftime("timestamp", '%Y') AS path_year, strftime("timestamp", '%m') AS path_month, strftime("timestamp", '%d') AS path_day,
  count(*) AS n, CAST(sum(CAST(floor(epoch("timestamp")) AS BIGINT)) AS BIGINT) AS sum_dt
FROM raw GROUP BY ALL"""
ORACLE["bulk_partitions"] = _with(READINGS_SQL) + """
SELECT city_slug, strftime("timestamp", '%Y') AS year, strftime("timestamp", '%m') AS month, count(*) AS n,
  round(sum(pm10), 6) + 0.0 AS pm10 FROM raw GROUP BY ALL"""
ORACLE["json_flatten"] = _with(READINGS_SQL) + f"""
SELECT city, city_slug, CAST(floor(epoch("timestamp")) AS BIGINT) AS dt, date_trunc('second', "timestamp") AS "timestamp",
  aqi_raw AS aqi, {sql_round(*POLLUTANTS)} FROM raw"""
ORACLE["weather_flatten"] = """
SELECT CAST(event_id AS VARCHAR) AS city_slug, CAST(floor(epoch(ts)) AS BIGINT) AS dt, date_trunc('second', ts) AS "timestamp",
  round(value, 6) + 0.0 AS temp_c, k AS humidity_pct,
  CASE WHEN k <> 0 THEN round(round_even(value - (100 - k) / 5.0::DOUBLE, 2), 6) + 0.0 END AS dew_point_c,
  k AS wind_speed_ms, NULL::DOUBLE AS wind_gust_ms,
  CASE WHEN event_type = 'click' THEN round(value, 6) + 0.0 ELSE 0.0::DOUBLE END AS rain_1h_mm, 0.0::DOUBLE AS snow_1h_mm,
  CAST(user_id AS INTEGER) AS weather_id, event_type AS weather_main
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""

SHAPES = "shaped AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
ORACLE["landed_any_shape"] = _with(SHAPES) + """
SELECT 'User ' || user_id AS city, 'user-' || user_id AS city_slug, CAST(floor(epoch(ts)) AS BIGINT) AS dt,
  date_trunc('second', ts) AS "timestamp", CASE WHEN k % 8 <> 4 THEN CAST(1 + k % 6 AS INTEGER) END AS aqi,
  CASE WHEN k % 8 = 1 THEN k + 0.5::DOUBLE END AS co,
  CASE k % 8 WHEN 3 THEN k + 0.25::DOUBLE WHEN 6 THEN k::DOUBLE WHEN 7 THEN k::DOUBLE END AS pm10,
  """ + ", ".join(f"NULL::DOUBLE AS {c}" for c in POLLUTANTS if c not in ("co", "pm10")) + """
FROM shaped WHERE k % 8 NOT IN (0, 5)"""
ORACLE["landed_unread"] = _with(SHAPES) + """
SELECT 'user-' || user_id AS city_slug, path, CASE path WHEN 'list[0].components.dust' THEN CAST(k AS VARCHAR) ELSE text END AS value
FROM shaped JOIN (VALUES (1, 'list[0].components.dust', ''), (1, 'list[0].note', '"n"'),
  (4, 'list[0].components.pm10', '"n/a"'), (4, 'list[0].main', '"none"')) AS odd(shape, path, text) ON k % 8 = shape"""
ORACLE["landed_rejects"] = _with(SHAPES) + """
SELECT CASE WHEN k % 8 = 0 THEN '{"city_slug":"user-' || user_id
  ELSE '{"city":"User ' || user_id || '","city_slug":"user-' || user_id || '","list":5}' END AS line
FROM shaped WHERE k % 8 IN (0, 5)"""

LINES = """
lines AS (
  SELECT *, k % 11 <> 0 AND event_type <> 'error' AS good
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
),
gold AS (
  SELECT date_trunc('second', ts) + INTERVAL 1 HOUR AS forecast_for, 'user-' || user_id AS city_slug,
    CAST(1 + k % 5 AS INTEGER) AS predicted, round(round_even(k / 128.0::DOUBLE, 6), 6) + 0.0 AS confidence,
    date_trunc('second', ts) AS as_of
  FROM lines WHERE good
)"""
ORACLE["parse_predictions"] = _with(LINES) + "SELECT * FROM gold"
ORACLE["append_predictions"] = _with(LINES) + """
SELECT *, strftime(forecast_for, '%Y-%m') AS ym FROM gold
QUALIFY row_number() OVER (PARTITION BY city_slug, forecast_for, as_of ORDER BY predicted, confidence) = 1"""
ORACLE["append_horizons"] = _with(LINES) + """
SELECT forecast_for + h * INTERVAL 1 HOUR AS forecast_for, city_slug, predicted, confidence, as_of,
  strftime(forecast_for + h * INTERVAL 1 HOUR, '%Y-%m') AS ym
FROM gold CROSS JOIN (SELECT unnest([0, 1, 2]) AS h)
QUALIFY row_number() OVER (PARTITION BY city_slug, gold.forecast_for, as_of, h ORDER BY predicted, confidence) = 1"""
ORACLE["hourly_split_delivery"] = _with(READINGS_SQL) + f"""
SELECT city_slug, "timestamp", aqi_raw AS aqi, {sql_round('pm10')}, strftime("timestamp", '%Y') AS year,
  strftime("timestamp", '%m') AS month, strftime("timestamp", '%d') AS day FROM raw"""
ORACLE["stream_redelivery"] = _with(READINGS_SQL) + """
SELECT city_slug, "timestamp", CASE WHEN event_id % 2 = 0 THEN 1 ELSE aqi_raw END AS aqi,
  CASE WHEN event_id % 2 = 0 THEN 0.0::DOUBLE ELSE no END AS no, files
FROM raw CROSS JOIN (SELECT CAST(unnest([1, 1000]) AS INTEGER) AS files)"""
ORACLE["rejected_predictions"] = _with(LINES, """
texts AS (
  SELECT '{"city_slug":"user-' || user_id || '","as_of":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
    || '","forecast_for":"' || strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') || '",'
    || CASE WHEN event_type <> 'error' THEN '"predicted":' || (1 + k % 5) || ',' ELSE '' END
    || '"confidence":' || CAST(k / 128.0::DOUBLE AS VARCHAR) || '}' AS whole, k
  FROM lines WHERE NOT good
)""") + """
SELECT CAST(length(CASE WHEN k % 11 = 0 THEN substring(whole, 1, 20) ELSE whole END) AS INTEGER) AS chars, count(*) AS n
FROM texts GROUP BY 1"""

ORACLE["stream_upsert"] = _with(READINGS_SQL) + f"""
SELECT "timestamp", CASE WHEN event_id % 2 = 0 THEN 'old' ELSE city END AS city, city_slug, aqi_raw AS aqi,
  {sql_round(*POLLUTANTS)}, source, strftime("timestamp", '%Y-%m') AS ym FROM raw"""
ORACLE["stream_forecasts"] = _with(
    READINGS_SQL.replace("raw AS", "every AS", 1),
    'raw AS (SELECT * FROM every WHERE "timestamp" >= (SELECT max("timestamp") FROM every) - INTERVAL 340 HOURS)',
    RANKED,
) + """
SELECT "timestamp" + INTERVAL 1 HOUR AS forecast_for, city_slug, aqi AS predicted, 1.0::DOUBLE AS confidence,
  "timestamp" AS as_of, strftime("timestamp" + INTERVAL 1 HOUR, '%Y-%m') AS ym
FROM ranked WHERE rn = 1 AND n_rows >= 4"""
ORACLE["stream_predictions"] = _with(LINES) + """
SELECT *, strftime(forecast_for, '%Y-%m') AS ym, (SELECT count(*) FROM lines WHERE NOT good) AS rejected FROM gold
QUALIFY row_number() OVER (PARTITION BY city_slug, forecast_for, as_of ORDER BY predicted, confidence) = 1"""

# --- joins and reports ----------------------------------------------------------------------------

FORECASTS = """
forecasts AS (
  SELECT "timestamp" AS forecast_for, city_slug, CASE WHEN aqi < 5 THEN aqi + 1 ELSE 1 END AS predicted,
    no / 4 AS confidence, "timestamp" - INTERVAL 2 HOURS AS as_of FROM raw
  UNION ALL
  SELECT "timestamp", city_slug, 3, no / 4, "timestamp" - INTERVAL 1 HOUR FROM raw WHERE no / 4 < 0.5
),
newest AS (
  SELECT * FROM forecasts QUALIFY row_number() OVER (PARTITION BY city_slug, forecast_for ORDER BY as_of DESC) = 1
)"""
ORACLE["dedup_predictions"] = _with(READINGS_SQL, FORECASTS) + f"""
SELECT forecast_for, city_slug, CAST(predicted AS INTEGER) AS predicted, {sql_round('confidence')}, as_of FROM newest"""
_JOINED = f"""
SELECT n.city_slug, n.forecast_for, CAST(n.predicted AS INTEGER) AS predicted, {sql_round('n.confidence')}, r.aqi AS actual
FROM newest n JOIN raw r ON n.city_slug = r.city_slug AND n.forecast_for = r."timestamp\""""
ORACLE["predicted_vs_actual"] = _with(READINGS_SQL, FORECASTS) + _JOINED
ORACLE["predicted_vs_actual_latest"] = (
    _with(READINGS_SQL, FORECASTS) + _JOINED + " ORDER BY n.forecast_for DESC, n.city_slug LIMIT 20"
)
ORACLE["dimension_lookup"] = """
SELECT c_nationkey, c_custkey, coalesce(n_name, '—') AS n_name FROM customer
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey"""
ORACLE["known_keys_only"] = """
SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)"""
ORACLE["unknown_keys"] = """
SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)"""
ORACLE["left_enrich_by_time"] = """
WITH air AS (
  SELECT o_custkey AS station, o_orderkey AS dt, max(l_shipdate) AS "timestamp", sum(l_quantity) AS co
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
),
wx AS (
  SELECT o_custkey AS station, o_orderkey AS dt, o_orderdate AS "timestamp", o_totalprice AS temp_c
  FROM orders WHERE o_custkey % 5 <> 0
)
SELECT station, dt, w."timestamp", round(temp_c, 6) + 0.0 AS temp_c, round(co, 6) + 0.0 AS co
FROM wx w LEFT JOIN (SELECT station, dt, co FROM air) USING (station, dt)
UNION ALL
SELECT station, dt, "timestamp", NULL, round(co, 6) + 0.0 FROM air WHERE station NOT IN (SELECT station FROM wx)"""
ORACLE["chunk_plan"] = """
WITH ranges AS (SELECT o_orderpriority, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT o_orderpriority, s AS chunk_start, least(s + INTERVAL 7 DAYS, b) AS chunk_end
FROM (SELECT *, unnest(range(a, b, INTERVAL 7 DAYS)) AS s FROM ranges)"""
ORACLE["rows_by_source"] = "SELECT source, count(*) AS n FROM documents GROUP BY source"
ORACLE["latest_readings"] = _with(READINGS_SQL) + """
SELECT city, city_slug, aqi, "timestamp" FROM raw ORDER BY "timestamp" DESC, city_slug LIMIT 10"""
ORACLE["freshness"] = _with(READINGS_SQL) + """
SELECT city_slug, max("timestamp") AS latest,
  CAST(floor(epoch((SELECT max("timestamp") FROM raw))) - floor(epoch(max("timestamp"))) AS BIGINT) AS age_seconds
FROM raw GROUP BY city_slug"""
ORACLE["forecast_counts"] = _with(READINGS_SQL, FORECASTS) + """
SELECT city_slug, CAST(predicted AS INTEGER) AS predicted, count(*) AS n FROM forecasts GROUP BY 1, 2"""
ORACLE["coverage"] = _with(READINGS_SQL) + """
SELECT count(*) FILTER (n >= 4) AS cached, count(*) FILTER (n < 4) AS skipped, CAST(sum(n) AS BIGINT) AS rows_fetched
FROM (SELECT city_slug, count(*) AS n FROM raw GROUP BY 1)"""


# --- a forest as a relation -----------------------------------------------------------------------

_WALK = [
    READINGS_SQL, LAGGED, SERVE, values_sql(),
    f"""
given AS (SELECT city_slug, "timestamp", aqi, aqi_next, ts_next, [{', '.join(f'CAST({f} AS DOUBLE)' for f in FEATURES)}] AS x FROM serve)""",
    """
walk(city_slug, "timestamp", tree, node) AS (
  SELECT g.city_slug, g."timestamp", t.tree, 0 FROM given g, (SELECT DISTINCT tree FROM nodes) t
  UNION ALL
  SELECT w.city_slug, w."timestamp", w.tree, CASE WHEN g.x[n.feature] <= n.threshold THEN n.l ELSE n.r END
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.l >= 0
  JOIN given g ON g.city_slug = w.city_slug AND g."timestamp" = w."timestamp"
)""",
    """
voted AS (
  SELECT city_slug, "timestamp", avg(shares[1]) AS p1, avg(shares[2]) AS p2, avg(shares[3]) AS p3, avg(shares[4]) AS p4,
         avg(shares[5]) AS p5
  FROM walk JOIN nodes USING (tree, node) WHERE l < 0 GROUP BY ALL
)""",
    """
chosen AS (
  SELECT *, CAST(list_position([p1, p2, p3, p4, p5], greatest(p1, p2, p3, p4, p5)) AS INTEGER) AS predicted
  FROM voted JOIN given USING (city_slug, "timestamp")
)""",
]
_FOREST = _with(*_WALK).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE["forest_shares"] = _FOREST + f"""
SELECT city_slug, "timestamp", {', '.join(f'round(p{c}, 6) + 0.0 AS {n}_{c}' for n in ('at_once', 'by_tree') for c in range(1, 6))}
FROM voted"""
ORACLE["forest_forecasts"] = _FOREST + """
SELECT city_slug, ts_next AS "timestamp", predicted, CAST(greatest(aqi_next, 1) AS INTEGER) AS actual,
  CAST(greatest(aqi, 1) AS INTEGER) AS current_aqi
FROM chosen WHERE ts_next IS NOT NULL"""
ORACLE["forest_latest"] = _FOREST + f"""
SELECT city_slug, "timestamp" AS as_of, "timestamp" + INTERVAL 1 HOUR AS forecast_for, predicted,
  {_text('predicted', 1, UNKNOWN_LABEL)} AS predicted_label, {_text('predicted', 2, UNKNOWN_COLOR)} AS predicted_color,
  round_even(greatest(p1, p2, p3, p4, p5), 4) AS confidence,
  {', '.join(f'round_even(p{c}, 4) AS p{c}' for c in range(1, 6))}
FROM chosen WHERE ts_next IS NULL"""
ORACLE["forest_importance"] = _FOREST + f""",
splits AS (
  SELECT feature, count(*) AS weight, avg(gain) AS gain, avg(n) AS cover
  FROM nodes JOIN (SELECT tree, node, count(*) AS n FROM walk GROUP BY ALL) USING (tree, node) WHERE l >= 0 GROUP BY feature
)
SELECT [{', '.join(f"'{f}'" for f in FEATURES)}][feature] AS feature, {', '.join(
    f'round_even({k}::DOUBLE / sum({k}) OVER (), 4) AS {k}' for k in ('weight', 'gain', 'cover'))}
FROM splits"""


# --- scores by signed changes ---------------------------------------------------------------------

ORACLE["increment_cells"] = _with(*_B) + """
SELECT city_slug, CAST("timestamp" AS DATE) AS day, actual, predicted, count(*) AS n
FROM preds WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY ALL"""
ORACLE["increment_scores"] = _with(*_B, CLASS_TABLE, _scores("city_slug")) + """
SELECT city_slug, "class", support, round_even(precision, 4) + 0.0 AS precision, round_even(recall, 4) + 0.0 AS recall, round_even(f1, 4) + 0.0 AS f1 FROM scores"""


# --- forecasts from stream state ------------------------------------------------------------------

_LAST = '(SELECT max("timestamp") FROM raw)'
_SEEN = {
    1: (f'"timestamp" < {_LAST} - INTERVAL 4 DAYS', "true", "aqi"),
    2: (f'"timestamp" < {_LAST} - INTERVAL 4 DAYS OR "timestamp" >= {_LAST} - INTERVAL 2 DAYS', f'"timestamp" >= {_LAST} - INTERVAL 2 DAYS', "aqi"),
    3: (
        "true",
        f'("timestamp" >= {_LAST} - INTERVAL 4 DAYS AND "timestamp" < {_LAST} - INTERVAL 2 DAYS) OR "timestamp" >= {_LAST} - INTERVAL 1 DAY',
        f'CASE WHEN "timestamp" >= {_LAST} - INTERVAL 1 DAY THEN 1 ELSE aqi END',
    ),
}
ORACLE["stream_lag_state"] = _with(READINGS_SQL, "seen AS (" + " UNION ALL ".join(
    f"""
  SELECT {n} AS delivery, city_slug, "timestamp", {aqi} AS aqi, row_number() OVER w AS rn, lead("timestamp", 3) OVER w AS fourth
  FROM raw WHERE ({there}) AND city_slug IN (SELECT city_slug FROM raw WHERE {new})
  WINDOW w AS (PARTITION BY city_slug ORDER BY "timestamp" DESC)"""
    for n, (there, new, aqi) in _SEEN.items()
) + ")") + """
SELECT "timestamp" + INTERVAL 1 HOUR AS forecast_for, city_slug, aqi AS predicted, 1.0::DOUBLE AS confidence, "timestamp" AS as_of,
  strftime("timestamp" + INTERVAL 1 HOUR, '%Y-%m') AS ym
FROM seen WHERE rn = 1 AND fourth >= "timestamp" - INTERVAL 340 HOURS
QUALIFY row_number() OVER (PARTITION BY city_slug, "timestamp" ORDER BY delivery) = 1"""


# --- drift from daily moments: the same results as from all rows ----------------------------------

ORACLE |= {
    "moments_features_keyed": ORACLE["drift_features_keyed"],
    "moments_features_pooled": ORACLE["drift_features_pooled"],
    "moments_features_pooled_1d": ORACLE["drift_features_pooled_1d"],
    "moments_class_share": ORACLE["drift_class_share"],
    "moments_windows": ORACLE["drift_windows"],
}

# --- whole tables and sources ---------------------------------------------------------------------

ORACLE["stream_join"] = " UNION ALL ".join(f"SELECT *, '{n}' AS first FROM ({ORACLE['predicted_vs_actual']})" for n in ("forecasts", "readings"))
ORACLE["stream_drop_repeats"] = "SELECT DISTINCT 'part-' || l_partkey AS city_slug, l_shipdate AS \"timestamp\" FROM lineitem"
_ALL = f'"timestamp", city, city_slug, aqi_raw AS aqi, {sql_round(*POLLUTANTS)}'
ORACLE["one_file"] = _with(READINGS_SQL) + f"SELECT {_ALL}, source FROM raw WHERE source = 'hourly'"
ORACLE["station_zones"] = f"""
SELECT c_name AS name, 'c-' || c_custkey AS slug, {sql_round('c_acctbal')[:-len(' AS c_acctbal')]} AS lat, round(c_acctbal / 2, 6) + 0.0 AS lon,
  coalesce(n_name, 'UTC') AS timezone
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2"""
ORACLE["silver_of_stations"] = _with(READINGS_SQL) + f"""
SELECT "timestamp", city, city_slug, aqi, {sql_round(*POLLUTANTS)}, source, strftime("timestamp", '%Y-%m') AS ym
FROM raw WHERE "timestamp" >= (SELECT max("timestamp") FROM raw) - INTERVAL 200 HOURS
  AND city_slug IN ({', '.join(f"'user-{n}'" for n in range(1, 60, 2))})"""
ORACLE["weather_all_columns"] = """
SELECT event_type AS city, CAST(event_id AS VARCHAR) AS city_slug, CAST(floor(epoch(ts)) AS BIGINT) AS dt, date_trunc('second', ts) AS "timestamp",
  round(v, 6) + 0.0 AS temp_c, round(v - 1, 6) + 0.0 AS feels_like_c, round(v - 2, 6) + 0.0 AS temp_min_c, round(v + 2, 6) + 0.0 AS temp_max_c,
  k + 1000 AS pressure_hpa, k + 1001 AS sea_level_hpa, k + 990 AS grnd_level_hpa, k AS humidity_pct,
  CASE WHEN k <> 0 THEN round(round_even(v - (100 - k) / 5.0::DOUBLE, 2), 6) + 0.0 END AS dew_point_c,
  k AS wind_speed_ms, k * 3 AS wind_deg, CASE WHEN k > 50 THEN k + 5 END AS wind_gust_ms, k / 2 AS clouds_pct, k * 100 AS visibility_m,
  CASE WHEN event_type = 'click' THEN round(v, 6) + 0.0 ELSE 0.0::DOUBLE END AS rain_1h_mm,
  CASE WHEN event_type = 'view' THEN round(v / 2, 6) + 0.0 ELSE 0.0::DOUBLE END AS snow_1h_mm,
  CASE WHEN k > 3 THEN CAST(user_id AS INTEGER) END AS weather_id, CASE WHEN k > 3 THEN event_type END AS weather_main,
  CASE WHEN k > 3 THEN 'about ' || event_type END AS weather_desc
FROM (SELECT *, value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""
_FOLDERS = """strftime("timestamp", '%Y') AS year, strftime("timestamp", '%m') AS month"""
ORACLE["hourly_rows"] = _with(READINGS_SQL) + f"""
SELECT CAST(floor(epoch("timestamp")) AS BIGINT) AS dt, {_ALL}, {_FOLDERS}, strftime("timestamp", '%d') AS day FROM raw"""
ORACLE["bulk_rows"] = _with(READINGS_SQL) + f"""
SELECT CAST(floor(epoch("timestamp")) AS BIGINT) AS dt, {_ALL.replace('aqi_raw AS aqi', 'aqi_raw::DOUBLE AS aqi')}, {_FOLDERS} FROM raw"""
_MERGED_ALL = MERGED.replace("event_id % 2 = 0", "event_id % 10 <> 7").replace(
    "FROM raw WHERE event_id % 3 = 0",
    f"""FROM raw WHERE event_id % 3 = 0
  UNION ALL
  SELECT "timestamp", city, city_slug, aqi_raw, {", ".join(["co", "no", *(c for c in POLLUTANTS if c not in ("co", "no"))])}, source
  FROM raw WHERE event_id % 10 = 7 AND event_id % 3 <> 0""",
)
ORACLE["upsert_all_rows"] = _with(READINGS_SQL, _MERGED_ALL) + f"SELECT {_READING} FROM merged"


# --- read side ------------------------------------------------------------------------------------


def _recent(hours: int) -> list[str]:
    """Readings of the last hours, with their neighbours among themselves."""
    return [
        READINGS_SQL.replace("raw AS", "every AS", 1),
        f'raw AS (SELECT * FROM every WHERE "timestamp" >= (SELECT max("timestamp") FROM every) - INTERVAL {hours} HOURS)',
    ]


ORACLE["route_cities"] = """
SELECT DISTINCT 'Place ' || user_id AS name, 'user-' || user_id AS slug, user_id::DOUBLE AS lat, 0::DOUBLE - user_id AS lon,
  CASE WHEN user_id % 2 = 0 THEN 'Asia/Tokyo' ELSE 'UTC' END AS timezone
FROM events"""
ORACLE["route_predict"] = _with(*_recent(340), RANKED) + f"""
SELECT city_slug, "timestamp" AS as_of, "timestamp" + INTERVAL 1 HOUR AS forecast_for,
  aqi AS current_aqi, {_text('aqi', 1, UNKNOWN_LABEL)} AS current_label, {_text('aqi', 2, UNKNOWN_COLOR)} AS current_color,
  aqi AS predicted, {_text('aqi', 1, UNKNOWN_LABEL)} AS predicted_label, {_text('aqi', 2, UNKNOWN_COLOR)} AS predicted_color,
  1.0::DOUBLE AS confidence, 'Place ' || user_id AS city, CASE WHEN user_id % 2 = 0 THEN 'Asia/Tokyo' ELSE 'UTC' END AS timezone,
  {', '.join(f'(aqi = {c})::DOUBLE AS p{c}' for c in range(1, 6))}
FROM ranked WHERE rn = 1 AND n_rows >= 4 AND city_slug = 'user-7'"""
ORACLE["route_history"] = f"SELECT * FROM ({ORACLE['history_window']}) WHERE city_slug = 'user-7'"
ORACLE["route_drift"] = ORACLE["drift_features_pooled"]
ORACLE["route_model_metrics"] = _with(*_recent(172), LAGGED, BACKTEST, CLASS_TABLE, _scores()) + _overall()
ORACLE["route_accuracy_trend"] = _with(*_recent(2 * 168 + 4), LAGGED, BACKTEST, DAILY) + "SELECT day, total, round(accuracy, 6) + 0.0 AS accuracy FROM daily"
