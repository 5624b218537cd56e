"""Time the headline queries. Prints one line of JSON.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores (default 8).
Every query runs once to warm up and is then timed once, writing all its rows to a sink that
discards them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stationcast import builder  # noqa: E402
from suite.queries import QUERIES  # noqa: E402

HEADLINES = [
    "features_train",
    "features_serve",
    "feature_medians",
    "transition_weights",
    "training_rows",
    "latest_forecast",
    "backtest",
    "history_window",
    "prf_per_class",
    "prf_by_window",
    "daily_accuracy",
    "accuracy_summary",
    "drift_features_keyed",
    "drift_features_pooled",
    "drift_class_share",
    "drift_prediction_share",
    "upsert_silver",
    "upsert_table",
    "dedup_keep_first",
    "clean_bronze",
    "predicted_vs_actual",
    "dimension_lookup",
    "left_enrich_by_time",
    "json_flatten",
    "parse_predictions",
    "rows_by_source",
    "freshness",
    "train_and_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
