"""Run queries against their SQL in DuckDB: ``python -m suite.compare SF_DIR [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from stationcast import builder
from suite.oracle import ORACLE
from suite.queries import QUERIES


def session(cores: str = "8") -> SparkSession:
    spark = (
        builder("suite")
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def normal(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[sorted(rows.columns)].copy()
    for c in rows.columns:
        if str(rows[c].dtype).startswith("datetime"):
            rows[c] = rows[c].astype("datetime64[us]").astype(str)
        elif rows[c].map(lambda v: hasattr(v, "isoformat")).any():
            rows[c] = pd.to_datetime(rows[c]).astype("datetime64[us]").astype(str)
        elif rows[c].dtype == bool or rows[c].map(lambda v: isinstance(v, str)).any():
            rows[c] = rows[c].astype(object).where(rows[c].notna(), None).map(lambda v: "∅" if v is None else str(v))
        else:
            rows[c] = rows[c].astype("float64").map(lambda v: "∅" if pd.isna(v) else repr(v))
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


def difference(found: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None where the results agree, else what differs."""
    a, b = found.toPandas(), db.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} / {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    a, b = normal(a), normal(b)
    off = [c for c in a.columns if not a[c].equals(b[c])]
    if off:
        bad = (a[off] != b[off]).any(axis=1)
        return f"{bad.sum()} of {len(a)} rows differ in {off}: {a[bad].head(2).to_dict('records')} / {b[bad].head(2).to_dict('records')}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark, db, failed = session(), tables(sf_dir), 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            found = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                problem = difference(found, db, ORACLE[name])
            else:
                problem = None if found.count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed; without SQL: {sorted(set(QUERIES) - set(ORACLE))}")
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
