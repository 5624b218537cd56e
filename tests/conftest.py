import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stationcast import builder  # noqa: E402
from stationcast.schemas import READING  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("tests")
        .master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


BASE = {"co": 300.0, "no": 2.0, "no2": 15.0, "o3": 60.0, "so2": 5.0, "pm2_5": 10.0, "pm10": 20.0, "nh3": 3.0}


def at(hours: float, start: dt.datetime = dt.datetime(2026, 1, 1)) -> dt.datetime:
    return (start + dt.timedelta(hours=hours)).replace(tzinfo=dt.timezone.utc)


def reading(slug, hours, aqi, city=None, source="test", start=dt.datetime(2026, 1, 1), **values):
    row = {**BASE, **values}
    return (at(hours, start), city or slug.title(), slug, aqi, *[row[c] for c in BASE], source)


@pytest.fixture
def frame(spark):
    """Rows of ``reading`` as a table."""

    def make(rows):
        columns = ["timestamp", "city", "city_slug", "aqi", *BASE, "source"]
        by_name = [dict(zip(columns, r)) for r in rows]
        return spark.createDataFrame([tuple(r[f.name] for f in READING.fields) for r in by_name], READING)

    return make


@pytest.fixture
def training_frame(frame):
    """Two series of 24 hours whose class counts up from 1 to 5 and starts again."""

    def make(series=2, hours=24):
        return frame([reading(f"s{s}", h, h % 5 + 1) for s in range(series) for h in range(hours)])

    return make
