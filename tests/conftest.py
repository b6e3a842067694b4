import datetime as dt
import os

import pytest
from pyspark.sql import SparkSession

from fluxweave.dims import DEV, PERF

SMOKE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
T0 = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(microseconds=round(seconds * 1_000_000))


def seconds(t: dt.datetime) -> float:
    return (t - T0).total_seconds()


def gesture_frame(spark, rows):
    """Rows of (performance, device, seconds, state)."""
    return spark.createDataFrame(
        [(p, d, at(s), g) for p, d, s, g in rows], f"{PERF} int, {DEV} string, time timestamp, gesture int"
    )


def touch_frame(spark, rows):
    """Rows of (performance, device, seconds, x, y, velocity)."""
    return spark.createDataFrame(
        [(p, d, at(s), float(x), float(y), float(v)) for p, d, s, x, y, v in rows],
        f"{PERF} int, {DEV} string, time timestamp, x_pos double, y_pos double, velocity double",
    )


def event_frame(spark, rows):
    return spark.createDataFrame([(p, at(s)) for p, s in rows], f"{PERF} int, time timestamp")


def cell_frame(spark, rows, key="w"):
    return spark.createDataFrame(
        [(key, int(t), int(f), int(n)) for t, f, n in rows], "k string, to_state int, from_state int, n long"
    )
