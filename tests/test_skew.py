"""One key holding nearly all rows must not end up in one task."""

import pytest
from pyspark.sql import functions as F

from fluxweave.dims import DEV, PERF
from fluxweave.operators import features as fv
from fluxweave.operators import learning as ln
from fluxweave.operators import ordering as od
from fluxweave.operators import series as se
from fluxweave.operators import transitions as tr

ROWS = 20_000


@pytest.fixture
def hot(spark):
    """One device of one performance, ten rows a second.

    Small partitions are not merged and small sides are not broadcast, as with
    tables that are too large for either.
    """
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark.range(ROWS).select(
        F.lit(1).alias(PERF),
        F.timestamp_micros(F.col("id") * 100_000).alias("time"),
        F.lit("hot").alias(DEV),
        (F.col("id") * 7919 % 9).cast("int").alias("gesture"),
        (F.col("id") % 1024).cast("double").alias("x_pos"),
        (F.col("id") % 768).cast("double").alias("y_pos"),
        (F.col("id") % 3).cast("double").alias("velocity"),
    )
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_previous_row(hot):
    out = od.with_previous(hot, [PERF, DEV], ["gesture"])
    assert largest_share(out) < 0.3
    wrong = out.filter((F.unix_micros("time") > 0) & F.col("prev_gesture").isNull())
    assert wrong.count() == 0


def test_row_number(hot):
    out = od.with_row_number(hot, [PERF], ["time"], F.floor(F.unix_seconds("time") / 60))
    assert largest_share(out) < 0.3
    assert out.filter(F.col("row_no") != F.unix_micros("time") / 100_000 + 1).count() == 0


def test_flux_and_features(hot):
    steps = tr.state_steps(hot)
    assert largest_share(se.trailing_flux(steps, 37, 15)) < 0.3
    assert largest_share(se.rolling_flux(steps)) < 0.3
    assert largest_share(fv.rolling_features(hot)) < 0.3
    assert largest_share(fv.tumbling_features(hot)) < 0.3
    assert largest_share(tr.window_counts(steps, 15)) < 0.3


def test_debounce(hot):
    out = se.debounced(hot, 10)
    assert largest_share(out) < 0.3
    assert out.count() == (ROWS - 1) // 101 + 1


def test_debounce_over_ten_years(hot, spark):
    """Dense hours far apart: levels are chained, and no group holds the performance's blocks."""
    years = hot.limit(0)
    for year in (0, 4, 10):
        years = years.unionByName(hot.filter("time < timestamp_micros(600000000)").withColumn("time", F.col("time") + F.expr(f"INTERVAL {365 * year} DAYS")))
    got = sorted(r.us for r in se.debounced(years, 10).select(F.unix_micros("time").alias("us")).collect())
    assert got == [365 * 86_400_000_000 * year + 10_100_000 * k for year in (0, 4, 10) for k in range(60)]


def test_folds(hot):
    out = ln.stratified_folds(hot.withColumn("label", F.lit(0)), "label", ["time"], digits=2)
    assert largest_share(out) < 0.3
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert sizes == [ROWS / 10] * 10


def test_year_of_silence(hot):
    """A gap becomes blocks of steps that are spread over the tasks."""
    ends = hot.filter(F.col("time") == F.timestamp_micros(F.lit(0))).select(PERF, "time", F.lit(0.5).alias("flux"))
    year = ends.unionByName(ends.withColumn("time", F.col("time") + F.expr("INTERVAL 365 DAYS")))
    filled = se.forward_fill(year, [PERF], "time", ["flux"], 60, 3600)
    assert filled.count() == 365 * 24 * 60 + 1
    assert largest_share(filled) < 0.3
