"""Shape of the plans that matter at scale."""

import pytest

from fluxweave.operators import messages as ms
from fluxweave.plans import testviews as tv
from fluxweave.plans.catalog import QUERIES
from tests.conftest import SMOKE


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


CORE = [
    "flux_series",
    "ensemble_state_by_window",
    "transition_counts_complete_rows",
    "rolling_flux_fifteen_rows",
    "trailing_flux",
    "features_rolling",
    "features_tumbling",
    "gesture_grid_dense",
    "changeyness_for_many_widths",
    "folds_plain",
    "bootstrap_sample",
    "confusion_matrix",
    "debounced_new_ideas",
    "performance_summary",
    "button_press_table",
    "matrix_dense_cells",
]


@pytest.mark.parametrize("name", CORE)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SMOKE))
    for bad in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert bad not in text


def test_columns_are_pruned(spark):
    text = plan(QUERIES["flux_series"](spark, SMOKE))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text


@pytest.mark.parametrize("ticks", [300, 5000])
def test_no_key_is_sorted_whole_for_its_last_ticks(spark, ticks):
    text = plan(ms.retain_ticks(tv.gestures(spark, SMOKE), ticks))
    windows = [line for line in text.splitlines() if "Window [" in line or "WindowGroupLimit" in line]
    assert windows and all("__chunk" in line for line in windows)


def test_touches_stay_where_they_are(spark):
    """One row per performance is brought to the touches, which are not shuffled for it."""
    text = plan(ms.with_elapsed(tv.touches(spark, SMOKE)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_windows_over_rows_are_cut_into_chunks(spark):
    text = plan(QUERIES["transition_steps"](spark, SMOKE))
    rows = [line for line in text.splitlines() if "Window [row_number" in line]
    assert rows and all("__chunk" in line for line in rows)


def test_range_filter_is_pushed_down(spark):
    from pyspark.sql import functions as F

    raw = tv.table(spark, SMOKE, "events").withColumn("time", F.col("ts"))
    text = plan(ms.between(raw, F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-06").cast("timestamp_ntz")))
    assert "GreaterThanOrEqual(ts" in text


def counted(spark, df) -> tuple[int, int, int]:
    """Scans of files, exchanges by hash, and exchanges that are used again, in the plan before adaptive changes."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(df.select("*"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return text.count("FileScan"), text.count("Exchange hashpartitioning") - text.count("ReusedExchange"), text.count("ReusedExchange")


@pytest.mark.parametrize(
    "name,exchanges",
    # rows by (device, chunk); edges by device; then what each measure groups by
    [("transition_steps", 2), ("flux_series", 4), ("trailing_flux", 4), ("rolling_flux_fifteen_rows", 5), ("gesture_line_segments", 2), ("debounced_new_ideas", 4)],
)
def test_rows_are_read_and_dealt_out_once(spark, name, exchanges):
    scans, dealt, reused = counted(spark, QUERIES[name](spark, SMOKE))
    assert (scans, reused > 0) == (1, True)
    assert dealt <= exchanges


def test_players_are_brought_to_the_rows(spark):
    """Complete rows need the number of players, for which no row moves to its performance."""
    text = plan(QUERIES["transition_counts_complete_rows"](spark, SMOKE))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
