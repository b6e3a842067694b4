"""Hand-made edge cases."""

import pytest
from pyspark.sql import functions as F

from fluxweave.dims import DEV, PERF
from fluxweave.functions import scalars as sc
from fluxweave.operators import features as fv
from fluxweave.operators import messages as ms
from fluxweave.operators import series as se
from fluxweave.operators import transitions as tr
from fluxweave.sources import captures as cp
from fluxweave.sources import logs as lg
from fluxweave.sources import tables as tb
from fluxweave.sources.formats import DEFAULT_FORMAT, LogFormat
from tests.conftest import at, cell_frame, event_frame, gesture_frame, seconds, touch_frame

MATRICES = {
    # name: cells, state, spread, ratio, flux
    "one diagonal cell": ([(1, 1, 7)], "stasis", 0, 1, 0),
    "two diagonal cells": ([(1, 1, 20), (2, 2, 30)], "development", 1, 0, 0),
    "even diagonal": ([(i, i, 5) for i in range(5)], "development", 1, 0, 0),
    "even column": ([(i, 2, 3) for i in range(5)], "divergence", 0, 0.2, 0.8),
    "even row": ([(2, i, 3) for i in range(5)], "convergence", 0, 0.2, 0.8),
    "uneven column": ([(i, 2, n) for i, n in enumerate((4, 3, 1, 3, 3))], "convergence", 0.95189834, 1, 13 / 14),
    "uneven row": ([(2, i, n) for i, n in enumerate((4, 3, 1, 3, 3))], "divergence", 0.95189834, 1, 13 / 14),
}


def test_matrix_cases(spark):
    frames = [cell_frame(spark, cells, name) for name, (cells, *_) in MATRICES.items()]
    cells = frames[0]
    for f in frames[1:]:
        cells = cells.unionByName(f)
    states = {r.k: r for r in tr.ensemble_state(cells, ["k"]).collect()}
    fluxes = {r.k: r.flux for r in tr.flux(cells, ["k"]).collect()}
    for name, (_, state, spread, ratio, flux) in MATRICES.items():
        got = states[name]
        assert got.state == state, name
        assert got.spread == pytest.approx(spread, abs=1e-8), name
        assert got.ratio == pytest.approx(ratio), name
        assert fluxes[name] == pytest.approx(flux), name


def test_empty_matrix_keeps_its_window(spark):
    g = gesture_frame(spark, [(1, "a", 0, 3)])
    counts = tr.window_counts(tr.state_steps(g), 15)
    assert se.flux_series(counts).first().flux == 0
    state = tr.ensemble_state(counts, [PERF, "window_start"]).first()
    assert (state.state, state.spread, state.ratio) == ("stasis", 0, 1)
    assert tr.window_counts(tr.state_steps(g), 15, keep_first_rows=False).count() == 0
    assert tr.entropy(counts, [PERF]).count() == 0


def test_unmapped_states_make_no_pair(spark):
    rows = [(1, "a", 0, 1), (1, "a", 1, None), (1, "a", 2, 1), (1, "a", 3, 10), (1, "a", 20, 2), (1, "a", 21, 9)]
    g = gesture_frame(spark, rows)
    counts = tr.window_counts(tr.state_steps(g), 15)
    cells = [(seconds(r.window_start), r.to_state, r.from_state, r.n) for r in tr.cells(counts).collect()]
    assert cells == [(15, 4, 1, 1)]  # the unsure state belongs to the combo group
    assert se.flux_series(counts).count() == 2
    assert tr.cells(tr.whole_counts(tr.state_steps(g, "full"))).count() == 0


def test_single_touch_and_empty_bin(spark):
    t = touch_frame(spark, [(1, "a", 0.5, 10, 20, 0), (1, "a", 11, 30, 40, 2)])
    rows = {seconds(r.time): r for r in fv.tumbling_features(t).collect()}
    assert sorted(rows) == [0, 5, 10]
    assert (rows[0].freq, rows[0].std_x, rows[0].touchdown_freq, rows[0].movement_freq) == (1, 0, 1, 1)
    assert (rows[5].centroid_x, rows[5].centroid_y, rows[5].freq, rows[5].velocity) == (-1, -1, 0, 0)


def test_rolling_window_includes_both_ends(spark):
    t = touch_frame(spark, [(1, "a", 0, 10, 10, 1), (1, "a", 5, 20, 20, 1), (1, "a", 11, 0, 0, 1)])
    rows = {seconds(r.time): r.freq for r in fv.rolling_features(t).collect()}
    assert rows == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1}


def test_threshold_is_strict(spark):
    rows = [(1, at(0), 0.5), (1, at(15), 0.75), (1, at(30), 1.0), (1, at(45), 0.0)]
    s = spark.createDataFrame(rows, f"{PERF} int, window_start timestamp, flux double")
    assert se.new_ideas(s, 0.25).count() == 0
    assert se.new_ideas(s, 0.2499).count() == 2
    assert not se.latest_new_idea(s, 0.1).first().is_new_idea


def test_flux_is_one_division(spark):
    # 7/30 - 1/12 is 0.15 in arithmetic and just above it in doubles
    s = spark.createDataFrame([(1, at(0), 5, 60), (1, at(15), 14, 60)], f"{PERF} int, window_start timestamp, m long, n long")
    rows = s.select(PERF, "window_start", (F.col("m").cast("double") / F.col("n")).alias("flux"))
    assert se.new_ideas(rows, 0.15).count() == 1


def test_debounce_chain(spark):
    kept = se.debounced(event_frame(spark, [(1, 0), (1, 6), (1, 12), (1, 18), (2, 5)]), 10).collect()
    assert sorted((r[PERF], seconds(r.time)) for r in kept) == [(1, 0), (1, 12), (2, 5)]


def test_debounce_at_exactly_the_gap(spark):
    kept = se.debounced(event_frame(spark, [(1, 0), (1, 10), (1, 20.000001)]), 10).collect()
    assert sorted(seconds(r.time) for r in kept) == [0, 20.000001]


def test_ragged_gesture_lines(spark):
    lines = spark.createDataFrame(
        [
            ("p", "2020-01-01T00:00:00.500000, /classifier/gestures, A, 0, B, 4"),
            ("p", "2020-01-01T00:00:01.500000, /classifier/gestures, B, 5"),
            ("p", "2020-01-01T00:00:02.500000, /classifier/gestures"),
        ],
        f"{PERF} string, value string",
    )
    got = sorted((seconds(r.time), r[DEV], r.gesture) for r in lg.split_gestures(lines).collect())
    assert got == [(0.5, "A", 0), (0.5, "B", 4), (1.5, "B", 5)]


def test_targets_only_when_present(spark):
    lines = spark.createDataFrame([("p", "2020-01-01T00:00:00, touch, A, 1.0, 2.0, 0.0")], f"{PERF} string, value string")
    assert lg.split_targets(lines).count() == 0
    assert lg.split_touches(lines).first().x_pos == 1.0


def test_namespace_is_a_setting(spark):
    fmt = LogFormat(namespace="jam", servers=("Hub",))
    lines = spark.createDataFrame(
        [
            ("p", "2020-01-01T00:00:00, jam, A, CompositionStep, 3"),
            ("p", "2020-01-01T00:00:01, /jam/online, A, Rings"),
            ("p", "2020-01-01T00:00:02, HubOne, new_idea"),
            ("p", "2020-01-01T00:00:03, /jam/targetgesture, 3"),
        ],
        f"{PERF} string, value string",
    )
    assert lg.split_app_messages(lines, fmt).first().label == "CompositionStep"
    assert lg.split_online(lines, fmt).first().app_id == "Rings"
    assert lg.split_events(lines, fmt).first().event_type == "new_idea"
    assert lg.split_targets(lines, fmt).first().target == 3


def test_match_score(spark):
    pairs = [(1, 1, 0), (1, 2, 1), (3, 5, 1), (1, 3, 3), (10, 1, 5), (10, 10, 0)]
    df = spark.createDataFrame(pairs, "p int, t int, want int").withColumn("got", sc.match_score("p", "t"))
    assert df.filter("got <> want").count() == 0


def test_bad_targets(spark):
    df = spark.createDataFrame([(100, 1.0), (3, -1.0), (None, -1.0), (None, 2.0)], "target int, centroid_x double")
    got = ms.force_idle_target(ms.drop_bad_targets(df)).collect()
    assert [r.target for r in got] == [0, 0, None]


def test_weighted_choice(spark):
    df = spark.createDataFrame([([1.0, 0.0, 3.0], u) for u in (0.0, 0.2, 0.25, 0.99)], "w array<double>, u double")
    assert [r.pick for r in df.select(sc.weighted_choice("w", "u").alias("pick")).collect()] == [0, 0, 2, 2]


def test_first_route_wins(spark):
    rows = [
        ("/ensemble/touch", "sfff", "touch"),
        ("/ensemble/touch/ended", "s", "touch/ended"),
        ("/ensemble/touch/ended", "sfff", "touch"),
        ("/ensemble/switch", "sss", "switch"),
        ("/ensemble/offline", "ss", "offline"),
        ("/ensemble/acceleration", "sfff", "accel"),
        ("/ensemble/targetgesture", "i", "target"),
        ("/ensemble/touch", "s", "error"),
    ]
    df = spark.createDataFrame(rows, "address string, tags string, want string")
    assert ms.route_messages(df, DEFAULT_FORMAT).filter("kind <> want").count() == 0


def test_bracket_capture(spark):
    line = "152.146475138 [ /ensemble/touch, DEV-1, 938.5, 696, 0 ] a NetAddr(10.0.1.6, 57120)"
    records = spark.createDataFrame([("f", at(0), line)], f"{PERF} string, start timestamp, value string")
    row = cp.bracket_touches(records).first()
    assert (seconds(row.time), row[DEV], row.x_pos, row.y_pos, row.velocity) == (152.146475, "DEV-1", 938.5, 696, 0)
    text = cp.bracket_text(records).first().value
    assert text == "152.146475138 10.0.1.6 /ensemble/touch DEV-1 938.5 696 0"
    uids = spark.createDataFrame([("DEV-1", 3)], f"{DEV} string, uid int")
    unit = cp.unit_square_touches(records, uids).first()
    assert (unit.uid, unit.gid, unit.mode, unit.x, unit.y) == (3, 1, 1, 938.5 / 1024, 696 / 768)


def test_title_and_start(spark):
    df = spark.createDataFrame([("file:/x/2015-04-29T17-54-12-SessionLog-touches.csv",)], "path string")
    row = df.select(tb.title_of("path").alias("t")).select("t", tb.start_of("t").alias("s")).first()
    assert row.t == "2015-04-29T17-54-12-SessionLog"
    assert str(row.s) == "2015-04-29 17:54:12"
    other = spark.createDataFrame([("file:/x/score3-gestures.csv",), ("file:/x/plain",)], "path string")
    assert [r.p for r in other.select(tb.performance_of("path").alias("p")).collect()] == ["score3", "plain"]


def test_coding_grid_labels(spark):
    lengths = spark.createDataFrame([("v", 3611.0), ("e", 10.0)], f"{PERF} string, seconds double")
    rows = cp.coding_grid(lengths).collect()
    labels = [r.label for r in rows if r[PERF] == "v"]
    assert labels[0] == "0:0" and labels[13] == "1:5" and labels[-1] == "0:10"
    assert [r.second for r in rows if r[PERF] == "e"] == [0, 5]


def test_wide_tables_with_different_devices(spark, tmp_path):
    (tmp_path / "2020-01-01T00-00-00-LogA-gestures.csv").write_text("time,d1,d2\n2020-01-01T00:00:01,3,\n2020-01-01T00:00:02,,4\n")
    (tmp_path / "2020-01-02T00-00-00-LogB-gestures.csv").write_text("time,d3\n2020-01-02T00:00:01,7\n")
    got = sorted((r[PERF][-4:], r[DEV], r.gesture) for r in tb.read_gestures(spark, str(tmp_path)).collect())
    assert got == [("LogA", "d1", 3), ("LogA", "d2", 4), ("LogB", "d3", 7)]


def test_multi_width_counts_match_single_widths(spark):
    rows = [(1, d, s + 0.25 * i, (s * 7 + i) % 9) for i, d in enumerate("ab") for s in range(60)]
    steps = tr.state_steps(gesture_frame(spark, rows))
    many = tr.multi_width_counts(steps, [5, 10, 15, 20])
    for w in (5, 10, 15, 20):
        one = tr.cells(tr.window_counts(steps, w, keep_first_rows=False))
        part = tr.cells(many.filter(F.col("width") == w).drop("width"))
        assert tr.matrix_differences(part, one, [PERF, "window_start"]).count() == 0


def test_wide_cells_may_be_quoted_and_hold_commas(spark, tmp_path):
    (tmp_path / "2020-01-01T00-00-00-A-gesturetargets.csv").write_text('"time","a,b",c\n2020-01-01T00:00:01,"x,y",\n2020-01-01T00:00:02, ,z\n')
    (tmp_path / "2020-01-02T00-00-00-B-gesturetargets.csv").write_text("time,d,e,f,g\n2020-01-01T00:00:01,1,,3,4\n")
    (tmp_path / "2020-01-03T00-00-00-C-gesturetargets.csv").write_text("2020-01-01T00:00:01,no header\n")
    read = tb.read_coded_targets(spark, str(tmp_path))
    got = sorted((r[PERF][-1], r[DEV], r.code) for r in read.collect())
    assert got == [("A", "a,b", "x,y"), ("A", "c", "z"), ("B", "d", "1"), ("B", "f", "3"), ("B", "g", "4")]


def test_wide_rows_stay_where_they_are(spark, tmp_path):
    """The headers are brought to the rows: no exchange, no second reading of the text in the result."""
    (tmp_path / "2020-01-01T00-00-00-A-gestures.csv").write_text("time,a\n2020-01-01T00:00:01,1\n")
    text = tb.read_gestures(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text
    assert text.count("FileScan csv") == 1 and "FileScan text" not in text
