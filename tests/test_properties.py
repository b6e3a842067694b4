"""Invariants, round trips, models, and stream against batch."""

import random

import pytest
from pyspark.sql import functions as F

from fluxweave.dims import DEV, FEATURE_COLUMNS, PERF
from fluxweave.operators import forests
from fluxweave.operators import learning as ln
from fluxweave.operators import messages as ms
from fluxweave.operators import series as se
from fluxweave.operators import study as st
from fluxweave.operators import transitions as tr
from fluxweave.plans.catalog import models
from fluxweave.sources import logs as lg
from fluxweave.sources import tables as tb
from fluxweave.streaming import live
from tests.conftest import SMOKE, at, gesture_frame, seconds, touch_frame
from tests.test_brute import skewed_gestures


@pytest.fixture(scope="module")
def steps(spark):
    return tr.state_steps(gesture_frame(spark, skewed_gestures(9)), chunk_seconds=30).cache()


def test_flux_is_a_share(steps):
    series = se.flux_series(tr.window_counts(steps, 15))
    assert series.filter("flux < 0 OR flux > 1").count() == 0


def test_windows_add_up_to_the_whole(steps):
    by_window = tr.cells(tr.window_counts(steps, 15)).groupBy(PERF, "to_state", "from_state").agg(F.sum("n").alias("n"))
    whole = tr.cells(tr.whole_counts(steps))
    assert tr.matrix_differences(by_window, whole, [PERF]).count() == 0


def test_normal_matrix_sums_to_one(steps):
    sums = tr.normal(tr.window_counts(steps, 15), [PERF, "window_start"]).groupBy(PERF, "window_start").agg(F.sum("p").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_dense_cells_agree_with_sparse(steps):
    counts = tr.window_counts(steps, 15)
    dense = tr.dense_cells(counts, [PERF, "window_start"])
    assert dense.count() == 25 * counts.select(PERF, "window_start").distinct().count()
    assert tr.matrix_differences(tr.cells(dense), tr.cells(counts), [PERF, "window_start"]).count() == 0


def test_log_round_trip(spark):
    rnd = random.Random(3)
    rows = [(1, f"d{i % 3}", i * 0.731, rnd.random() * 1024, rnd.random() * 768, rnd.random()) for i in range(50)]
    t = touch_frame(spark, rows)
    back = lg.split_touches(lg.touch_lines(t))
    assert t.select(sorted(t.columns)).exceptAll(back.select(sorted(t.columns))).count() == 0
    g = gesture_frame(spark, [(1, d, float(s), (s + len(d)) % 9) for d in ("a", "bb") for s in range(20)])
    back = lg.split_gestures(lg.gesture_lines(g))
    assert g.select(sorted(g.columns)).exceptAll(back.select(sorted(g.columns))).count() == 0


def test_summary_counts(spark):
    t = touch_frame(spark, [(1, "a", 2, 0, 0, 0), (1, "b", 9, 0, 0, 0), (2, "a", 0, 0, 0, 0)])
    events = spark.createDataFrame([(1, at(s), "Hub", "new_idea") for s in (0, 6, 12, 18)], f"{PERF} int, time timestamp, name string, event_type string")
    app = spark.createDataFrame([(1, at(1), "x", "a", "CompositionStep", "1"), (1, at(2), "x", "a", None, "1")], f"{PERF} int, time timestamp, type string, {DEV} string, label string, value string")
    g = gesture_frame(spark, [(1, d, float(s), (s // 2) % 3) for d in "ab" for s in range(8)])
    rows = {r[PERF]: r for r in st.performance_summary(t, events, app, g).collect()}
    assert (rows[1].raw_new_ideas, rows[1].new_idea_changes, rows[1].button_presses) == (4, 2, 1)
    assert (rows[2].raw_new_ideas, rows[2].new_idea_changes, rows[2].button_presses, rows[2].flux) == (0, 0, 0, 0)
    presses = {(r[PERF], r[DEV]): r.button_presses for r in st.button_presses(t, app).collect()}
    assert presses == {(1, "a"): 1, (1, "b"): 0, (2, "a"): 0}
    lengths = {(r[PERF], r[DEV]): r.seconds for r in st.performer_lengths(t).collect()}
    assert lengths == {(1, "a"): 0, (1, "b"): 7, (2, "a"): 0}


def labelled_vectors(spark, n=240):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        g = i % 4
        rows.append((i, *[g * 10 + rnd.random() * 4 + j for j in range(len(FEATURE_COLUMNS))], g))
    cols = ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    return spark.createDataFrame(rows, f"id int, {cols}, gesture int")


def test_registered_cross_validation_is_whole(spark, monkeypatch):
    """10 folds in 10 runs, forests of 100 trees without a bound on depth, on all rows."""
    seen, grow = [], forests.grow
    monkeypatch.setattr(forests, "grow", lambda rows, n, group, trees, per_split, depth, *rest: seen.append((n, group, trees, per_split, depth)) or grow(rows, n, group, trees, per_split, depth, *rest))
    monkeypatch.setattr(models, "_validated", {})
    rows = models.vectors(spark, SMOKE).count()
    got = models.cross_validated(spark, SMOKE).groupBy("run", "fold").count().collect()
    assert len(got) == 100 and sum(r["count"] for r in got) == 10 * rows
    assert sorted(job for _, group, *_ in seen for job in group) == [(run, fold) for run in range(10) for fold in range(10)]
    assert {(n, *rest) for n, _, *rest in seen} == {(rows, 100, 3, 30)}


def test_forest_learns_and_is_stored(spark, tmp_path):
    df = labelled_vectors(spark)
    predictions = ln.cross_validate(df, FEATURE_COLUMNS, "gesture", ["id"], folds=3, trees=8, depth=5)
    assert predictions.count() == df.count()
    assert st.graded_scores(predictions, ["run"]).first().accuracy > 0.95
    assert ln.fold_scores(predictions, "gesture").count() == 3
    path = str(tmp_path / "model")
    first = ln.load_or_train(spark, path, df, trees=5, depth=4)
    second = ln.load_or_train(spark, path, df)
    assert second.stages[-1].getNumTrees == 5
    assert ln.classify(first, df).exceptAll(ln.classify(second, df)).count() == 0
    ranked = ln.importances(first).collect()
    assert len(ranked) == len(FEATURE_COLUMNS) and sum(r.importance for r in ranked) == pytest.approx(1)


def test_bayes_with_text_labels(spark):
    df = labelled_vectors(spark).withColumn("who", F.concat(F.lit("d"), "gesture"))
    out = ln.classify(ln.train_bayes(df, FEATURE_COLUMNS, "who"), df)
    assert out.filter("gesture <> prediction").count() == 0


def test_gesture_score_covers_every_tick(spark):
    rows = [(1, "a", s / 4, 100 + s, 50, s % 3) for s in range(80)] + [(1, "b", 30 + s, 5, 5, 0) for s in range(4)]
    t = touch_frame(spark, rows)
    model = ln.train_forest(labelled_vectors(spark), trees=3, depth=3)
    score = ln.gesture_score(model, t, 5, 1).collect()
    assert sorted((r[DEV], seconds(r.time)) for r in score) == [(d, float(s)) for d in "ab" for s in range(34)]


def _write_files(df, path, parts):
    """One file per slice of time, in order."""
    for i in range(parts):
        lo, hi = i * 400 / parts, (i + 1) * 400 / parts
        df.filter(F.col("time").between(F.lit(at(lo)), F.lit(at(hi - 0.000001)))).coalesce(1).write.mode("append").parquet(path)


def test_stream_steps_across_batches_equal_batch(spark, tmp_path):
    g = gesture_frame(spark, skewed_gestures(11))
    _write_files(g, str(tmp_path / "in"), 5)
    stream = live.message_stream(spark, str(tmp_path / "in"), f"{PERF} int, {DEV} string, time timestamp, gesture int", files=1)
    path = live.write_steps(stream, "steps", path=str(tmp_path / "out"), delay="10 seconds")
    got = spark.read.parquet(f"{path}/*/data")
    newest = g.agg(F.max("time")).first()[0]
    want = tr.state_steps(g).drop("prev_time").select(got.columns)
    closed = want.filter((F.floor(F.unix_seconds("time") / 60) + 1) * 60 <= F.unix_seconds(F.lit(newest)) - 10)
    assert got.count() == closed.count() > 100
    assert got.exceptAll(want).count() == 0


def test_stream_flux_and_ideas_equal_batch(spark, tmp_path):
    g = gesture_frame(spark, skewed_gestures(12))
    schema = f"{PERF} int, {DEV} string, time timestamp, to_state int, from_state int"
    steps = tr.state_steps(g)
    _write_files(steps.drop("prev_time"), str(tmp_path / "in"), 4)
    stream = live.message_stream(spark, str(tmp_path / "in"), schema, files=1)
    flux_path = live.run_to_table(live.live_flux(stream, 15), "flux", path=str(tmp_path / "flux"))
    series = se.flux_series(tr.window_counts(steps, 15))
    newest = g.agg(F.max("time")).first()[0]
    closed = series.filter(F.col("window_start") + F.expr("INTERVAL 25 SECONDS") <= F.lit(newest))
    got = spark.read.parquet(flux_path)
    assert got.count() == closed.count() > 10
    assert got.exceptAll(closed.select(PERF, "window_start", "flux")).count() == 0
    # read back in whole batches, each later than the one before
    bounds = [0, 100, 200, 300, 400]
    for lo, hi in zip(bounds, bounds[1:]):
        part = got.filter((F.col("time") >= F.lit(at(lo))) & (F.col("time") < F.lit(at(hi))))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "series"))
    flux = live.message_stream(spark, str(tmp_path / "series"), f"{PERF} int, time timestamp, flux double", files=1)
    ideas = spark.read.parquet(live.run_to_table(live.live_new_ideas(flux, 0.2), "ideas", path=str(tmp_path / "ideas")))
    want = se.new_ideas(closed, 0.2)
    assert sorted((r[PERF], r.time) for r in ideas.collect()) == sorted((r[PERF], r.window_start) for r in want.collect())


GESTURES = f"{PERF} int, {DEV} string, time timestamp, gesture int"


def _steps_of(spark, tmp_path, parts, **options):
    """Steps of parts that arrive one after the other, each as one batch."""
    for part in parts:
        gesture_frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.message_stream(spark, str(tmp_path / "in"), GESTURES, files=1)
    path = live.write_steps(stream, "s", path=str(tmp_path / "out"), states="full", chunk=10, **options)
    return sorted((r[DEV], seconds(r.time), r.to_state, r.from_state) for r in spark.read.parquet(f"{path}/*/data").collect())


def test_rows_within_the_delay_are_kept_and_later_ones_dropped(spark, tmp_path):
    parts = [[(1, "a", 10, 1), (1, "a", 20, 2)], [(1, "a", 15, 3), (1, "a", 30, 4)], [(1, "a", 40, 7)], [(1, "a", 12, 5), (1, "a", 45, 6), (1, "a", 60, 0)]]
    # 15 comes 5 s late; 12 comes when its chunk has been given out at the watermark 30 - 10
    got = _steps_of(spark, tmp_path, parts)
    assert got == [("a", 10, None, None), ("a", 15, 3, 1), ("a", 20, 2, 3), ("a", 30, 4, 2), ("a", 40, 7, 4), ("a", 45, 6, 7)]


def test_shuffled_stream_equals_the_table(spark, tmp_path):
    draw = random.Random(9)
    rows = [(1 + i % 2, "abc"[i % 3], i / 2, draw.randrange(9)) for i in range(400)]
    arrival = sorted(rows, key=lambda r: r[2] + draw.random() * 9)
    got = _steps_of(spark, tmp_path, [arrival[i : i + 60] for i in range(0, 400, 60)])
    steps = tr.state_steps(gesture_frame(spark, rows), "full").collect()
    closed = 190 - 190 % 10 - 10
    want = sorted((r[DEV], seconds(r.time), r.to_state, r.from_state) for r in steps)
    assert [x for x in got if x[1] < closed] == [x for x in want if x[1] < closed] and len(got) > 340


def test_restarted_stream_goes_on(spark, tmp_path):
    first = _steps_of(spark, tmp_path, [[(1, "a", 1, 1), (1, "a", 25, 3)]])
    assert first == [("a", 1, None, None)]
    assert _steps_of(spark, tmp_path, [[(1, "a", 26, 2), (1, "a", 60, 2)]]) == [("a", 1, None, None), ("a", 25, 3, 1), ("a", 26, 2, 3)]


def test_silent_devices_get_a_state_at_every_tick(spark, tmp_path):
    """Silence inside, at the end, and after a device has left."""
    schema = f"{PERF} int, {DEV} string, time timestamp, prediction int"
    heard = [[(1, "a", 1, 4), (1, "a", 2, 5), (1, "b", 2, 7)], [(1, "a", 30, 6)], [(1, "b", 33, 2), (1, "c", 33, 1)]]
    for part in heard:
        gesture_frame(spark, part).withColumnRenamed("gesture", "prediction").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    offline = gesture_frame(spark, [(1, "a", 31, 0)]).drop("gesture")
    stream = live.message_stream(spark, str(tmp_path / "in"), schema, files=1)
    path = live.run_to_table(live.fill_idle(stream, 1, offline), "log", path=str(tmp_path / "out"))
    got = {(r[DEV], int(seconds(r.time))): r.gesture for r in spark.read.parquet(path).collect()}
    want = {("a", s): 0 for s in range(1, 32)} | {("b", s): 0 for s in range(2, 34)}
    want |= {("a", 1): 4, ("a", 2): 5, ("a", 30): 6, ("b", 2): 7, ("b", 33): 2, ("c", 33): 1}
    assert got == want


def test_devices_leave_after_their_last_vector(spark, tmp_path):
    """Offline messages are events of the same state: one comes before the device's first prediction, one long after its last."""
    guesses, gone = str(tmp_path / "in"), str(tmp_path / "gone")

    def told(rows, path):
        gesture_frame(spark, rows).withColumnRenamed("gesture", "prediction").coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = live.message_stream(spark, guesses, f"{PERF} int, {DEV} string, time timestamp, prediction int")
        offline = live.message_stream(spark, gone, f"{PERF} int, {DEV} string, time timestamp, prediction int").withColumn("kind", F.lit("offline"))
        path = live.run_to_table(live.fill_idle(stream, 1, live.leaving(offline)), "log", path=str(tmp_path / "out"))
        rows = spark.read.parquet(path).collect()
        assert len({(r[DEV], r.time) for r in rows}) == len(rows)
        return {(r[DEV], int(seconds(r.time))): r.gesture for r in rows}

    told([(1, "a", 1, 4), (1, "a", 3, 5), (1, "b", 2, 7)], guesses)
    told([(1, "c", 6, 0)], gone)  # before c plays at all
    run()
    told([(1, "a", 5.5, 0)], gone)  # after the last vector of a, and without any more of them
    told([(1, "b", 9, 3), (1, "c", 4, 1)], guesses)
    run()
    told([(1, "b", 31, 2)], guesses)
    want = {("a", s): 0 for s in range(1, 6)} | {("b", s): 0 for s in range(2, 32)} | {("c", s): 0 for s in range(4, 7)}
    want |= {("a", 1): 4, ("a", 3): 5, ("b", 2): 7, ("b", 9): 3, ("b", 31): 2, ("c", 4): 1}
    assert run() == want
    told([(1, "a", 40, 6)], guesses)  # and it may come back
    got = run()
    assert got[("a", 40)] == 6 and not any(("a", s) in got for s in range(6, 40))


def test_live_view_is_the_batch_view_after_every_batch(spark, tmp_path):
    rows = [(p, d, s, (s + len(d)) % 9) for p in (1, 2) for d in ("a", "bb") for s in range(0, 400, 1 + p)]
    random.Random(3).shuffle(rows)
    rows.sort(key=lambda r: r[2] // 10)  # out of order within ten seconds
    cut = [rows[:1], rows[1:90], rows[90:400], [r for r in rows[400:] if r[0] == 2], [r for r in rows[400:] if r[0] == 1]]
    for ticks, keep in ((7, 60), (300, 60), (300, 5)):
        source, out, seen = str(tmp_path / f"in{ticks}-{keep}"), str(tmp_path / f"out{ticks}-{keep}"), []
        for part in cut:
            seen += part
            gesture_frame(spark, part).coalesce(1).write.mode("append").parquet(source)
            stream = live.message_stream(spark, source, f"{PERF} int, {DEV} string, time timestamp, gesture int")
            path = live.run_updates(live.live_recent(stream, ticks, keep, "500 seconds"), "view", path=out)
            got = sorted(map(tuple, live.current_view(spark, path).collect()))
            want = ms.retain_seconds(ms.retain_ticks(gesture_frame(spark, seen), ticks), keep)
            assert got == sorted(map(tuple, want.select(PERF, DEV, "time", "gesture").collect()))
            assert len(got) == len(set(got)) > 0


def test_fractional_widths_on_a_stream(spark, tmp_path):
    rows = [(1, "a", s / 4, 1, 1, 1) for s in range(40)]
    touch_frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.message_stream(spark, str(tmp_path / "in"), f"{PERF} int, {DEV} string, time timestamp, x_pos double, y_pos double, velocity double")
    path = live.run_to_table(live.live_features(stream, 1, 0.5, "1 second"), "v", path=str(tmp_path / "out"))
    counts = {seconds(r.time): r.freq for r in spark.read.parquet(path).collect()}
    assert counts[0.5] == 2 and counts[1.0] == 4 and counts[1.5] == 4


def test_a_model_that_cannot_be_read_is_left_alone(spark, tmp_path):
    path = tmp_path / "model"
    path.mkdir()
    (path / "keep").write_text("x")
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader raises
        ln.load_or_train(spark, str(path), spark.createDataFrame([(0.0, 1)], "centroid_x double, gesture int"))
    assert (path / "keep").read_text() == "x"


def test_draws_reach_every_row(spark):
    """Row numbers come from 60 bits, so no row is out of reach."""
    picked = ln.bootstrap(spark.range(3000), ["id"], digits=2)
    rows = picked.count()
    assert rows == 3000 and 0.6 < picked.select("id").distinct().count() / rows < 0.66


def test_last_ticks_keep_every_device(spark):
    log = gesture_frame(spark, [(1, f"d{d}", s, 1) for s in range(100) for d in range(10)] + [(2, "x", 5, 1)])
    kept = ms.retain_ticks(log, 30)
    assert kept.filter(F.col(PERF) == 1).count() == 300 and kept.filter(F.col(PERF) == 2).count() == 1
    assert kept.filter(F.col(PERF) == 1).select("time").distinct().count() == 30
    assert ms.retain_ticks(log, 5000).count() == 1001
    for chunk in (1, 7, 1000):
        assert ms.retain_ticks(log, 30, chunk_seconds=chunk).count() == 301


def test_files_with_other_column_orders(spark, tmp_path):
    head = "time,centroid_x,freq,target"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(f"{head}\n2020-01-01 00:00:01,1.5,2,3\n")
    (tmp_path / "in/b.csv").write_text("time,gesture,freq,centroid_x\n2020-01-01 00:00:02,4,5,6.5\n")
    (tmp_path / "in/c.csv").write_text("time,gesture,centroid_x\n2020-01-01 00:00:03,7,8.5\n")
    got = sorted((r.centroid_x, r.freq, r.gesture) for r in tb.read_features(spark, str(tmp_path / "in")).collect())
    assert got == [(1.5, 2, 3), (6.5, 5, 4), (8.5, None, 7)]


def test_cross_validation_learns_the_labels_from_all_columns(spark, monkeypatch):
    """The labels of the table, from its 64 columns, and rows without a label too."""
    seen = []
    monkeypatch.setattr(models, "_validated", {})
    small = models.vectors(spark, SMOKE).limit(40).withColumn("label", F.when(F.col("vec_id") % 5 > 0, F.col("label")))
    monkeypatch.setattr(models, "vectors", lambda s, d: small)
    whole = ln.cross_validate
    monkeypatch.setattr(ln, "cross_validate", lambda df, columns, label, *rest, **more: seen.append((len(columns), label)) or whole(df, columns, label, *rest, **{**more, "trees": 2}))
    rows = models.forest_confusion(spark, SMOKE).collect()
    assert seen == [(64, "label")]
    assert {r.label: r.n for r in rows} == {r.label: 10 * r["count"] for r in small.groupBy("label").count().collect()}
