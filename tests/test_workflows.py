"""Whole jobs over small archives."""

import pytest
from pyspark.sql import functions as F

from fluxweave.dims import DEV, FEATURE_COLUMNS, PERF
from fluxweave.operators import learning as ln
from fluxweave.plans import workflows as wf
from fluxweave.sources import tables as tb
from fluxweave.streaming import live
from tests.conftest import at, gesture_frame, seconds, touch_frame
from tests.test_properties import labelled_vectors

LOG = """Logging started - 2020-01-01T00-00-00-SessionLog.log
2020-01-01T00:00:01.250000, touch, A, 512.0, 300.5, 0.0
2020-01-01T00:00:01.500000, touch/ended, A
2020-01-01T00:00:02.000000, /ensemble/online, A, Rings
2020-01-01T00:00:03.000000, /classifier/gestures, A, 1, B, 0
2020-01-01T00:00:04.000000, ensemble, A, CompositionStep, 3
2020-01-01T00:00:05.000000, stasis, 0.5, 0.8
2020-01-01T00:00:06.000000, LiveProc, new_idea
2020-01-01T00:00:07.000000, /ensemble/targetgesture, 3
"""


def test_split_logs(spark, tmp_path):
    for day in ("2020-01-01", "2020-01-02"):
        (tmp_path / f"{day}T00-00-00-SessionLog.log").write_text(LOG.replace("2020-01-01", day))
    paths = wf.split_logs(spark, str(tmp_path / "*.log"), str(tmp_path / "out"))
    counts = {k: spark.read.parquet(p).count() for k, p in paths.items()}
    assert counts == {"touches": 2, "events": 2, "messages": 2, "online": 2, "transitions": 2, "gestures": 4, "gesturetargets": 2}
    touches = spark.read.parquet(paths["touches"]).orderBy("time").first()
    assert touches[PERF] == "2020-01-01T00-00-00-SessionLog"
    assert (seconds(touches.time), touches[DEV], touches.x_pos) == (1.25, "A", 512.0)


def test_posthoc_and_score(spark, tmp_path):
    t = touch_frame(spark, [(1, d, s / 3 + i, 100 + 5 * s, 50 * i, s % 4) for i, d in enumerate("ab") for s in range(200)])
    model = ln.train_forest(labelled_vectors(spark), trees=3, depth=3)
    score = wf.score_touches(t, model, str(tmp_path / "score"))
    out = wf.posthoc(score)
    assert out["flux"].count() == out["states"].count() == 5
    assert out["matrices"].count() == 125
    assert out["flux_filled"].count() == 61
    assert wf.recent(score).agg(F.min("time")).first()[0] > at(5)


def test_study_tables(spark):
    t = touch_frame(spark, [(1, "a", 2, 0, 0, 0), (1, "b", 9, 0, 0, 0)])
    events = spark.createDataFrame([(1, at(1), "Hub", "new_idea")], f"{PERF} int, time timestamp, name string, event_type string")
    app = spark.createDataFrame([(1, at(3), "x", "a", "CompositionStep", "1")], f"{PERF} int, time timestamp, type string, {DEV} string, label string, value string")
    g = gesture_frame(spark, [(1, d, float(s), s % 3) for d in "ab" for s in range(6)])
    design = spark.createDataFrame([(at(2), 1, 2, 1, "ButtonOn", "ServerOff", "Button")], "time timestamp, perf_number int, `group` int, performance int, button string, server string, overall string")
    seat = F.when(F.col(DEV) == "a", 1).otherwise(4)
    tables = wf.study_tables(t, events, app, g, design, seat)
    presses = {r.performer: r.button_presses for r in tables["button_presses"].collect()}
    assert presses == {"E": 1, "H": 0}
    assert {r.seat: r.seconds for r in tables["performance_lengths"].collect()} == {1: 0, 4: 7}
    assert tables["performance_data"].first().button_presses == 1


def test_training_data(spark, tmp_path):
    t = touch_frame(spark, [(1, "a", s / 2, 10 + s, 20, s % 3) for s in range(40)])
    targets = spark.createDataFrame([(1, at(s), 100 if s > 15 else s // 4) for s in range(20)], f"{PERF} int, time timestamp, target int")
    read = tb.read_features(spark, wf.training_data(t, targets, str(tmp_path / "v")))
    assert read.columns == ["time", *FEATURE_COLUMNS, "gesture"]
    assert read.count() == 16 and read.filter("gesture = 100").count() == 0


def test_evaluation_of_several_sets(spark):
    good = labelled_vectors(spark, 120)
    noise = good.withColumn("gesture", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int"))
    found = wf.evaluate({"good": good, "noise": noise}, ["id"], folds=3, runs=2, trees=10)
    assert found["scores"].groupBy("set").count().filter("count = 6").count() == 2
    means = {r["set"]: r["mean"] for r in found["intervals"].collect()}
    assert means["good"] > 0.95 > 0.6 > means["noise"]
    assert found["anova"].first().f > 10 and found["t_tests"].first().t > 3
    shares = {r["set"]: r["whole"] for r in found["confusion"].groupBy("set").agg(F.sum("share").alias("whole")).collect()}
    assert shares == pytest.approx({"good": 1, "noise": 1})


def test_live_session_continues(spark, tmp_path):
    rows = [(1, d, s / 2, 100 + s * (1 + i), 50, s % 4) for i, d in enumerate("ab") for s in range(240)]
    model = ln.train_forest(labelled_vectors(spark), trees=3, depth=3)
    schema = f"{PERF} int, {DEV} string, time timestamp, x_pos double, y_pos double, velocity double"
    sizes = []
    for part in (rows[:160] + rows[240:400], rows[160:240] + rows[400:]):
        touch_frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.message_stream(spark, str(tmp_path / "in"), schema)
        paths = wf.live_session(stream, model, str(tmp_path / "out"), chunk=10)
        sizes.append({k: spark.read.parquet(f"{p}/*/data" if k == "steps" else p).count() for k, p in paths.items() if k != "new_ideas"})
        assert 0 < live.current_view(spark, paths["view"]).count() <= 2 * 60
    assert 0 < sizes[0]["flux"] < sizes[1]["flux"]
    log = spark.read.parquet(paths["gestures"])
    assert log.groupBy(PERF, DEV, "time").count().filter("count > 1").count() == 0
    assert sizes[0]["steps"] < sizes[1]["steps"] <= sizes[1]["gestures"]
    assert sizes[1]["flux"] == sizes[1]["states"]
