"""Scaled-out operators against plain Python on small, skewed data."""

import random

import pytest
from pyspark.sql import functions as F

from fluxweave.dims import DEV, GESTURE_GROUPS, PERF
from fluxweave.operators import features as fv
from fluxweave.operators import learning as ln
from fluxweave.operators import ordering as od
from fluxweave.operators import series as se
from fluxweave.operators import transitions as tr
from tests.conftest import at, event_frame, gesture_frame, seconds, touch_frame


def skewed_gestures(seed, n=400):
    """One device holds most rows; times are irregular and unique per device."""
    rnd = random.Random(seed)
    rows = []
    for p, d, share in ((1, "hot", 0.7), (1, "b", 0.15), (2, "c", 0.15)):
        times = sorted(rnd.sample(range(0, 400_000), int(n * share)))
        rows += [(p, d, t / 1000, rnd.choice([0, 0, 1, 2, 3, 4, 5, 8, 9, 10])) for t in times]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [3, 60, 100_000])
def test_previous_row_across_chunks(spark, chunk):
    rows = skewed_gestures(1)
    got = od.with_previous(gesture_frame(spark, rows), [PERF, DEV], ["gesture", "time"], "time", chunk_seconds=chunk)
    want, last = set(), {}
    for p, d, s, g in sorted(rows, key=lambda r: r[2]):
        want.add((p, d, s, g, *last.get((p, d), (None, None))))
        last[p, d] = (g, s)
    have = {
        (r[PERF], r[DEV], seconds(r.time), r.gesture, r.prev_gesture, r.prev_time and seconds(r.prev_time))
        for r in got.collect()
    }
    assert have == want


def test_previous_row_with_ties(spark):
    rows = [(1, "a", 5, g) for g in (3, 1, 2)] + [(1, "a", 70, 4)]
    got = od.with_previous(gesture_frame(spark, rows), [PERF, DEV], ["gesture"], "time", ties=["gesture"])
    assert sorted((r.gesture, r.prev_gesture) for r in got.collect()) == [(1, None), (2, 1), (3, 2), (4, 3)]


def test_row_numbers(spark):
    rows = skewed_gestures(2)
    numbered = od.with_row_number(
        gesture_frame(spark, rows), [PERF], ["time", DEV], F.floor(F.unix_seconds("time") / 7)
    ).collect()
    for p in (1, 2):
        mine = sorted((r for r in numbered if r[PERF] == p), key=lambda r: (r.time, r[DEV]))
        assert [r.row_no for r in mine] == list(range(1, len(mine) + 1))


def group_pairs(rows):
    """(performance, time, previous time, to, from) per row; states None without a pair."""
    out, last = [], {}
    for p, d, s, g in sorted(rows, key=lambda r: r[2]):
        state = GESTURE_GROUPS.get(g)
        before = last.get((p, d))
        paired = before and before[0] is not None and state is not None
        out.append((p, s, before and before[1], state if paired else None, before[0] if paired else None))
        last[p, d] = (state, s)
    return out


def share(pairs):
    pairs = [x for x in pairs if x[3] is not None]
    return sum(x[3] != x[4] for x in pairs) / len(pairs) if pairs else 0.0


@pytest.mark.parametrize("chunk", [1, 4, 20, 100_000])
def test_rolling_flux(spark, chunk):
    rows = skewed_gestures(3)
    pairs = group_pairs(rows)
    want = {}
    for p in (1, 2):
        times = sorted({x[1] for x in pairs if x[0] == p})
        for i, t in enumerate(times[15:], 15):
            frame = set(times[i - 15 : i])
            want[p, t] = share([x for x in pairs if x[0] == p and x[1] in frame])
    steps = tr.state_steps(gesture_frame(spark, rows), chunk_seconds=20)
    got = {(r[PERF], seconds(r.time)): r.flux for r in se.rolling_flux(steps, chunk_seconds=chunk).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("trail,width", [(37, 15), (30, 15), (10, 15), (50, 10)])
def test_trailing_flux(spark, trail, width):
    rows = skewed_gestures(4, 250)
    want = {}
    for p in (1, 2):
        mine = [x for x in group_pairs(rows) if x[0] == p]
        for t in {x[1] for x in mine}:
            frame = [x for x in mine if t - trail <= x[1] <= t]
            bins = {}
            for x in frame:
                inside = x[2] is not None and x[2] >= t - trail
                bins.setdefault(x[1] // width, []).append(x if inside else (*x[:3], None, None))
            fluxes = [share(bins[b]) for b in sorted(bins)]
            want[p, t] = (fluxes[-1], fluxes[-1] - fluxes[-2] if len(fluxes) > 1 else 0.0)
    steps = tr.state_steps(gesture_frame(spark, rows), chunk_seconds=20)
    got = {(r[PERF], seconds(r.time)): (r.flux, r.flux_rise) for r in se.trailing_flux(steps, trail, width).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k]), k


@pytest.mark.parametrize("chunk_gaps,fan", [(1, 2**20), (3, 16), (60, 1024)])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_debounce(spark, chunk_gaps, fan, seed):
    rnd = random.Random(seed)
    rows = [(1, rnd.randrange(0, 300_000) / 1000) for _ in range(400)]
    rows += [(2, rnd.choice([0, 60, 61, 71, 500, 505, 999])) for _ in range(9)]
    rows += [(3, float(s)) for s in range(0, 100)]
    want = set()
    for p in (1, 2, 3):
        last = None
        for s in sorted(x[1] for x in rows if x[0] == p):
            if last is None or round((s - last) * 1e6) > 10_000_000:
                want.add((p, s))
                last = s
    got = {(r[PERF], seconds(r.time)) for r in se.debounced(event_frame(spark, rows), 10, chunk_gaps, fan).collect()}
    assert got == want


def test_rolling_features(spark):
    rnd = random.Random(5)
    rows = [(1, d, rnd.randrange(0, 60_000) / 1000, rnd.randrange(1024), rnd.randrange(768), rnd.choice([0, 0, 3, 8])) for d in "aab" for _ in range(60)]
    got = {(r[DEV], seconds(r.time)): r for r in fv.rolling_features(touch_frame(spark, rows)).collect()}
    for d in "ab":
        mine = [r for r in rows if r[1] == d]
        lo, hi = (int(f(r[2] for r in mine) // 5 * 5) for f in (min, max))
        assert sorted(t for dev, t in got if dev == d) == list(range(lo, hi + 1))
        for t in range(lo, hi + 1):
            frame = [r for r in mine if t - 5 <= r[2] <= t]
            row = got[d, t]
            assert row.freq == len(frame)
            assert row.touchdown_freq == sum(r[5] == 0 for r in frame)
            assert row.movement_freq == sum(r[5] != 0 for r in frame)
            if frame:
                assert row.centroid_x == pytest.approx(sum(r[3] for r in frame) / len(frame))


def test_forward_fill(spark):
    rows = [(1, at(0), 0.5), (1, at(15), 0.25), (1, at(60), 1.0), (2, at(30), 0.0)]
    s = spark.createDataFrame(rows, f"{PERF} int, time timestamp, flux double")
    got = {(r[PERF], seconds(r.time)): r.flux for r in se.forward_fill(s, [PERF], "time", ["flux"], 1, 20).collect()}
    want = {(1, float(t)): 0.5 if t < 15 else 0.25 if t < 60 else 1.0 for t in range(61)} | {(2, 30.0): 0.0}
    assert got == want


def test_folds_are_even_under_a_hot_label(spark):
    df = spark.range(300).withColumn("label", F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 3))
    split = ln.stratified_folds(df, "label", ["id"], 10, digits=2)
    sizes = split.groupBy("label", "fold").count().collect()
    per_label = {}
    for r in sizes:
        per_label.setdefault(r.label, []).append(r["count"])
    assert all(len(v) == 10 and max(v) - min(v) <= 1 for v in per_label.values())
    again = ln.stratified_folds(df.repartition(7), "label", ["id"], 10, digits=2)
    assert split.exceptAll(again).count() == 0


def test_bootstrap_and_slices(spark):
    df = spark.range(103)
    sample = ln.bootstrap(df, ["id"], digits=2)
    assert sample.count() == 103 and 50 < sample.select("id").distinct().count() < 80
    assert ln.bootstrap(df, ["id"], digits=2, size=50).count() == 50
    folds = {r.fold: r["count"] for r in ln.shuffled_slices(df, ["id"], 10, digits=2).groupBy("fold").count().collect()}
    assert folds == {**{k: 10 for k in range(10)}, None: 3}
    split = ln.shuffled_slices(df, ["id"], 10, digits=2)
    assert ln.training_rows(split, 4).count() == 93
