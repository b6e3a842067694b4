"""Forests that grow together, against a plain recursion and against other cuts of the work."""

import random
from collections import Counter

import numpy as np
import pytest

from fluxweave.operators import forests as fo
from fluxweave.operators import learning as ln

COLUMNS = [f"c{i}" for i in range(5)]


@pytest.fixture(autouse=True)
def quiet():
    with np.errstate(over="ignore"):
        yield


def some_rows(spark, n=160, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x = [draw.choice((None, float("nan"), 0.5)) if draw.random() < 0.05 else draw.random() for _ in COLUMNS]
        rows.append((i, *x, draw.randrange(3) if draw.random() < 0.3 else int((x[0] or 0) > 0.5) + int((x[1] or 0) > 0.7)))
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in COLUMNS) + ", gesture int")


def guessed(df):
    return {(r.run, r.fold, r.id): r.prediction for r in df.collect()}


def plain_tree(rows, weight, drawn_of, path, depth, labels):
    """The tree as nested tuples (feature, bin, left, right) or a leaf's counts."""
    counts = [sum(w for w, y in zip(weight, rows.y) if y == k) for k in range(labels)]
    if sum(c > 0 for c in counts) <= 1 or depth == 0:
        return tuple(counts)
    gini = lambda c: sum(x * x for x in c) / sum(c)
    best = None
    for j, f in enumerate(drawn_of(path)):
        for b in range(fo.BINS - 1):
            left = [sum(w for w, y, x in zip(weight, rows.y, rows.x[:, f]) if y == k and x <= b) for k in range(labels)]
            right = [c - v for c, v in zip(counts, left)]
            if sum(left) and sum(right):
                purity = gini(left) + gini(right)
                if purity > gini(counts) * (1 + 1e-12) and (best is None or purity > best[0] * (1 + 1e-12)):
                    best = purity, f, b
    if best is None:
        return tuple(counts)
    _, f, b = best
    sides = [[w if (x <= b) == go else 0 for w, x in zip(weight, rows.x[:, f])] for go in (True, False)]
    down = [fo._mix(path * np.uint64(2) + np.uint64(k)) for k in (1, 2)]
    return (int(f), b, *[plain_tree(rows, side, drawn_of, p, depth - 1, labels) for side, p in zip(sides, down)])


def shape(grown, node, of):
    """A grown tree in the same form; leaves by their most frequent label."""
    if grown.child[node] < 0:
        return "leaf", int(grown.label[node])
    return int(grown.feature[node]), int(grown.bin[node]), shape(grown, grown.child[node], of), shape(grown, grown.child[node] + 1, of)


def named(tree, depth=0):
    if isinstance(tree[-1], tuple):
        return tree[0], tree[1], named(tree[2]), named(tree[3])
    return "leaf", int(np.argmax(tree))


def test_trees_are_those_of_a_plain_recursion(spark):
    folded = ln.folds_of_runs(some_rows(spark), "gesture", ["id"], 3, 2)
    rows = fo.prepared(folded, COLUMNS, "gesture", ["id"], [0, 1, 2])
    jobs = [(0, 1), (1, 2)]
    grown = fo.grow(rows, 160, jobs, trees=4, per_split=2, depth=6, labels=3, features=len(COLUMNS))
    block = fo._rows_of(rows.toArrow().combine_chunks().to_batches()[0])
    for t in range(8):
        u = (fo._mix(block.key ^ grown.key[t]) >> np.uint64(11)).astype(float) * 2.0**-53
        weight = np.searchsorted(fo._POISSON, u, side="right") * (block.folds[:, grown.run[t]] != grown.fold[t])
        drawn = lambda path: fo.drawn_features(np.array([path]), len(COLUMNS), 2)[0]
        want = plain_tree(block, weight.tolist(), drawn, grown.path[t], 6, 3)
        assert shape(grown, t, 3) == named(want)


@pytest.mark.parametrize("setting", [{"GROUP_INSTANCES": 1}, {"UNIT_INSTANCES": 1}, {"GROUP_INSTANCES": 160 * 8 * 2, "UNIT_INSTANCES": 700}])
def test_result_does_not_depend_on_how_the_work_is_cut(spark, monkeypatch, setting):
    df = some_rows(spark)
    want = guessed(ln.cross_validate(df, COLUMNS, "gesture", ["id"], folds=3, runs=2, trees=8))
    for name, value in setting.items():
        monkeypatch.setattr(fo, name, value)
    assert guessed(ln.cross_validate(df.repartition(7), COLUMNS, "gesture", ["id"], folds=3, runs=2, trees=8)) == want
    assert Counter((r, i) for r, _, i in want) == Counter((r, i) for r in range(2) for i in range(160))


def test_folds_of_all_runs_are_those_of_each(spark):
    df = some_rows(spark)
    got = {r.id: r.folds for r in ln.folds_of_runs(df, "gesture", ["id"], 4, 3).collect()}
    for run in range(3):
        assert {r.id: r.fold for r in ln.stratified_folds(df, "gesture", ["id"], 4, run).collect()} == {i: f[run] for i, f in got.items()}


def test_features_are_drawn_without_repeats():
    paths = fo._mix(np.arange(40_000, dtype=np.uint64))
    for features, per_split in ((5, 3), (64, 3), (3, 3)):
        drawn = fo.drawn_features(paths, features, per_split)
        assert all(len(set(r)) == per_split for r in drawn[:500].tolist())
        share = np.bincount(drawn.ravel(), minlength=features) / drawn.size
        assert np.abs(share * features - 1).max() < 0.1


def test_rows_without_labels_and_empty_tables(spark):
    df = some_rows(spark, 40)
    from pyspark.sql import functions as F

    some = df.withColumn("gesture", F.when(F.col("id") % 4 > 0, F.col("gesture")))
    assert {i for _, _, i in guessed(ln.cross_validate(some, COLUMNS, "gesture", ["id"], folds=2, trees=3))} == {i for i in range(40) if i % 4}
    out = ln.cross_validate(df.limit(0), COLUMNS, "gesture", ["id"], folds=2, trees=3)
    assert out.columns == ["run", "fold", "id", "gesture", "prediction"] and out.collect() == []
    one = ln.cross_validate(df.withColumn("gesture", F.lit(7)), COLUMNS, "gesture", ["id"], folds=2, trees=3)
    assert set(guessed(one).values()) == {7}


def test_probabilities_of_mixed_leaves_are_averaged():
    grown = fo.Trees.planted([(0, 0)], 2, 2, 0)
    rows = fo.Rows(np.zeros((1, 1), np.uint8), np.zeros(1), np.ones((1, 1)), np.zeros(1, np.uint64))
    fo._end(grown, np.array([0, 1]), np.array([[3, 1], [0, 5]]))
    assert fo.votes(rows, np.array([0]), grown, slice(0, 2), 2).tolist() == [[0.75, 1.25]]


def test_forests_of_one_task_are_those_of_levels(spark, monkeypatch):
    """Trees, and so guesses, do not depend on where they are grown; a task's forests need no job for every level."""
    df = some_rows(spark, 400)
    want, used = {}, []
    level = fo._level
    monkeypatch.setattr(fo, "_level", lambda *a: used.append(1) or level(*a))
    for dense in (1, 40, 10_000):
        monkeypatch.setattr(fo, "DENSE_ROWS", dense)
        want[dense] = guessed(ln.cross_validate(df, COLUMNS, "gesture", ["id"], folds=3, runs=2, trees=8))
    assert not used
    monkeypatch.setattr(fo, "PART_CELLS", 500)
    assert guessed(ln.cross_validate(df, COLUMNS, "gesture", ["id"], folds=3, runs=2, trees=8)) == want[1]
    monkeypatch.setattr(fo, "ALONE_CELLS", 0)
    assert guessed(ln.cross_validate(df, COLUMNS, "gesture", ["id"], folds=3, runs=2, trees=8)) == want[1] == want[40] == want[10_000]
    assert used


def test_driver_holds_only_the_tops_of_the_trees(spark, monkeypatch):
    """Where no task can hold all rows, tasks grow what lies below nodes that they can hold; trees, and so guesses, are the same."""
    df = some_rows(spark, 400)
    more = df.union(df.filter("id < 9")).union(df.filter("id = 20").selectExpr("CAST(NULL AS LONG) AS id", *COLUMNS, "gesture"))
    rows, depth = 410, 10
    said = lambda: Counter(ln.cross_validate(more, COLUMNS, "gesture", ["id"], folds=2, trees=4, depth=depth).collect())
    want, held, grow = said(), [], fo.grow
    monkeypatch.setattr(fo, "grow", lambda *a: held.append(grow(*a)) or held[-1])
    for most, settings in ((60, {}), (120, {"GROUP_INSTANCES": 1, "ROUTED_INSTANCES": 900, "UNIT_INSTANCES": 1})):
        monkeypatch.setattr(fo, "ALONE_CELLS", most * (len(COLUMNS) + 64 + 8 * 3))
        for name, value in settings.items():
            monkeypatch.setattr(fo, name, value)
        held.clear()
        assert said() == want
        assert sum(len(g.key) for g in held) == 2 * 4
        for g in held:
            split = np.bincount(g.tree[g.child >= 0])
            assert (g.label == fo.BELOW).any() and split.max() <= depth * (rows * 1.2 / most)  # few nodes of a level have more rows


def test_one_task_grows_the_trees_of_a_plain_recursion(spark):
    folded = ln.folds_of_runs(some_rows(spark), "gesture", ["id"], 3, 2)
    rows = fo.prepared(folded, COLUMNS, "gesture", ["id"], [0, 1, 2])
    block = fo._rows_of(rows.toArrow().combine_chunks().to_batches()[0])
    jobs = [(0, 1), (1, 2)]
    want = fo.grow(rows, 160, jobs, trees=4, per_split=2, depth=6, labels=3, features=len(COLUMNS))
    for t in range(8):
        one = fo.Trees.planted([jobs[t // 4]], 1, 3, 0)
        one.key, one.path = want.key[t : t + 1], want.path[t : t + 1]
        got = fo.grown_alone(block, one, 2, 6, 3)
        assert shape(got, 0, 3) == shape(want, t, 3)


def test_rows_that_share_their_identity_are_all_predicted(spark):
    df = some_rows(spark, 60)
    more = df.union(df.filter("id < 9")).union(df.filter("id = 20").selectExpr("CAST(NULL AS LONG) AS id", *COLUMNS, "gesture"))
    out = ln.cross_validate(more, COLUMNS, "gesture", ["id"], folds=3, runs=2, trees=3)
    assert Counter((r.run, r.id) for r in out.collect()) == Counter((run, r.id) for r in more.collect() for run in range(2))
