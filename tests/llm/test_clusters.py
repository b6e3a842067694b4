import hashlib

import numpy as np
import pytest

from fluxweave.llm import clusters as cl
from tests.compare import difference, duck
from tests.conftest import SMOKE


def brute(rows, k, rounds, scale=64, width=3):
    """(vec_id, cluster, distance) with Python's whole numbers."""
    good = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(good, key=key)[:k]]

    def assign():
        out = []
        for i, v in good:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (_, n, _) in zip(good, found) if n == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(assign(), key=repr), centroids


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int")


def test_query_equals_sql(spark):
    small = SMOKE.replace("sf0.001", "sf0.01")
    assert difference(cl.op11_ptolemaic_clusters(spark, small), duck(small), cl.OP11_SQL) is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force_with_ties_and_bad_rows(spark, seed):
    draw = np.random.default_rng(seed)
    rows = [(int(i % 90), [float(x) / 64 for x in draw.integers(-4, 5, 3)]) for i in range(120)]  # few places: many ties
    rows += [(200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [float("-inf"), 0.0, 0.0]), (205, []), (None, [0.5, 0.25, 0.0])]
    rows += [(300, [0.999 / 64, -0.001 / 64, 0.0])]
    found = cl.cluster(vectors_of(spark, rows), centroids=7, rounds=3, components=3)
    want, centroids = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 7, 3)
    assert sorted(map(tuple, found.rows.collect()), key=repr) == want
    assert found.centroids.tolist() == centroids


def test_fewer_vectors_than_centroids_and_none(spark):
    found = cl.cluster(vectors_of(spark, [(1, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])]), components=3)
    assert [r.distance for r in found.rows.collect()] == [0, 0] and {r.cluster for r in found.rows.collect()} == {0}
    assert cl.cluster(vectors_of(spark, []), components=3).rows.collect() == []


def test_bounds_are_never_above_the_distance():
    draw = np.random.default_rng(5)
    for size in (3, 1000, 1 << 26):
        rows = draw.integers(-size, size, (400, 64))
        rows[:50] = rows[50:100] + draw.integers(-1, 2, (50, 64))
        centroids = np.concatenate([rows[:10], rows[60:70]])
        pivots = cl.choose_pivots(rows[:12])
        bounds = cl.lower_bounds(cl.pivot_distances(rows, pivots), cl.pivot_distances(centroids, pivots), pivots.pairs)
        for c, centroid in enumerate(centroids):
            exact = cl.squared(rows, centroid)
            assert all(int(np.ceil(b * (1 << 20))) ** 2 <= (int(e) << 40) + (1 << 41) * (int(e) > 0) or b * b <= e for b, e in zip(bounds[:, c].tolist(), exact.tolist()))


def test_bounds_spare_most_comparisons_on_clustered_vectors(spark):
    draw = np.random.default_rng(9)
    middles = draw.normal(size=(12, 8))
    rows = [(i, (middles[i % 12] + 0.05 * draw.normal(size=8)).tolist()) for i in range(2400)]
    found = cl.cluster(vectors_of(spark, rows), centroids=16, components=8)
    assert all(done < 0.35 * full for done, full in found.examined)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="or more after scaling"):
        cl.cluster(vectors_of(spark, [(1, [1e30, 0.0, 0.0])]), components=3)
