import numpy as np

from fluxweave.llm import neardup_vectors as nv
from tests.conftest import SMOKE


def brute(rows, cosine=0.98):
    """vec_id -> (n_links, component) over (vec_id, vector, label)."""
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (links[i], find(i)) for i in links}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_query_equals_brute_force(spark):
    small = SMOKE.replace("sf0.001", "sf0.01")
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    out = nv.op4_embedding_near_dedup(spark, small)
    assert result(out) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.collect())


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nv, "BLOCK", 16)
    draw = np.random.default_rng(4)
    rows = []
    for g in range(5):
        centre = draw.normal(size=24)
        for _ in range(draw.integers(2, 90)):
            rows.append((len(rows) * 3, [float(x) for x in (centre + draw.normal(size=24) * draw.choice((0.0, 0.1, 0.18))).astype(np.float32)], int(g % 2)))
    df = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got, want = result(nv.links_and_components(df)), brute(rows)
    assert sum(got[i] != want[i] for i in want) <= 1  # a pair meets in no table once in a million


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0),
        (9, [inf, 1.0], 0), (10, [None, 1.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [-1.0, -0.0], 0), (13, [-1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert result(nv.links_and_components(df)) == brute(rows)
    twice = nv.links_and_components(df.filter("vec_id < 2").unionAll(df.filter("vec_id < 2"))).collect()
    assert [(r.vec_id, r.n_links, r.kept) for r in twice] == [(1, 1, True)] * 2
    assert nv.links_and_components(df.limit(0)).count() == 0
    nobody = nv.links_and_components(df.selectExpr("cast(null as long) vec_id", "embedding", "label"))
    assert {r.n_links for r in nobody.collect()} == {0} and nobody.count() == len(rows)
