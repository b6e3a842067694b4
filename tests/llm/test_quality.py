import zlib

import numpy as np

from fluxweave.llm import quality as q
from fluxweave.llm.words import utf8_column
from tests.conftest import SMOKE

import pyarrow as pa


def test_held_out_rows_are_ranked(spark):
    small = SMOKE.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = q.op6_quality_classifier(spark, small).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_context_sums_are_those_of_a_loop():
    data, offsets = utf8_column(pa.array(["a b c b", "b b, 12x", "", None, "c"]))
    bucket, kind, length, first = q.tokens(data, offsets)
    assert np.diff(first).tolist() == [4, 5, 0, 0, 1] and length.tolist()[-3:] == [2, 1, 1]
    index = q.index_vectors()
    want = {}
    for a, b in zip(first, first[1:]):
        for i in range(a, b):
            near = [j for j in range(a, b) if j != i and abs(i - j) <= q.REACH]
            row = want.setdefault(int(bucket[i]), np.zeros(q.WIDTH + 1, int))
            row[-1] += 1
            row[:-1] += sum((index[bucket[j]] for j in near), np.zeros(q.WIDTH, int))
    found, sums = q.context_sums(bucket, first, index)
    assert {int(f): s.tolist() for f, s in zip(found, sums)} == {k: v.tolist() for k, v in want.items()}


def test_edges(spark, docs_of, tmp_path):
    texts = [None, "", "  ", "word " * 50_000, "!!", "same text", "same text"]
    docs = docs_of(texts)
    vectors = q.word_vectors(docs)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    net = q.learn(docs, empty, vectors)
    scores = {r.doc_id: r.got for r in q.scored(docs, vectors, net, ["doc_id", "score"], "got").collect()}
    assert scores == dict.fromkeys(range(7), 0.5)  # nothing to learn from
    one = spark.createDataFrame([(3, 1), (4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    assert q.learn(docs, one, vectors).score(np.zeros((1, 2 * q.WIDTH + q.SURFACE)))[0] > 0.5
    none = docs.limit(0)
    assert q.scored(none, q.word_vectors(none), net, ["doc_id"]).count() == 0
    one.write.parquet(str(tmp_path / "labels.parquet"))
    kept = q.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 7


def test_rows_of_one_id_are_learnt_once(docs_of, monkeypatch):
    """A labelled id with most of all rows: one row reaches the fit."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = docs_of([(i, f"text of number {i}") for i in ids] + [(ids[0], f"other text {k % 3}") for k in range(900)])
    labels = docs.sparkSession.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    vectors, fits = q.word_vectors(docs), []
    monkeypatch.setattr(q, "fit", lambda x, y: fits.append((x, y)))
    q.learn(docs, labels, vectors)
    q.learn(docs.repartition(5), labels, vectors)
    q.learn(docs, labels, vectors, max_rows=7)
    assert [len(x) for x, _ in fits] == [len(ids), len(ids), 7] and fits[0][1].tolist() == [i % 2 for i in ids]
    assert (fits[0][0] == fits[1][0]).all()


def test_fit_separates_and_calibrates():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(2000, 2 * q.WIDTH + q.SURFACE))
    y = (draw.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = q.fit(x, y).score(x)
    for low, high in ((0, 0.2), (0.4, 0.6), (0.8, 1)):
        some = (p >= low) & (p < high)
        assert abs(p[some].mean() - y[some].mean()) < 0.12
