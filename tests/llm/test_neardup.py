import random
from itertools import combinations

import numpy as np
import pytest

from fluxweave.llm import neardup as nd
from fluxweave.llm.components import components
from fluxweave.llm.words import utf8_column
from tests.conftest import SMOKE

import pyarrow as pa


def weighted(texts, idf):
    data, offsets = utf8_column(pa.array(list(texts.values()), pa.string()))
    row, names, count = nd.shingles(data, offsets)
    out = {i: {} for i in texts}
    ids = list(texts)
    for r, n, c in zip(row, names, count):
        out[ids[r]][int(n)] = (int(c), float(idf[int(n) >> 44]))
    return out


def brute_classes(texts, idf, similar=0.8):
    sets, root = weighted(texts, idf), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        low = sum(min(x[k][0], y[k][0]) * x[k][1] for k in x.keys() & y.keys())
        high = sum(c * w for s in (x, y) for c, w in s.values()) - low
        plain = len(x.keys() & y.keys()) / max(len(x.keys() | y.keys()), 1)
        if high and max(low / high, plain) >= similar:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}


def group_of(draw, base, copies, edits):
    out = []
    for _ in range(copies):
        words = base[:]
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"new{draw.random()}"
        out.append(" ".join(words))
    return out


def test_classes_equal_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)  # so that a cluster is several blocks
    draw = random.Random(5)
    texts = []
    for g in range(12):
        base = [f"w{draw.randrange(4000)}" for _ in range(draw.choice((6, 40, 150, 400)))]
        texts += group_of(draw, base, draw.choice((2, 3, 20, 40)), 5)
    texts += [" ".join(f"u{draw.randrange(10**6)}" for _ in range(100)) for _ in range(50)]
    draw.shuffle(texts)
    texts = dict(enumerate(texts))
    docs = docs_of(list(texts.items()))
    got = {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()}
    want = brute_classes(texts, nd.idf_table(docs))
    wrong = [i for i in texts if got[i] != want[i]]
    assert len(wrong) <= 2, wrong  # a pair just above the threshold may meet in no band


def test_copies_that_repeat_a_passage(docs_of):
    """Nearly the same set of shingles, one passage 20 times in one text: alike by the plain measure only."""
    draw = random.Random(9)
    texts = []
    for _ in range(40):
        words = [f"w{draw.randrange(10**6)}" for _ in range(120)]
        texts += [" ".join(words), " ".join(words + words[40:60] * 20)]
    texts = dict(enumerate(texts))
    docs = docs_of(list(texts.items()))
    want = brute_classes(texts, nd.idf_table(docs))
    assert all(want[i] == i - i % 2 for i in texts)
    assert {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()} == want


def test_plain_samples_meet_as_often_as_the_sets_are_alike():
    draw = np.random.default_rng(3)
    names = nd.mix(draw.integers(1, 2**62, 300).astype(np.uint64))
    met = []
    for salt in range(40):
        n = nd.mix(names + np.uint64(salt))
        picks = nd.plain_samples(np.r_[np.zeros(250, int), np.full(250, 2)], np.r_[n[:250], n[50:]], 3)
        met.append((picks[0] == picks[2]).mean())
        assert not picks[1].any()
    assert abs(np.mean(met) - 200 / 300) < 0.03


def test_samples_meet_as_often_as_the_sets_are_alike():
    draw = np.random.default_rng(2)
    names = nd.mix(draw.integers(1, 2**62, 300).astype(np.uint64))
    weight = draw.uniform(0.5, 4, 300)
    a, b = np.sort(draw.permutation(300)[:230]), np.sort(draw.permutation(300)[:230])
    w2 = weight * draw.choice((1.0, 2.0), 300)
    union = np.zeros((2, 300))
    union[0, a], union[1, b] = weight[a], w2[b]
    want = union.min(0).sum() / union.max(0).sum()
    row = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    met = []
    for salt in range(40):
        n = nd.mix(names + np.uint64(salt))
        both = np.r_[n[a], n[b]]
        picks = nd.samples(row, both, np.r_[weight[a], w2[b]], 2)
        met.append((picks[0] == picks[1]).mean())
    assert abs(np.mean(met) - want) < 0.03


@pytest.mark.parametrize("shape", ["chain", "hub", "ring"])
def test_components(spark, shape):
    n = 60
    pairs = {"chain": [(i, i + 1) for i in range(n)], "hub": [(n, i) for i in range(n)], "ring": [(i, (i * 7 + 7) % 49) for i in range(0, 49, 7)]}[shape]
    pairs += [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    links = spark.createDataFrame(pairs, "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    seen = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    assert set(got) == seen and got[1001] == got[1000] == 1000
    assert shape == "ring" or all(got[x] == 0 for x in seen if x < 1000)


def test_edges(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", " \n", "one two", "one two", "one  two", long, long, long + " more", "x " * 100_000, (None, long), (7, long)]
    docs = docs_of(texts)
    got = {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 8: 6, 9: 9}
    assert nd.near_classes(docs.limit(0)).count() == 0
    kept = nd.stage(spark, docs, SMOKE)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [0, 1, 2, 3, 6, 9] and kept.filter("doc_id is null").count() == 1


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.class_id for r in nd.op3_minhash_near_dedup(spark, SMOKE).collect()}
    assert got == brute_classes(texts, nd.idf_table(docs))


def test_regular_texts_are_not_taken_for_copies(docs_of):
    """Letters in Thue-Morse order and their complement, which no polynomial modulo 2**64 tells apart."""
    order = [bin(i).count("1") % 2 for i in range(4096)]
    texts = [gap.join("ab"[x ^ side] for x in order) for gap in (" ", "") for side in (0, 1)]
    got = {r.doc_id: r.class_id for r in nd.near_classes(docs_of([texts[2], texts[3]])).collect()}
    assert got == {0: 0, 1: 1}
    keys = nd.signed(docs_of(texts), nd.idf_table(docs_of(texts))).select("words_key").distinct()
    assert keys.count() == 4
