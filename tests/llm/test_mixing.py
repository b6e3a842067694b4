import random
from collections import Counter
from fractions import Fraction

import pytest

from fluxweave.llm import mixing as mx
from tests.conftest import SMOKE


@pytest.mark.parametrize("seed", range(8))
def test_less_than_one_block_off(seed):
    draw = random.Random(seed)
    whole = mx.whole_weights({f"s{i}": draw.random() ** 3 + 1e-3 for i in range(draw.randint(1, 30))}, draw.choice((10, 100, 1000)))
    period = sum(whole.values())
    plan = mx.one_period(whole)
    assert [slot for *_, slot in plan] == list(range(period)) and Counter(s for s, *_ in plan) == whole
    done = Counter()
    for source, block, slot in plan:
        assert block == done[source]
        release, deadline = mx.window(block, whole[source], period)
        assert release <= slot < deadline
        done[source] += 1
        assert all(abs(done[s] - Fraction((slot + 1) * w, period)) < 1 for s, w in whole.items())


@pytest.mark.parametrize("sizes", ([10**6] * 7 + [2 * 10**6], [10**5 + 7 * k * k for k in range(31)] + [9 * 10**6], [1 + k * k for k in range(2000)]))
def test_less_than_one_block_off_the_unrounded_targets(sizes):
    """Over 30 times the 1000 slots that weights were once rounded to; between a source's own blocks its deviation only falls or rises."""
    weights = {f"s{i:04}": n**0.5 for i, n in enumerate(sizes)}
    total = sum(Fraction(w) for w in weights.values())
    share = {s: Fraction(w) / total for s, w in weights.items()}
    slots = 30_000
    blocks = {s: int(slots * w) for s, w in share.items()}
    done, last = Counter(), -1
    for source, block, _, _, slot in mx.in_slots(mx.exact_weights(weights), blocks):
        assert block == done[source] and slot > last
        assert slot * share[source] - block < 1 and block + 1 - (slot + 1) * share[source] < 1
        done[source], last = block + 1, slot
    assert done == Counter(blocks) and last <= slots
    assert mx.exact_weights({"a": 0.5, "b": 1.5, "c": 3}) == {"a": 1, "b": 3, "c": 6}


def test_long_mix_keeps_the_unrounded_targets(spark):
    """20 000 slots of one row: rounded to 1000 slots, the shares of 2/3, 1/5 and 2/15 are blocks off."""
    sizes = {"a": 13_333, "b": 4_000, "c": 2_667}
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id < 13333 THEN 'a' WHEN id < 17333 THEN 'b' ELSE 'c' END AS source")
    weights = {"a": 10.0, "b": 3.0, "c": 2.0}
    got = mx.schedule(docs, weights, block_rows=1).collect()
    assert Counter(r.source for r in got) == sizes and len({r.position for r in got}) == 20_000
    for r in got:
        share = Fraction(int(weights[r.source]), 15)
        assert r.slot * share - r.block < 1 and r.block + 1 - (r.slot + 1) * share < 1
    with pytest.raises(ValueError):
        mx.schedule(docs, {"a": 1.0, "b": 1.0})


def test_weights():
    assert mx.whole_weights({"a": 1, "b": 1, "c": 2}, 100) == {"a": 25, "b": 25, "c": 50}
    assert mx.whole_weights({"a": 1e-9, "b": 1}, 10) == {"a": 1, "b": 9}
    assert mx.whole_weights({}, 10) == {} and mx.one_period({}) == []
    with pytest.raises(ValueError):
        mx.whole_weights({"a": 0.0})


def test_schedule(spark):
    sizes = {"hot": 900, "a": 150, "b": 150, None: 70}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame([(i, s, "x", 1) for i, s in rows], "doc_id long, source string, text string, slot int")
    weights = {"hot": 3.0, "a": 4.0, "b": 2.0, "": 1.0}
    got = sorted(mx.schedule(docs, weights, block_rows=5, period=20).collect(), key=lambda r: r.position)
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows] and len({r.position for r in got}) == len(rows)
    assert all(r.release <= r.slot < r.deadline and r.position // 5 == r.slot and r.source_row // 5 == r.block for r in got)
    last = min(max(r.slot for r in got if r.source == s) for s in weights)
    done = Counter()
    for slot in range(last):
        done.update(r.source for r in got if r.slot == slot and r.source_row % 5 == 0)
        assert all(abs(done[s] - (slot + 1) * w / 10) < 1 for s, w in weights.items())
    assert [r.doc_id for r in got] == [r.doc_id for r in sorted(mx.schedule(docs.repartition(7), weights, 5, 20).collect(), key=lambda r: r.position)]


def test_edges(spark, docs_of):
    docs = docs_of([(None, "a"), (1, None), (1, None), (2, "c")]).withColumnRenamed("n_words", "position")
    assert mx.schedule(docs).count() == 4
    out = mx.mixed(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "2", "None"]
    assert mx.schedule(docs.limit(0)).count() == 0 and mx.mixed(docs.limit(0)).count() == 0


def test_files_hold_the_mix_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    mx.stage(spark, docs, SMOKE).write.parquet(str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").glob("part-*.parquet"))
    found = [r.doc_id for n in names for r in spark.read.parquet(str(tmp_path / "out" / n)).collect()]
    assert found == [r.doc_id for r in sorted(mx.op9_mix_sources(spark, SMOKE).collect(), key=lambda r: r.position)]
