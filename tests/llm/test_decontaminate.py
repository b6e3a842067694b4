import random
import re

import pytest

from fluxweave.llm import decontaminate as dc
from fluxweave.llm import words as wd
from tests.compare import difference, duck
from tests.conftest import SMOKE

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(dc.UPPER, dc.LOWER)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, n=10):
    """doc_id -> (n_words, hit words, items)."""
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[tuple(w[s : s + size])]
        out[doc] = (len(w), hit, sorted(str(i) for i in found if i is not None))
    return out


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, hits string")


def found(df):
    return {r.doc_id: (r.n_words, {w for h in r.hits for w in range(h.first_word, h.last_word + 1)}, list(r["items"])) for r in df.collect()}


def test_query_equals_sql(spark):
    assert difference(dc.op12_decontaminate(spark, SMOKE), duck(SMOKE), dc.OP12_SQL) is None


@pytest.fixture
def mixed():
    draw = random.Random(4)
    word = lambda: draw.choice(("a", "B", "é", "ÉÀ", "x9", "7", "Über", "don", "t"))
    text = lambda size: draw.choice((" ", ", ", "\n", "--")).join(word() for _ in range(size))
    items = [(i, text(draw.choice((1, 3, 9, 10, 11, 30)))) for i in range(-3, 25)]
    items += [(5, items[2][1]), (6, items[2][1]), (None, "only here once"), (7, None), (8, ""), (9, "...")]
    docs = [(i, text(draw.randrange(60)) + draw.choice(items)[1].__str__().upper() * draw.randrange(2) + " " + text(20)) for i in range(80)]
    docs += [(90, None), (91, ""), (92, "!?"), (93, "ONLY here-once"), (94, items[0][1]), (95, text(3000))]
    return docs, items


def test_equals_brute_force(spark, docs_of, mixed):
    docs, items = mixed
    assert found(dc.with_hits(docs_of(docs), items_of(spark, items))) == brute(docs, items)


def test_benchmark_in_parts(spark, docs_of, mixed):
    docs, items = mixed
    out = dc.with_hits(docs_of(docs), items_of(spark, items), part_bytes=300)
    assert found(out) == brute(docs, items)
    assert [c for c in out.columns if c not in dc.HIT_COLUMNS] == [c for c in docs_of(docs).columns if c not in dc.HIT_COLUMNS]


def test_long_texts_and_items_in_pieces(spark, docs_of, mixed, monkeypatch):
    docs, items = mixed
    monkeypatch.setattr(dc, "PIECE_WORDS", 4)
    assert found(dc.with_hits(docs_of(docs), items_of(spark, items), block_bytes=64)) == brute(docs, items)


@pytest.mark.parametrize("limit", [1, 7, 40, 1000])
def test_pieces_hold_every_word_once(limit):
    import pyarrow as pa

    draw = random.Random(limit)
    texts = ["".join(draw.choice("ab é\n,") for _ in range(draw.randrange(200))) for _ in range(30)] + ["", "x" * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    seen, words_seen, rows = [], [], 0
    for part, data, offsets, base, owned, whole in wd.text_pieces(iter([batch]), "text", dc.GAP, 3, dc.LOWERED, limit):
        starts, ends, first = wd.word_spans(data, offsets, dc.GAP)
        mine = [data[a:b].tobytes().decode() for a, b in zip(starts, ends) if a < owned]
        after = len(starts) - len(mine)
        assert after <= 3 or whole
        words_seen += mine
        rows += part.num_rows if whole else 0
    assert words_seen == [w for t in texts for w in words(t)]
    assert rows == len(texts) and seen == []


def test_one_hash_for_all_windows(spark, mixed, monkeypatch):
    docs, items = mixed
    monkeypatch.setattr(dc, "span_hash", lambda values, a, b, *base: (b - a).astype("uint64") << 40)
    pieces = [(None if i is None else str(i), " ".join(words(t))) for i, t in items if words(t)]
    windows = dc.Windows(pieces, 10)
    for doc, text in docs:
        data = " ".join(words(text)).encode()
        import numpy as np

        buffer = np.frombuffer(data, np.uint8)
        starts, ends, first = wd.word_spans(buffer, np.array([0, len(data)]), dc.GAP)
        at, size, window = windows.hits(buffer, starts, ends, first)
        hit = {w for a, s in zip(at, size) for w in range(a, a + s)}
        assert (hit, windows.items_of(window)) == brute([(doc, text)], items)[doc][1:]


def test_spans_and_documents_are_removed(spark, docs_of):
    passage = "one two three four five six seven eight nine ten"
    docs = docs_of([(1, f"Été: {passage.upper()}! Then ünd more."), (2, "clean text"), (3, None), (4, passage), (5, f"{passage} - {passage}, x")])
    out = dc.with_hits(docs, items_of(spark, [(1, passage)]))
    cut = {r.doc_id: r.text for r in dc.without_hits(out).collect()}
    assert cut == {1: "Été: ! Then ünd more.", 2: "clean text", 3: None, 4: "", 5: ", x"}
    assert {r.doc_id for r in dc.without_hits(out, largest_share=0).collect()} == {2, 3}
    assert {r.doc_id: r.text for r in dc.without_hits(out, largest_share=0.8).collect()} == {1: "Été: ! Then ünd more.", 2: "clean text", 3: None}


def test_empty_tables(spark, docs_of):
    assert found(dc.with_hits(docs_of([(1, "a b")]), items_of(spark, []))) == {1: (2, set(), [])}
    assert found(dc.with_hits(docs_of([]), items_of(spark, [(1, "a b")]))) == {}
