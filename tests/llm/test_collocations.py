import random
import re
from collections import Counter

import pytest

from fluxweave.llm import collocations as co
from tests.compare import difference, duck
from tests.conftest import SMOKE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, longest=3, least=10, absorbed=50):
    """(lang, phrase) -> (a, l, r, n, score), with Python's whole numbers."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws, lang = re.findall("[^\x20\x09]+", piece), "und" if lang is None else lang
            n[lang] += len(ws)
            for size in range(1, longest + 1):
                f.update((lang, *ws[s : s + size]) for s in range(len(ws) - size + 1))
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = {}
    for (lang, *ws), a in frequent.items():
        for size in range(2, len(ws)):
            for s in range(len(ws) - size + 1):
                key = (lang, *ws[s : s + size])
                longer[key] = max(longer.get(key, 0), a)
    out = {}
    for p, a in frequent.items():
        lang, *ws = p
        if 100 * longer.get(p, -1) >= absorbed * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out[lang, " ".join(ws)] = (a, f[lang, *ws[:k]], f[lang, *ws[k:]], n[lang], score)
    return out


def documents(spark, rows, partitions=5):
    df = spark.createDataFrame([(t, g, "x", 1) for t, g in rows], "text string, lang string, phrase string, n int")
    return df.repartition(partitions)


def found(df):
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def ranked(want):
    """(lang, phrase) -> rank."""
    out = {}
    for lang in {g for g, _ in want}:
        mine = sorted((p for g, p in want if g == lang), key=lambda p: (-want[lang, p][4], -want[lang, p][0], p.encode()))
        out |= {(lang, p): i + 1 for i, p in enumerate(mine)}
    return out


def some_texts(seed, size=150):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ü", "A'b", "x-y", " ", "日本"]
    gap = lambda: draw.choice((" ",) * 12 + ("  ", "\t", ". ", ",", "\n", ";x"))
    rows = []
    for _ in range(size):
        text = "".join(draw.choice(vocabulary) + gap() for _ in range(draw.randrange(60)))
        rows.append((text + "New York City" * draw.randrange(2), draw.choice(("en", "en", "en", "fr", None, ""))))
    return rows + [(None, "en"), ("", "fr"), (" \t.", None), rows[0], rows[0], ("a a a a a a a a a a a a a", "de")]


def test_query_equals_sql(spark):
    assert difference(co.op13_collocations(spark, SMOKE), duck(SMOKE), co.OP13_SQL) is None


@pytest.mark.parametrize("seed,longest,least,shards", [(1, 3, 10, 4), (2, 3, 3, 1), (3, 4, 4, 3), (4, 2, 10, 50), (5, 5, 2, 2)])
def test_equals_brute_force(spark, seed, longest, least, shards):
    rows = some_texts(seed)
    out = co.collocations(documents(spark, rows), longest=longest, least=least, shards=shards, top=None)
    want = brute(rows, longest, least)
    assert found(out) == want
    assert {(r.lang, r.phrase): r["rank"] for r in out.collect()} == ranked(want)


def test_top_is_cut_after_ranking(spark):
    rows = some_texts(8)
    out = co.collocations(documents(spark, rows), top=3)
    assert {(r.lang, r.phrase): r["rank"] for r in out.collect()} == {k: v for k, v in ranked(brute(rows)).items() if v <= 3}


def test_full_bit_fields_change_nothing(spark, monkeypatch):
    rows = some_texts(9)
    monkeypatch.setattr(co.BitField, "has", lambda self, keys: keys == keys)
    assert found(co.collocations(documents(spark, rows), top=None)) == brute(rows)


def test_small_blocks_cut_long_texts(spark, monkeypatch):
    import pyarrow as pa

    text = " ".join(random.Random(2).choice("abc") for _ in range(400)) + ". a b"
    batch = pa.RecordBatch.from_arrays([pa.array([text, "a b c", ""]), pa.array(["en", "en", "fr"])], ["text", "lang"])
    want = Counter(zip(*[text.split(". ")[0].split()[i:] for i in range(3)]))
    want[("a", "b", "c")] += 1
    monkeypatch.setattr(co, "BLOCK_BYTES", 50)
    seen = Counter()
    for block in co._blocks(iter([batch]), 3):
        words = [block.words[int(block.unit_word[u])].as_py() for u in block.unit]
        for s, ok in enumerate(block.starts(3)):
            if ok:
                seen[tuple(words[s : s + 3])] += 1
    assert seen == want


def test_products_beyond_64_bits(spark):
    big = 10**14
    counts = spark.createDataFrame([("en", 1, "a", big + 7), ("en", 1, "b", big + 11), ("en", 2, "a b", big)], "lang string, size int, phrase string, n long")
    assert found(co.scored(counts).withColumn("n", F_lit(0)))[("en", "a b")][4] == 1_000_000 * big * big // ((big + 7) * (big + 11))


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_empty_table(spark):
    assert co.collocations(documents(spark, [])).collect() == []
    assert co.collocations(documents(spark, [(None, None)])).collect() == []
