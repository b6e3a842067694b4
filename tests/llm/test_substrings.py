import hashlib
import random

import numpy as np
import pytest

from fluxweave.llm import substrings as sub
from tests.conftest import SMOKE


def brute(texts: dict, window=50):
    """doc_id -> (words, removed, kept) by comparing every window with every other."""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = True
        out[i] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def found(docs, **kw):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sub.without_repeats(docs, **kw).collect()}


@pytest.mark.parametrize("seed,alphabet", [(1, 2), (2, 3), (3, 40), (4, 5000)])
def test_equals_brute_force(docs_of, seed, alphabet):
    draw = random.Random(seed)
    word = lambda: str(draw.randrange(alphabet))
    shared = [[word() for _ in range(draw.choice((49, 50, 51, 60, 200)))] for _ in range(6)]
    shared += [["z"] * 70, ["a", "b"] * 40, ["q"] * 30 + [word() for _ in range(20)]]
    texts = {}
    for i in range(60):
        parts = []
        for _ in range(draw.randint(0, 4)):
            parts += draw.choice(shared)[draw.randint(0, 8) :] if draw.random() < 0.6 else [word() for _ in range(draw.randint(0, 80))]
        texts[i * 3] = draw.choice((" ", "\n", "  \t")).join(parts)
    texts[7] = texts[6]
    assert found(docs_of(list(texts.items()))) == brute(texts)


@pytest.mark.parametrize("length", [50, 51, 53])
def test_a_window_is_found_in_any_surroundings(length):
    """One repeat of the least length, among runs and words of few kinds, always shows a common name."""
    draw, scheme = np.random.default_rng(length), sub.Scheme()
    for trial in range(300):
        kinds = int(draw.integers(1, 6))
        middle = draw.integers(0, kinds, length).astype(np.uint64)
        sides = [draw.integers(0, kinds, int(n)).astype(np.uint64) for n in draw.integers(0, 60, 4)]
        seen = []
        for left, right in ((sides[0], sides[1]), (sides[2], sides[3])):
            words = sub.mix(np.concatenate([left, middle, right]) + np.uint64(5))
            names, _, low, high = sub.recompress(words, np.zeros(len(words), np.int64), scheme)
            at = len(left)
            seen.append({int(n) for n, a, b in zip(names, low, high) if a <= at <= b})
        assert seen[0] & seen[1]


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, (n, m, k) in brute(docs).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sub.op7_substring_dedup(spark, SMOKE).collect()} == want


def test_edges(spark, docs_of):
    long = " ".join(str(i) for i in range(60))
    docs = docs_of([None, "", "one two", long, long, long + " tail", (None, long), (4, long), (4, "another text " + long)])
    got = [(r.doc_id, r.n_removed, r.kept) for r in sub.without_repeats(docs).collect()]
    assert sorted(x for x in got if x[0] is not None and x[0] < 4) == [(0, 0, ""), (1, 0, ""), (2, 0, "one two"), (3, 0, long)]
    assert sorted(x[1:] for x in got if x[0] == 4) == [(60, ""), (60, ""), (60, "another text")]
    assert [x[1:] for x in got if x[0] == 5] == [(60, "tail")]
    assert [x[1:] for x in got if x[0] is None] == [(0, long)]
    assert sub.without_repeats(docs.limit(0)).count() == 0
    stage = {r.doc_id: r for r in sub.stage(spark, docs_of(["a\nb", long, long + "\nx"], extra=False), SMOKE).collect()}
    assert (stage[0].text, stage[2].text, stage[2].n_chars) == ("a\nb", "x", 1)


def test_very_long_text(docs_of):
    text = " ".join(str(i) for i in range(300_000))
    assert found(docs_of([text, "x " + text[:100_000]]))[1][1] > 10_000


@pytest.mark.parametrize("gap,words", [(" ", 1), ("", 60)])
def test_regular_texts_are_not_taken_for_copies(docs_of, gap, words):
    """Letters in Thue-Morse order and their complement, as words and as long words, which no polynomial modulo 2**64 tells apart."""
    order = [bin(i).count("1") % 2 for i in range(4096)]
    texts = dict(enumerate(" ".join([gap.join("ab"[x ^ side] for x in order)] * words) for side in (0, 1)))
    assert found(docs_of(list(texts.items()))) == brute(texts)
