import hashlib
import random
import re


from fluxweave.llm import spotsigs as ss
from tests.conftest import SMOKE

COMMON = set(ss.COMMON.split())


def brute_signatures(text):
    words = [w for w in re.sub(r"[\x00-/:-@\[-`{-\x7f]+", " ", (text or "").lower()).split(" ") if w]
    found = set()
    for i, w in enumerate(words[:-1]):
        if w in COMMON and words[i + 1] not in COMMON:
            chain = [x for x in words[i + 1 :] if x not in COMMON][: ss.CHAIN]
            if len(chain) == ss.CHAIN:
                found.add(" ".join([w, *chain]))
    return found or ({" " + " ".join(words) + " "} if words else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def brute_rows(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    out = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        sets = [brute_signatures(x) for x in (t, edited, after)]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(sets[0], sets[1]), jaccard(sets[0], sets[2]))
    return out


def result(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    got, want = result(ss.op1_spotsigs(spark, SMOKE)), brute_rows(docs)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:2] == want[i][:2] and all(abs(a - b) < 1e-9 for a, b in zip(got[i][2:], want[i][2:])), i


def test_sparse_and_many_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(ss, "ROWS_PER_CHUNK", 2)
    draw = random.Random(1)
    docs = [(draw.choice((i, i * 1000, 10**12 + i)), f"the text {i} of a document {i * i}") for i in range(80)]
    docs = list(dict(docs).items()) + [(-5, "x"), (None, "null id the last one")]
    got, want = result(ss.fingerprints(docs_of(docs))), brute_rows(docs)
    assert {i: v[:2] for i, v in got.items()} == {i: v[:2] for i, v in want.items()}


def test_edges(docs_of):
    texts = [None, "", " . ", "the", "the of and", "single", "The cat sat on the mat", "the " + "word " * 100_000, "é😀" * 9]
    docs = list(enumerate(texts))
    got, want = result(ss.fingerprints(docs_of(docs))), brute_rows(docs)
    assert {i: v[:2] for i, v in got.items()} == {i: v[:2] for i, v in want.items()}
    one = result(ss.fingerprints(docs_of([(4, "the only one here")])))
    assert one[4][3] == 1.0
    assert ss.fingerprints(docs_of(["x"]).limit(0)).count() == 0
    same = ss.fingerprints(docs_of(["The big dog of all", "The big dog of all", (1, "The big dog of all")])).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 1


def test_near_pairs_equal_brute_force(docs_of):
    draw = random.Random(8)
    base = [[draw.choice(("the", "of", "a")) + f" c{draw.randrange(300)} d{draw.randrange(300)}" for _ in range(40)] for _ in range(6)]
    texts = []
    for i in range(60):
        spots = base[i % 6][:]
        for _ in range(draw.randint(0, 8)):
            spots[draw.randrange(40)] = f"the new{draw.random()} one{i}"
        texts.append(" ".join(spots))
    sets = [brute_signatures(t) for t in texts]
    want = {(a, b) for b in range(60) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8 and sets[a] != sets[b]}
    reps = {}
    for i, s in enumerate(sets):
        reps.setdefault(frozenset(s), i)
    want = {(a, b) for a, b in want if reps[frozenset(sets[a])] == a and reps[frozenset(sets[b])] == b}
    assert {(r.a, r.b) for r in ss.near_pairs(docs_of(texts)).collect()} == want


def test_native(spark):
    plan = ss.op1_spotsigs(spark, SMOKE)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_members_have_every_copy(docs_of):
    text, other = "the quick brown fox is a fast animal of the dark woods", "an old house by the long road to big towns"
    docs = docs_of([(5, text), (3, text), (9, text.upper()), (4, other), (8, ""), (None, text), (3, text)])
    got = sorted(tuple(r) for r in ss.members(docs).collect())
    assert got == [(3, 3), (4, 4), (5, 3), (9, 3)]
    assert ss.near_pairs(docs).count() == 0
