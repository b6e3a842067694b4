import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxweave.llm import bpe
from tests.conftest import SMOKE

MERGES, PATTERN = bpe.default_merges()
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=MERGES.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library(text):
    cut, of = bpe.BlockEncoder(MERGES, PATTERN).block([text])
    assert [i for w in cut[0] for i in of[w]] == LIBRARY.encode_ordinary(text)


def test_replay_equals_word_by_word():
    draw = random.Random(3)
    words = ["".join(draw.choice("aaabcé ñ字😀#*") for _ in range(draw.randint(0, 40))).encode() for _ in range(500)]
    assert bpe.replay(words, MERGES) == [bpe.encode_word(w, MERGES) for w in words]


def test_lower_pair_after_a_merge():
    ranks = {bytes((b,)): b for b in range(256)} | {b"bc": 300, b"abc": 301, b"ab": 302, b"cd": 303, b"abcd": 260}
    merges = bpe.Merges(ranks)
    words = [b"abcd", b"abcdabcd", b"aabb", b"cdab", b"abc"]
    assert bpe.replay(words, merges) == [bpe.encode_word(w, merges) for w in words]


def test_small_cache_gives_the_same():
    coder = bpe.BlockEncoder(MERGES, PATTERN, kept_words=3)
    for text in ("one two three four five", "two three six", ""):
        cut, of = coder.block([text])
        assert [i for w in cut[0] for i in of[w]] == LIBRARY.encode_ordinary(text)


def test_query_equals_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    for r in bpe.op2_byte_bpe(spark, SMOKE).collect():
        ids = LIBRARY.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_edges(spark, docs_of):
    texts = [None, "", " ", "a" * 200_000, "x\r\n\ty", "same", "same"]
    docs = docs_of(texts).withColumnRenamed("score", "ids")
    found = {r.doc_id: r for r in bpe.with_decoded(bpe.encode(docs)).collect()}
    assert [bytes(found[i].decoded).decode() for i in range(len(texts))] == [t or "" for t in texts]
    assert found[0].ids == [] and found[5].ids == found[6].ids and found[0].n_words == 7
    assert bpe.digests(docs.limit(0)).count() == 0
    stage = bpe.stage(spark, docs, SMOKE).collect()
    assert len(stage) == len(texts) and all(r.n_tokens == len(r.ids) for r in stage)


def test_unknown_id_is_an_error():
    with pytest.raises(KeyError):
        bpe.decode([10**6], MERGES.token)
