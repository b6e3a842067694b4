"""Byte-level BPE encoding and decoding by merge replay over a block of texts.

A block of texts is one small corpus: its distinct pre-tokens are laid out as
one sequence of byte symbols, an inverted index keeps, for every pair of
neighbours that the rank table knows, the positions where it stands, and the
merges are applied in rank order, each touching only the neighbours of the
positions it joins. Ids of a pre-token do not depend on the others, so blocks
need no exchange and every text is encoded where it is read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxweave.llm.tables import schema_with, table, with_place
from fluxweave.llm.words import give_back

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
KEPT_WORDS = 400_000  # pre-tokens whose ids a task keeps for its next block; only a matter of speed
KEPT_BETWEEN = 100_000  # of these a worker keeps so many for its next task, since idle workers share an executor's memory
BLOCK_CHARS = 8_000_000
SHIFT, END, GONE = 32, -1, -2


def parse_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Rank file lines, ``base64(token) rank``, as a table."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Merges:
    """The rank table, seen as a table of pairs: which two tokens join, and into which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: piece for piece, rank in ranks.items()}
        self.byte = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        self.ints = list(range(max(ranks.values()) + 1))  # one object for each id, shared by all words
        self.joined = {
            ranks[piece[:cut]] << SHIFT | ranks[piece[cut:]]: rank
            for piece, rank in ranks.items()
            for cut in range(1, len(piece))
            if piece[:cut] in ranks and piece[cut:] in ranks
        }
        self.pairs = np.array(sorted(self.joined), np.int64)
        self.into = np.array([self.joined[int(k)] for k in self.pairs], np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, or -1 (also where either part is not a token)."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int64)
        key = left.astype(np.int64) << SHIFT | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == key), self.into[at], -1)


def encode_word(word: bytes, merges: Merges) -> list[int]:
    """Ids of one word: again and again its lowest pair, the leftmost of equals."""
    piece = merges.byte[np.frombuffer(word, np.uint8)].tolist()
    while len(piece) > 1:
        ranks = [merges.joined.get(a << SHIFT | b) for a, b in zip(piece, piece[1:])]
        known = [r for r in ranks if r is not None]
        if not known:
            break
        at = ranks.index(min(known))
        piece[at : at + 2] = [ranks[at]]
    return piece


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """Ids of every word. All words are merged together, lowest rank first, leftmost first inside a word.

    The index maps a rank to the positions of its pairs; a merge joins all of
    them at once and looks up only the pairs at their two neighbours. Every
    single byte must have a rank. Where a merge makes a pair of lower rank than
    its own, order inside the word matters: such words are encoded one by one.
    """
    if not words:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    piece = np.full(int(lengths.sum()) + len(words), END, np.int32)
    ends = np.cumsum(lengths + 1) - 1
    inner = np.ones(len(piece), bool)
    inner[ends] = False  # no pair reaches over the end of a word
    piece[inner] = merges.byte[np.frombuffer(b"".join(words), np.uint8)]
    after = np.arange(1, len(piece) + 1, dtype=np.int32)
    before = np.arange(-1, len(piece) - 1, dtype=np.int32)
    before[0] = len(piece) - 1  # the end of the last word: never a token
    odd: list[np.ndarray] = []

    index: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    order: list[int] = []

    def add(places: np.ndarray, left: np.ndarray, right: np.ndarray, now: int) -> None:
        rank = merges.find(left, right)
        hit = np.flatnonzero(rank >= 0)
        if not len(hit):
            return
        hit = hit[np.argsort(rank[hit], kind="stable")]
        rank, places, left, right = rank[hit], places[hit], left[hit], right[hit]
        if rank[0] < now:
            odd.append(places[rank < now])
        cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
        for a, b in zip(cuts, cuts[1:]):
            kind = int(rank[a])
            if kind not in index:
                index[kind] = []
                heapq.heappush(order, kind)
            index[kind].append((places[a:b], left[a:b], right[a:b]))

    first = np.flatnonzero(inner[:-1] & inner[1:]).astype(np.int32)
    add(first, piece[first], piece[first + 1], -1)
    while order:
        rank = heapq.heappop(order)
        found = index.pop(rank)
        places, left, right = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found))
        following = after[places]
        still = (piece[places] == left) & (piece[following] == right)
        places = np.unique(places[still])
        if not len(places):
            continue
        following = after[places]
        chained = np.flatnonzero(following[:-1] == places[1:]) + 1
        if len(chained):  # overlapping pairs, as in "aaa": every other one of a chain, from the left
            link = np.zeros(len(places), bool)
            link[chained] = True
            at = np.arange(len(places))
            from_head = at - np.maximum.accumulate(np.where(link, 0, at))
            keep = from_head % 2 == 0
            places, following = places[keep], following[keep]
        beyond, prior = after[following], before[places]
        piece[places], piece[following] = rank, GONE
        after[places], before[beyond] = beyond, places
        same = np.full(len(places), rank, np.int32)
        add(places, same, piece[beyond], rank)
        add(prior, piece[prior], same, rank)
    kept = piece >= 0
    upto = np.cumsum(kept)[ends]
    flat = list(map(merges.ints.__getitem__, piece[kept].tolist()))
    out = [flat[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]
    for word in np.unique(np.searchsorted(ends, np.concatenate(odd))).tolist() if odd else ():
        out[word] = encode_word(words[word], merges)
    return out


@functools.cache
def default_merges(name: str = VOCABULARY) -> tuple[Merges, str]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        return Merges(parse_ranks(lines)), public_tokenizers.PATTERN


def decode(ids: Iterable[int], token: dict[int, bytes]) -> bytes:
    return b"".join(token[i] for i in ids)


class _Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class BlockEncoder:
    """Encodes texts block by block, keeping the ids of words seen lately."""

    def __init__(self, merges: Merges, pattern: str, kept_words: int = KEPT_WORDS):
        self.merges, self.pieces, self.kept_words = merges, regex.compile(pattern), kept_words
        self.kept: dict[str, tuple[int, ...]] = {}

    def block(self, texts: list[str]) -> tuple[list[np.ndarray], list[tuple[int, ...]]]:
        """Numbers of every text's pre-tokens, and the ids of each number."""
        number = _Numbers()
        cut = [np.fromiter(map(number.__getitem__, self.pieces.findall(text)), np.int32) for text in texts]
        kept = self.kept
        fresh = [w for w in number if w not in kept]
        if len(kept) + len(fresh) > self.kept_words:  # what this block has again stays, the rest makes room
            kept = self.kept = {w: kept[w] for w in number if w in kept}
        kept.update(zip(fresh, map(tuple, replay([w.encode() for w in fresh], self.merges))))
        return cut, [kept[w] for w in number]

    def rest(self) -> None:
        """At the end of a task: keep the words that came first, which are the common ones."""
        self.kept = dict(islice(self.kept.items(), KEPT_BETWEEN))
        give_back()


@functools.cache
def default_encoder() -> BlockEncoder:
    """One per worker, so that what one task has encoded helps the next."""
    return BlockEncoder(*default_merges())


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", ranks: dict[bytes, int] | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with an array column ``ids``; null text counts as empty and gives an empty array.

    A column that is already called ``ids`` is replaced. Without ``ranks`` and
    ``pattern`` the public multilingual table is used, read on each worker.
    Whole texts are encoded: one text is the least a task holds. Pieces of text
    outside the pattern's matches get no ids, as in the library it follows.
    """
    rest = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BlockEncoder(Merges(ranks), pattern) if ranks is not None else default_encoder()
        for batch, texts in _text_groups(batches, text):
            cut, of = coder.block(texts)
            words, ends = np.concatenate(cut), np.cumsum([len(c) for c in cut])
            size = np.fromiter(map(len, of), np.int64, len(of))
            begin = np.cumsum(size) - size
            flat = np.fromiter(chain.from_iterable(of), np.int32, int(size.sum()))
            length = size[words]
            upto = np.concatenate([[0], np.cumsum(length)])
            place = np.arange(upto[-1]) - np.repeat(upto[:-1] - begin[words], length)
            found = pa.ListArray.from_arrays(pa.array(upto[np.concatenate([[0], ends])].astype(np.int32)), pa.array(flat[place]))
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, found], [*rest, ids])
        coder.rest()

    plain = docs.select(*rest)
    schema = schema_with(plain, **{ids: T.ArrayType(T.IntegerType())})
    return plain.mapInArrow(run, schema)


def with_decoded(encoded: DataFrame, ids: str = "ids", name: str = "decoded", ranks: dict[bytes, int] | None = None) -> DataFrame:
    """``encoded`` with a binary column of the bytes that the ids stand for; null ids give no bytes. Ids outside the table are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = (Merges(ranks) if ranks is not None else default_merges()[0]).token
        for batch in batches:
            back = [decode(x or (), token) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(back, pa.binary())], [*rest, name])

    rest = [c for c in encoded.columns if c != name]
    plain = encoded.select(*rest)
    return plain.mapInArrow(run, schema_with(plain, **{name: "binary"}))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: number of ids, digest of the ids joined by commas, digest of the bytes decoded from them.

    Encodes as ``encode`` does but joins the digits and bytes of a whole
    pre-token at once, so that the ids never leave the worker.
    """
    schema = schema_with(docs.select(key), n_tokens="long", ids_sha256="string", decoded_sha256="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = default_encoder()
        for batch, texts in _text_groups(batches, text):
            cut, of = coder.block(texts)
            words, ends = np.concatenate(cut), np.cumsum([len(c) for c in cut])
            digits = [",".join(map(str, ids)) for ids in of]
            back = [decode(ids, coder.merges.token) for ids in of]
            count = np.concatenate([[0], np.cumsum(np.fromiter(map(len, of), np.int64, len(of))[words])])
            cut = [c.tolist() for c in cut]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(np.diff(count[np.concatenate([[0], ends])])),
                    pa.array([hashlib.sha256(",".join([digits[w] for w in mine]).encode()).hexdigest() for mine in cut], pa.string()),
                    pa.array([hashlib.sha256(b"".join([back[w] for w in mine])).hexdigest() for mine in cut], pa.string()),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        coder.rest()

    return docs.select(key, text).mapInArrow(run, schema)


def _text_groups(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with at most BLOCK_CHARS of text, or one row."""
    for batch in batches:
        texts = [x or "" for x in batch.column(text).to_pylist()]
        row = 0
        while row < len(texts):
            stop, held = row + 1, len(texts[row])
            while stop < len(texts) and held + len(texts[stop]) <= BLOCK_CHARS:
                held += len(texts[stop])
                stop += 1
            yield batch.slice(row, stop - row), texts[row:stop]
            row = stop
        give_back()


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: every document with its ids, their number, and ``mix_position``, the order of the stage before (see ``with_place``)."""
    return encode(with_place(docs, "mix_position")).withColumn("n_tokens", F.size("ids").cast("long"))
