"""Removal of long repeats between documents, found by recompression.

Every document is a sequence of word symbols. Rounds name runs and pairs of
neighbouring symbols; a name depends only on its content, so all tasks give
equal substrings equal names without meeting. Whether two symbols pair depends
on these two alone, so a round disturbs at most one symbol at each end of a
repeat, and all symbols inside it are the same wherever the repeat stands.

How much survives. A window of W words loses on each side fewer than RUN words
to a run that the outside prolongs and at most 2**r words to round r. What is
left holds whole symbols of at most 2**ROUNDS words each, or a run of RUN
words or more, which has a name of its own that its length does not change.
A high-level symbol is made of the symbols in a row that cover ``unit`` words,
and of those that begin in any ``span`` words the one with the least name is
put forward; both numbers are chosen so that a window always holds one that is
put forward wherever it stands.

High-level symbols that stand in two documents reveal candidate windows. Only
those are compared, by 128-bit digests of their words, which verifies them.
Documents with the very words of a smaller doc_id are repeats from end to end;
they are told by the digest of all their words and take no part in the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm.tables import schema_with, stored, table
from fluxweave.llm.words import digest_halves, joined_words, mix, span_hash, text_blocks, word_names, word_spans

WINDOW = 50
WHOLE = -1
BROADCAST_KEYS = 1_000_000  # 8 or 16 MB; beyond it the same join is left to Spark
_U = np.uint64
_SECOND = _U(0xD6E8FEB86659FD93)
_RUN = _U(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Scheme:
    """Numbers of the recompression for windows of ``window`` words (19 or more)."""

    window: int = WINDOW
    rounds: int = 2
    run: int = 4

    @property
    def core(self) -> int:
        """Words of a window that are left in whole symbols."""
        return self.window - 2 * (self.run - 1 + 2**self.rounds - 1)

    @property
    def unit(self) -> int:
        return max(1, (self.core - 2**self.rounds) // 2)

    @property
    def span(self) -> int:
        return self.core - self.unit - 2**self.rounds + 2

    def __post_init__(self):
        if self.span < 2**self.rounds:
            raise ValueError("the window is too short for these rounds")


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over values[i : i + width], as far as there are values."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        pick(out[:-step], out[step:].copy(), out=out[:-step])
        have += step
    return out


def recompress(words: np.ndarray, doc: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names put forward, the document of each, and the first and last start of a window that holds it.

    ``words`` are word hashes of several documents in a row, ``doc`` their
    document. Starts count in ``words`` and may lie outside the document.
    """
    n = len(words)
    if not n:
        return words, doc, np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs = doc
    symbol, first, last = words, np.arange(n), np.arange(1, n + 1)
    fresh = np.ones(n, bool)
    fresh[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(fresh)
    length = np.diff(np.append(head, n))
    long = length >= scheme.run
    run_names, run_first, run_last = mix(symbol[head[long]] ^ _RUN), head[long], head[long] + length[long]
    if long.any():
        inside = np.repeat(long, length) & ~fresh
        last = last.copy()
        last[head[long]] = run_last
        symbol = symbol.copy()
        symbol[head[long]] = mix(run_names + length[long].astype(np.uint64))
        symbol, first, last, doc = symbol[~inside], first[~inside], last[~inside], doc[~inside]
    for turn in range(scheme.rounds):
        side = mix(symbol + _U(2 * turn + 1) ^ _SECOND) >> _U(63)
        pair = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1) & (doc[:-1] == doc[1:]))
        symbol, last = symbol.copy(), last.copy()
        symbol[pair] = mix(mix(symbol[pair]) * _SECOND + symbol[pair + 1])
        last[pair] = last[pair + 1]
        keep = np.ones(len(symbol), bool)
        keep[pair + 1] = False
        symbol, first, last, doc = symbol[keep], first[keep], last[keep], doc[keep]
    runs = run_names, docs[run_first], run_first + scheme.run - scheme.window, run_last - scheme.run
    upto = np.searchsorted(last, first + scheme.unit)
    whole = np.flatnonzero(upto < len(last))
    whole = whole[doc[upto[whole]] == doc[whole]]
    names = span_hash(symbol, whole, upto[whole] + 1)
    at_word = np.full(n, ~_U(0))
    at_word[first[whole]] = names
    least = _sliding(at_word, scheme.span, np.minimum)
    least[: n - scheme.span + 1][docs[: n - scheme.span + 1] != docs[scheme.span - 1 :]] = 0
    least[max(n - scheme.span + 1, 0) :] = 0  # no span there lies inside one document
    chosen = _sliding(np.concatenate([np.zeros(scheme.span - 1, np.uint64), least]), scheme.span, np.maximum)[:n]
    pick = chosen[first[whole]] == names
    at = whole[pick]
    found = names[pick], doc[at], last[upto[at]] - scheme.window, first[at]
    return tuple(np.concatenate(x) for x in zip(runs, found))


class _Block:
    """Words of the texts of a block that have a whole window."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        starts, ends, first = word_spans(data, offsets)
        self.count = np.diff(first)
        row = np.repeat(np.arange(len(self.count)), self.count)
        keep = (self.count >= window)[row]
        self.row = row[keep]
        self.starts, self.ends = starts[keep], ends[keep]
        self.data = data
        held = np.where(self.count >= window, self.count, 0)
        self.base = np.cumsum(held) - held  # where a text's words begin among those kept

    @property
    def hashes(self) -> np.ndarray:
        return word_names(self.data, self.starts, self.ends)

    def windows(self, begin: np.ndarray, size: int) -> Iterator[bytes]:
        """The ``size`` words from each of these on, joined by one space."""
        ends = np.cumsum(self.ends - self.starts + 1)
        starts = ends - (self.ends - self.starts + 1)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(starts - self.starts, ends - starts)
        inside = np.append(self.data, np.uint8(0x20))[place]
        inside[ends - 1] = 0x20
        flat = inside.tobytes()
        for a, b in zip(starts[begin].tolist(), (ends[begin + size - 1] - 1).tolist()):
            yield flat[a:b]


def high_symbols(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(name, doc_id, low, high): a high-level symbol and the first and last start of the windows that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches):
            block = _Block(data, offsets, scheme.window)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            names, row, low, high = recompress(block.hashes, block.row, scheme)
            low = np.maximum(low - block.base[row], 0)
            high = np.minimum(high - block.base[row], block.count[row] - scheme.window)
            ok = low <= high
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[ok].view(np.int64)),
                    pa.array(ids[row[ok]].astype(np.int64)),
                    pa.array(low[ok].astype(np.int32)),
                    pa.array(high[ok].astype(np.int32)),
                ],
                ["name", "doc_id", "low", "high"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "name long, doc_id long, low int, high int")


def _seen_twice(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys stand in two documents, with the smallest of them as ``least``.

    The keys are counted map-side and joined back, so that a key which a large
    part of the documents share is split by the skew join, never gathered.
    """
    ends = rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("__most"))
    return rows.join(ends.filter("least < __most").drop("__most"), keys)


def _merged(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Every start that lies in one of the intervals, once, in order."""
    top = int(high.max()) + 2
    edge = np.zeros(top, np.int32)
    np.add.at(edge, low, 1)
    np.add.at(edge, high + 1, -1)
    return np.flatnonzero(np.cumsum(edge) > 0)


def window_hashes(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(h1, h2, doc_id, text_key, start) for the starts in the column ``around`` (structs of low and high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches):
            block = _Block(data, offsets, scheme.window)
            around = batch.column("around")
            lists, inner = np.asarray(around.offsets), around.values
            low, high = (inner.field(x).to_numpy() for x in ("low", "high"))
            ids, keys = (batch.column(x).to_numpy() for x in ("doc_id", "text_key"))
            at, row = [], []
            for r in range(batch.num_rows):
                a, b = lists[r], lists[r + 1]
                top = block.count[r] - scheme.window
                fits = low[a:b] <= top  # the intervals may be those of another text with this id
                if top >= 0 and fits.any():
                    starts = _merged(low[a:b][fits], np.minimum(high[a:b][fits], top))
                    at.append(starts)
                    row.append(np.full(len(starts), r))
            if not at:
                continue
            at, row = np.concatenate(at), np.concatenate(row)
            begin = block.base[row] + at
            halves = digest_halves(block.windows(begin, scheme.window))
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids[row]), pa.array(keys[row]), pa.array(at.astype(np.int32))],
                ["h1", "h2", "doc_id", "text_key", "start"],
            )

    return docs.select("doc_id", "text_key", "text", "around").mapInArrow(run, "h1 long, h2 long, doc_id long, text_key long, start int")


def _matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose key is (is not) in ``keys``. The keys are broadcast only if counted to be few."""
    small = keys.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if small else keys, keys.columns, how)


def copies(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key) of the texts of a whole window or more whose words are all those of a smaller doc_id's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches):
            _, _, first = word_spans(data, offsets)
            halves = digest_halves(joined_words(data, offsets))
            long = pa.array(np.diff(first) >= window)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "text_key", "h1", "h2"])
            yield out.filter(long)

    rows = docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, h1 long, h2 long")
    return _seen_twice(rows, ["h1", "h2"]).filter("doc_id > least").select("doc_id", "text_key").distinct()


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, starts): starts of the windows that also start in a document with a smaller doc_id.

    Documents without such a window are absent; one whose words are all those
    of a smaller doc_id has the single start -1. ``text_key`` tells apart texts
    under one doc_id; a null doc_id is neither smaller nor larger than another.
    """
    scheme = Scheme(window)
    light = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    same = stored(copies(light, window), "repeat-copies")
    light = _matching(light, same, "left_anti")
    shared = _seen_twice(high_symbols(light, scheme), ["name"])
    around = stored(
        shared.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("around")), "repeat-candidates"
    )
    chosen = _matching(light, around.select("doc_id"), "left_semi").join(around, "doc_id")
    again = _seen_twice(window_hashes(chosen, scheme), ["h1", "h2"]).filter("doc_id > least")
    starts = again.groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))
    return stored(starts.unionByName(same.withColumn("starts", F.array(F.lit(WHOLE)))), "repeat-starts")


def _kept_words(text: bytes, starts: list[int] | None, window: int) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by one space."""
    words = text.split()  # splits at the same six bytes as the word pattern
    if not starts:
        return len(words), 0, b" ".join(words)
    if starts == [WHOLE]:
        return len(words), len(words), b""
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, np.asarray(starts), 1)
    np.add.at(edge, np.asarray(starts) + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone) if not g])


def without_repeats(docs: DataFrame, window: int = WINDOW, digest_only: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the words that no earlier repeat covers, joined by one space.

    A word goes if a window of ``window`` words around it also starts in a
    document with a smaller doc_id; windows are judged on the input. Words are
    maximal runs of bytes other than the six ASCII spaces; null text counts as
    empty and gives an empty ``kept``. Repeats inside one document stay, and so
    do rows with a null doc_id and equal rows under one doc_id. Columns of
    these three names are replaced. With ``digest_only`` the result has
    doc_id, n_words, n_removed and kept_sha256 alone.
    """
    found = repeats(docs, window)
    ids = found.select("doc_id").distinct()
    named = ["n_words", "n_removed", "kept_sha256" if digest_only else "kept"]
    rest = ["doc_id"] if digest_only else [c for c in docs.columns if c not in named]
    full = docs.select(*dict.fromkeys([*rest, "text"]))
    hit = _matching(full.withColumn("__key", F.xxhash64("text")), ids, "left_semi").join(
        found.withColumnRenamed("text_key", "__key"), ["doc_id", "__key"], "left"
    )
    clear = _matching(full, ids, "left_anti").withColumn("starts", F.lit(None).cast("array<int>"))
    schema = schema_with(full.select(*rest), **dict(zip(named, ("long", "long", "string"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches):  # a few texts at a time: their words are Python objects
            spans = zip(offsets[:-1].tolist(), offsets[1:].tolist())
            rows = [_kept_words(data[a:b].tobytes(), s, window) for (a, b), s in zip(spans, batch.column("starts").to_pylist())]
            texts = [hashlib.sha256(r[2]).hexdigest() if digest_only else r[2].decode() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(texts, pa.string())],
                [*rest, *named],
            )

    both = hit.select(*full.columns, "starts").unionByName(clear)
    return both.mapInArrow(run, schema)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digest_only=True)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with long repeats cut out; a text that loses nothing stays as it is."""
    cut = without_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


OP7_SQL = rf"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place, len(words) AS n FROM split
), shown AS (
  SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS shown FROM each
), named AS (
  SELECT doc_id, word, place, CASE WHEN place + {WINDOW} <= n THEN md5(shown) END AS name FROM shown
), told AS (
  SELECT *, name IS NOT NULL AND min(doc_id) OVER (PARTITION BY name) < doc_id AS again FROM named
), gone AS (
  SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM told
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept FROM gone GROUP BY doc_id
)
SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept USING (doc_id)
"""
