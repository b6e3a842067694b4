"""Benchmark passages in training documents: a broadcast set of hashed n-grams, exact verification, removal.

The benchmark is cut into windows of ``n`` normalised words. Their 64-bit hashes, sorted, go to every task with the
normalised benchmark text; a task hashes all windows of its documents, looks them up, and compares the words of every
hit with those of the window, so that a hash decides nothing. A broadcast holds at most PART_BYTES of benchmark text,
which is checked; a larger benchmark is cut into parts and the documents pass them one after the other, with their
hits so far written in between. Documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.llm.tables import schema_with, stored, table
from fluxweave.llm.words import BLOCK_BYTES, BYTE_VALUE, span_hash, text_pieces, word_spans

WINDOW = 10
PART_BYTES = 8_000_000
PIECE_WORDS = 4096  # a long item is cut into pieces of so many windows
WORD_REGEX = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTER_BITS = 22

GAP = np.ones(256, bool)  # bytes that are no part of a word
GAP[0x30:0x3A] = GAP[0x61:0x7B] = GAP[0x80:] = False
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 0x20
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def benchmark_pieces(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """(item string, words string): normalised texts joined by one space, long ones in pieces that share n - 1 words."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD_REGEX), F.lit(0))
    found = benchmark.select(F.col(item).cast("string").alias("item"), words.alias("__words")).filter(F.size("__words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("__words") - n, F.lit(0)), F.lit(PIECE_WORDS))
    cut = found.select("item", F.explode(F.transform(starts, lambda s: F.slice("__words", s + 1, PIECE_WORDS + n - 1))).alias("__cut"))
    return cut.select("item", F.array_join("__cut", " ").alias("words"))


class Windows:
    """The windows of some pieces: distinct word sequences, each with the items that hold it."""

    def __init__(self, pieces: list[tuple[str | None, str]], n: int):
        names = sorted({i for i, _ in pieces if i is not None})
        number = {name: k for k, name in enumerate(names)}
        self.names = names
        raw = [w.encode() for _, w in pieces]
        self.data = b"".join(raw)
        buffer = np.frombuffer(self.data, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
        starts, ends, first = word_spans(buffer, offsets, GAP)
        sizes = np.diff(first)
        length = np.minimum(sizes, n)
        windows = np.where(sizes > 0, sizes - length + 1, 0)
        row = np.repeat(np.arange(len(raw)), windows)
        begin = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + first[:-1][row]
        end = begin + length[row]
        hashed = span_hash(span_hash(BYTE_VALUE[buffer], starts, ends), begin, end, _WORD_BASE)
        item = np.array([number.get(i, -1) for i, _ in pieces], np.int64)[row]
        order = np.lexsort((item, hashed))
        hashed, item, lengths = hashed[order], item[order], length[row][order]
        left, right = starts[begin[order]], ends[end[order] - 1]
        # same hash and same words: one window; words that differ under one hash stay apart
        new = np.ones(len(order), bool)
        new[1:] = hashed[1:] != hashed[:-1]
        group = np.cumsum(new) - 1
        again = np.flatnonzero(~new)
        heads = np.flatnonzero(new)
        strangers = [k for k in again.tolist() if self.data[left[k] : right[k]] != self.data[left[heads[group[k]]] : right[heads[group[k]]]]]
        if strangers:
            seen: dict[tuple[int, bytes], int] = {}
            ids = [seen.setdefault((int(h), self.data[a:b]), len(seen)) for h, a, b in zip(hashed, left, right)]
            order = np.argsort(ids, kind="stable")
            hashed, item, lengths, left, right = hashed[order], item[order], lengths[order], left[order], right[order]
            group = np.asarray(ids)[order]
            heads = np.flatnonzero(np.diff(group, prepend=-1))
        self.hashes, self.left, self.right, self.lengths = hashed[heads], left[heads], right[heads], lengths[heads]
        named = item >= 0
        pairs = np.unique(np.stack([group[named], item[named]], axis=1), axis=0) if named.any() else np.zeros((0, 2), np.int64)
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(heads) + 1))
        self.items = pairs[:, 1]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.sizes = np.unique(self.lengths).tolist()

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and window of every occurrence in the texts whose words begin at ``first``."""
        at, size, window = [], [], []
        values = span_hash(BYTE_VALUE[data], starts, ends)
        text_end = np.repeat(first[1:], np.diff(first))
        for n in self.sizes:
            begin = np.flatnonzero(np.arange(len(starts)) + n <= text_end)
            hashed = span_hash(values, begin, begin + n, _WORD_BASE)
            maybe = np.flatnonzero(self.filter[(hashed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            lo = np.searchsorted(self.hashes, hashed[maybe], side="left")
            hi = np.searchsorted(self.hashes, hashed[maybe], side="right")
            for k in np.flatnonzero(hi > lo).tolist():
                word = int(begin[maybe[k]])
                mine = self._joined(data, starts[word : word + n], ends[word : word + n])
                for w in range(int(lo[k]), int(hi[k])):
                    if self.lengths[w] == n and self.data[self.left[w] : self.right[w]] == mine:
                        at.append(word)
                        size.append(n)
                        window.append(w)
        return np.array(at, np.int64), np.array(size, np.int64), np.array(window, np.int64)

    @staticmethod
    def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
        return b" ".join(data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist()))

    def items_of(self, windows: np.ndarray) -> list[str]:
        found = [self.items[self.item_at[w] : self.item_at[w + 1]] for w in np.unique(windows).tolist()]
        return [self.names[i] for i in np.unique(np.concatenate(found)).tolist()] if found else []


HIT = [("first_word", pa.int64()), ("last_word", pa.int64()), ("first_byte", pa.int64()), ("last_byte", pa.int64())]
HIT_COLUMNS = {"n_words": "long", "hits": "array<struct<" + ",".join(f"{name}:long" for name, _ in HIT) + ">>", "items": "array<string>"}
HIT_TYPES = [pa.int64(), pa.list_(pa.struct(HIT)), pa.list_(pa.string())]


def merged(hits: list[tuple[int, int, int, int]]) -> list[dict[str, int]]:
    """Hits as stretches that neither overlap nor touch."""
    out: list[dict[str, int]] = []
    for first, last, left, right in sorted(hits):
        if out and first <= out[-1]["last_word"] + 1:
            if last > out[-1]["last_word"]:
                out[-1].update(last_word=last, last_byte=right)
        else:
            out.append({"first_word": first, "last_word": last, "first_byte": left, "last_byte": right})
    return out


def _with_part(docs: DataFrame, windows: Windows, text: str, n: int, block_bytes: int) -> DataFrame:
    """``docs`` with the hits of one part added to those of earlier parts, if there are any."""
    held = docs.sparkSession.sparkContext.broadcast(windows)
    own = [c for c in docs.columns if c not in HIT_COLUMNS]
    schema = schema_with(docs.select(*own), **HIT_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = held.value
        for batch, data, offsets, base, owned, whole in text_pieces(batches, text, GAP, n - 1, LOWERED, block_bytes):
            starts, ends, first = word_spans(data, offsets, GAP)
            if base == 0:
                count = np.zeros(batch.num_rows, np.int64)
                found: dict[int, list[tuple[int, int, int, int]]] = {}
                windows_of: dict[int, list[int]] = {}
            at, size, window = part.hits(data, starts, ends, first)
            inside = int(np.searchsorted(starts, owned))
            row = np.searchsorted(first, at, side="right") - 1
            for k in np.flatnonzero(at < inside).tolist():
                i, a, b = int(row[k]), int(at[k]), int(at[k] + size[k]) - 1
                shift, place = int(count[i]) - int(first[i]), base - int(offsets[i])
                found.setdefault(i, []).append((a + shift, b + shift, int(starts[a]) + place, int(ends[b]) + place))
                windows_of.setdefault(i, []).append(int(window[k]))
            count += np.diff(np.minimum(first, inside))
            if whole:
                hits, items = [[]] * batch.num_rows, [[]] * batch.num_rows
                if "hits" in batch.schema.names:  # of earlier parts
                    hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                for i, mine in found.items():
                    hits[i] = merged(mine + [tuple(h.values()) for h in hits[i]])
                    items[i] = sorted({*items[i], *part.items_of(np.array(windows_of[i]))})
                made = [pa.array(x, kind) for x, kind in zip((count, hits, items), HIT_TYPES)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *made], [*own, *HIT_COLUMNS])

    return docs.mapInArrow(run, schema)


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, part_bytes: int = PART_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the benchmark passages that occur in ``text``.

    A-Z are lower-cased and words are runs of digits, letters and characters
    beyond ASCII. A window is ``n`` consecutive words of an item, or the whole
    item if it has fewer. Added are n_words, hits (stretches of words inside
    any occurrence of a window, as first and last word, from 0, and first byte
    and the byte after the last, in UTF-8) and items (distinct ids as strings,
    sorted). A null or empty text has no words; an item without words has no
    windows; a null item id finds its words but is named in no list; repeated
    items count once. Columns of ``docs`` with these names are replaced. Empty
    tables give no hits and no rows. A text of more than ``block_bytes`` is read
    in pieces.
    """
    plain = docs.drop(*HIT_COLUMNS)
    pieces = stored(benchmark_pieces(benchmark, item, item_text, n), "benchmark-pieces")
    total = pieces.select(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    while parts > 1:  # hashed parts differ in size: more of them until all are within the bound
        sizes = pieces.groupBy(F.pmod(F.xxhash64("item", "words"), parts)).agg(F.sum(F.octet_length("words")).alias("size"))
        if sizes.agg(F.max("size")).first()[0] <= max(part_bytes, pieces.agg(F.max(F.octet_length("words"))).first()[0]):
            break
        parts += 1 + parts // 4
    out = plain
    for k in range(parts):
        rows = pieces.filter(F.pmod(F.xxhash64("item", "words"), parts) == k).distinct().collect()  # at most part_bytes
        out = _with_part(out if k == 0 else stored(out, "hits"), Windows([(r.item, r.words) for r in rows], n), text, n, block_bytes)
    return out


def without_hits(found: DataFrame, text: str = "text", largest_share: float | None = None) -> DataFrame:
    """Decontaminated documents from those of ``with_hits``, without its columns.

    Every hit stretch is cut out of the text, white space and marks around it
    stay. With ``largest_share`` documents in which a larger share of the words
    is hit are removed whole, and only the others are cut (0: every document
    with a hit goes). A text without hits stays as it is, null included.
    """
    n_hit = hit_words()
    if largest_share is not None:
        found = found.filter(n_hit <= F.col("n_words") * largest_share)
    raw = F.col(text).cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("hits", lambda h: h["last_byte"]))
    ends = F.concat(F.transform("hits", lambda h: h["first_byte"]), F.array(F.octet_length(raw).cast("long")))
    kept = F.zip_with(begins, ends, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    cut = F.when(F.size("hits") == 0, F.col(text)).otherwise(F.array_join(kept, ""))
    return found.withColumn(text, cut).drop(*HIT_COLUMNS)


def hit_words():
    return F.aggregate("hits", F.lit(0).cast("long"), lambda total, h: total + h["last_word"] - h["first_word"] + 1)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occur in windows of ``benchmark``, and the items whose windows occur."""
    found = with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    counted = found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return counted.withColumn("contaminated", F.col("n_hit") > 0)


OP12_SQL = f"""
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[s : s + least(len(ws), {WINDOW}) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW}, 0) + 2)) AS s FROM item_words WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, s, array_to_string(ws[s : s + n - 1], ' ') AS w
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM doc_words, sizes WHERE len(ws) >= n)),
found AS (SELECT r, places.n, s, item_id FROM places JOIN windows USING (n, w)),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM (SELECT DISTINCT r, s, n FROM found)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""
