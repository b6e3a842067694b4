"""Phrase collocations by SON partitioning: phrases frequent in some shard are candidates, all candidates are counted exactly.

The input partitions are dealt to SHARDS shards. A phrase with ``least`` occurrences has at least ceil(least / SHARDS)
of them in some shard, so the phrases that reach this local support in a shard are all that can be frequent. A shard is
mined level by level, completely: of phrases of n words only those count whose two parts of n - 1 words passed the
level before (for pairs: whose words are frequent everywhere). In mining a phrase is a 64-bit hash, which can only let
a phrase in by mistake; the last pass counts the candidates by their words, exactly. What passed a level is sent to
the tasks as a bit field of at most 2^MOST_BITS bits, built by Spark; a fuller field lets in more phrases by mistake
and leaves none out, so its size changes the speed alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxweave.llm.tables import stored, table
from fluxweave.llm.words import BYTE_VALUE, give_back, mix, span_hash, text_pieces, word_spans

LONGEST, LEAST, ABSORBED, TOP = 3, 10, 50, 2000
SHARDS = 4
SCALE = 1_000_000
NO_LANG = "und"
BLOCK_BYTES = 2_000_000
FLUSH = 2_000_000  # phrases that a task holds before it sends their counts
LEAST_BITS, MOST_BITS, BITS_A_KEY = 16, 28, 16
BROADCAST_ROWS = 200_000  # counted parts of phrases; beyond it Spark joins them itself and splits hot parts

STOPS = np.zeros(256, bool)  # end a piece
STOPS[[ord(c) for c in ".,;:!?"]] = STOPS[0x0A:0x0E] = True
GAP = STOPS.copy()
GAP[[0x20, 0x09]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 0x20
_U = np.uint64
_STEP = _U(0xC2B2AE3D27D4EB4F)


def _hash_strings(values: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8)[: offsets[-1]] if len(values) and offsets[-1] else np.zeros(0, np.uint8)
    return span_hash(BYTE_VALUE[data], offsets[:-1], offsets[1:])


class Block:
    """The words of some texts as numbers: ``unit`` counts pairs of language and word, ``key`` is the hash of a unit."""

    def __init__(self, langs: pa.Array, data: np.ndarray, offsets: np.ndarray, owned: int):
        starts, ends, first = word_spans(data, offsets, GAP)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.own = starts < owned
        self.piece = np.cumsum(STOPS[data], dtype=np.int64)[starts] + row if len(starts) else np.zeros(0, np.int64)
        cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        spelled = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(data[~GAP[data]]))
        words, codes = spelled.dictionary_encode(), langs.dictionary_encode()
        self.words, self.langs = words.dictionary, codes.dictionary
        size = max(len(self.words), 1)
        paired = codes.indices.to_numpy().astype(np.int64)[row] * size + words.indices.to_numpy()
        pairs, self.unit = np.unique(paired, return_inverse=True)
        self.unit_lang, self.unit_word = pairs // size, pairs % size
        lang_key = mix(_hash_strings(self.langs) * _STEP)
        self.key = mix(_hash_strings(self.words)[self.unit_word] * _STEP + lang_key[self.unit_lang]) if len(pairs) else np.zeros(0, _U)

    def starts(self, n: int) -> np.ndarray:
        """Places where a phrase of ``n`` words begins: all in one piece, and the first in this block's own part."""
        last = len(self.piece) - n + 1
        return self.own[:last] & (self.piece[n - 1 :] == self.piece[:last]) if last > 0 else np.zeros(0, bool)

    def hashes(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from every place on where so many follow."""
        keys = self.key[self.unit]
        out = keys[: max(len(keys) - n + 1, 0)]
        for i in range(1, n):
            out = mix(out * _STEP + keys[i : i + len(out)])
        return out


def _blocks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Block]:
    for batch, data, offsets, _, owned, _ in text_pieces(batches, "text", GAP, longest - 1, LOWERED, BLOCK_BYTES):
        yield Block(batch.column("lang"), data, offsets, owned)


class BitField:
    """A set of hashes in which every member is found, and few others while it is not full."""

    def __init__(self, bits: int, filled: dict[int, bytes]):
        self.shift = _U(64 - bits)
        field = np.zeros(max(1 << bits, 1 << 15) // 8, np.uint8)
        for bucket, content in filled.items():
            field[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(content, np.uint8)
        self.field = field

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> self.shift).astype(np.int64)
        return (self.field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bit_field(keys: DataFrame) -> BitField:
    """The hashes of ``keys(key long)`` as bits; the rows stay on Spark, the bits reach the driver."""
    bits = min(max(LEAST_BITS, math.ceil(math.log2(max(keys.count(), 1) * BITS_A_KEY))), MOST_BITS)
    cell = F.shiftrightunsigned("key", 64 - bits) + 1
    filled = keys.select(F.call_function("bitmap_bucket_number", cell).alias("bucket"), F.call_function("bitmap_bit_position", cell).alias("at"))
    made = filled.groupBy("bucket").agg(F.call_function("bitmap_construct_agg", F.col("at")).alias("bits"))
    return BitField(bits, {r.bucket: bytes(r.bits) for r in made.collect()})


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, key, n): occurrences of every word; ``docs`` are those of ``_texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 1):
            n = np.bincount(block.unit[block.own], minlength=len(block.key))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [block.langs.take(pa.array(block.unit_lang[at])), block.words.take(pa.array(block.unit_word[at])), pa.array(block.key[at].view(np.int64)), pa.array(n[at])], ["lang", "phrase", "key", "n"]
            )
        give_back()

    return docs.mapInArrow(run, "lang string, phrase string, key long, n long").groupBy("lang", "phrase", "key").agg(F.sum("n").alias("n"))


def _mined(docs: DataFrame, n: int, before: BitField, longest: int, local: int, shards: int) -> DataFrame:
    """(key): hashes of phrases of ``n`` words that reach the local support in some shard."""
    held = docs.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, shard = held.value, TaskContext.get().partitionId() % shards
        waiting: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(waiting) if waiting else np.zeros(0, _U), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), shard, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], ["shard", "key", "n"])

        for block in _blocks(batches, longest):
            known = passed.has(block.key)[block.unit] if n == 2 else passed.has(block.hashes(n - 1))
            here = block.starts(n)
            here = np.flatnonzero(here & known[: len(here)] & known[1 : len(here) + 1])
            waiting.append(block.hashes(n)[here])
            if sum(map(len, waiting)) >= FLUSH:
                yield counted()
        yield counted()
        give_back()

    found = docs.mapInArrow(run, "shard int, key long, n long").groupBy("key", "shard").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= local).select("key")


def _counted(docs: DataFrame, fields: dict[int, BitField]) -> DataFrame:
    """(lang, size, phrase, n): exact occurrences of the phrases in the bit fields, by number of words."""
    held, longest = docs.sparkSession.sparkContext.broadcast(fields), max(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = held.value
        for block in _blocks(batches, longest):
            number, units = block.unit.astype(np.int64), max(len(block.key), 1)
            for n in range(2, longest + 1):
                if len(number) < 2:
                    break
                # the phrase from a place on: what it was without its last word, and that word
                _, number = np.unique(number[:-1] * units + block.unit[n - 1 :], return_inverse=True)
                at = np.flatnonzero(block.starts(n))
                at = at[passed[n].has(block.hashes(n)[at])]
                _, one, counts = np.unique(number[at], return_index=True, return_counts=True)
                place = at[one]
                spelled = [block.words.take(pa.array(block.unit_word[block.unit[place + i]])) for i in range(n)]
                lang = block.langs.take(pa.array(block.unit_lang[block.unit[place]]))
                yield pa.RecordBatch.from_arrays(
                    [lang, pa.array(np.full(len(place), n, np.int32)), pc.binary_join_element_wise(*spelled, " "), pa.array(counts)], ["lang", "size", "phrase", "n"]
                )
        give_back()

    return docs.mapInArrow(run, "lang string, size int, phrase string, n long").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, shards: int = SHARDS) -> DataFrame:
    """(lang, size, phrase, n) with exact counts: all words (size 1), and the phrases of 2 to ``longest`` words with n >= ``least``.

    A-Z are lower-cased; texts are cut into pieces at ``.,;:!?`` and line
    breaks (code points 10 to 13), pieces into words at spaces and tabs. A
    phrase lies inside one piece; its occurrences may overlap. Languages are
    counted apart, a null one as ``und``; a null or empty text has no words.
    Repeated rows count again. Other columns are not read. Texts of any length
    are cut into pieces of BLOCK_BYTES between words. No documents, no rows.
    """
    texts, local = _texts(docs, text, lang), -(-least // shards)
    words = stored(word_counts(texts), "words")
    fields: dict[int, BitField] = {}
    passed = bit_field(words.filter(F.col("n") >= least).select("key"))
    for n in range(2, longest + 1):
        passed = fields[n] = bit_field(stored(_mined(texts, n, passed, longest, local, shards), f"local-{n}"))
    phrases = stored(_counted(texts, fields).filter(F.col("n") >= least), "phrases")
    return words.select("lang", F.lit(1).alias("size"), "phrase", "n").unionByName(phrases)


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _words(first, size):
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def _score(a: str, left: str, right: str):
    a, left, right = (f"cast({x} as decimal(15,0))" for x in (a, left, right))
    return F.expr(f"({SCALE}BD * {a} * {a}) div ({left} * {right})")


def scored(counts: DataFrame, least: int = LEAST, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates among the counts of ``frequent_phrases`` that no longer candidate absorbs.

    A phrase is scored by the cut of lowest floor(SCALE * a * a / (l * r)), the
    first such cut; decimals of 38 digits hold the products for counts up to
    10^15. It is dropped if a longer candidate contains it and has at least
    ``absorbed`` hundredths of its occurrences.
    """
    candidates = counts.filter((F.col("size") > 1) & (F.col("n") >= least))
    parts = _side(counts.filter(F.col("n") >= least).select("lang", "phrase", "n"))
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", _words(F.lit(1), F.col("k"))).withColumn("rest", _words(F.col("k") + 1, F.col("size") - F.col("k")))
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", _score("a", "l", "r"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("best"))
    inner = candidates.filter(F.col("size") > 2).select("lang", "phrase", "size", "n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "phrase", "n", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("s"))
    longer = inner.select("lang", _words(F.col("s"), F.col("m")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a")))
    return kept.select("lang", "phrase", "a", "best.*")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, absorbed: int = ABSORBED, top: int | None = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, then occurrences, then text (None: all).

    Ranks follow UTF-8 byte order where scores and occurrences are equal.
    """
    counts = frequent_phrases(docs, text, lang, longest, least, shards)
    totals = counts.filter("size = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored(counts, least, absorbed).withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(_side(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading collocations of every language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, '{NO_LANG}') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)),
phrases AS (
  SELECT lang, size, array_to_string(ws[s : s + size - 1], ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM pieces, range(1, {LONGEST + 1}) t(size) WHERE len(ws) >= size)),
counts AS (SELECT lang, size, phrase, count(*) AS n FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, n AS a FROM counts WHERE size > 1 AND n >= {LEAST}),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1 : k], ' ') AS first, array_to_string(ws[k + 1 : size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
cut_scores AS (
  SELECT cuts.lang, cuts.phrase, a, k, f.n AS l, g.n AS r, (({SCALE}::HUGEINT * a * a) // (f.n::HUGEINT * g.n))::BIGINT AS score
  FROM cuts JOIN counts f ON f.lang = cuts.lang AND f.phrase = first JOIN counts g ON g.lang = cuts.lang AND g.phrase = rest),
best AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(ws[s : s + m - 1], ' ') AS phrase, a AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates WHERE size > 2))),
kept AS (
  SELECT * FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= {ABSORBED} * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n AS n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= {TOP}"""
