"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token stands in one of BUCKETS buckets by its hash. A bucket's context
vector is the sum of the sparse random index vectors of the tokens around its
occurrences in all documents; the table has a fixed size, so it is summed over
the whole corpus and sent to every task whatever the corpus. A document is the
mean and spread of its tokens' vectors and a few shares of its surface. The
network is fitted in numpy on a bounded sample of labelled rows and its
temperature on a part of them kept aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm.sums import array_total
from fluxweave.llm.tables import schema_with, table
from fluxweave.llm.words import BYTE_VALUE, SPACE, mix, span_hash, text_blocks

BUCKETS = 1 << 15
WIDTH = 32
NONZERO = 4  # of an index vector
REACH = 2  # tokens on either side
MAX_LABELLED = 20_000  # rows the network is fitted on, those with the least hash
HIDDEN = 32
ACCEPT = 0.3
SURFACE = 7
BLOCK_BYTES = 500_000  # text whose token vectors are held at a time

_LETTER, _DIGIT, _MARK = 1, 2, 3
KIND = np.full(256, _MARK, np.int8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
KIND[48:58] = _DIGIT
KIND[SPACE] = 0
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def index_vectors() -> np.ndarray:
    """The random index vector of every bucket: NONZERO entries of +1 or -1, drawn from a hash."""
    draw = mix(np.arange(1, BUCKETS * NONZERO + 1, dtype=np.uint64)).reshape(BUCKETS, NONZERO)
    out = np.zeros((BUCKETS, WIDTH), np.int16)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(BUCKETS), (draw[:, k] % np.uint64(WIDTH)).astype(int)), np.where(draw[:, k] >> np.uint64(63), 1, -1))
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, kind and length of every token (a run of letters, digits or marks), and where each text's tokens begin."""
    kind = KIND[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    bucket = (span_hash(BYTE_VALUE[data], starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, kind[starts], ends - starts, np.searchsorted(starts, offsets)


def context_sums(bucket: np.ndarray, first: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur, and for each the sum of its contexts followed by its count."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    around = np.zeros((len(bucket), WIDTH + 1), np.int32)
    around[:, WIDTH] = 1
    vectors = index[bucket]
    for k in range(1, REACH + 1):
        near = (doc[k:] == doc[:-k])[:, None]
        around[:-k, :WIDTH] += vectors[k:] * near
        around[k:, :WIDTH] += vectors[:-k] * near
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    return found, np.add.reduceat(around[order], begin, axis=0) if len(order) else around


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets over every text of ``docs``; a bucket that never occurs is zero."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        index = index_vectors()
        held = np.zeros((BUCKETS, WIDTH + 1), np.int64)
        for _, data, offsets in text_blocks(batches, limit=BLOCK_BYTES):
            bucket, _, _, first = tokens(data, offsets)
            found, sums = context_sums(bucket, first, index)
            held[found] += sums
        yield held.ravel()

    total = array_total(docs.select("text"), BUCKETS * (WIDTH + 1), parts).reshape(BUCKETS, WIDTH + 1)
    count = total[:, WIDTH:]
    vectors = total[:, :WIDTH] / np.maximum(count, 1)
    if count.sum():
        vectors = np.where(count > 0, vectors - (vectors * count).sum(0) / count.sum(), 0.0)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean and spread of its token vectors, and shares of its surface."""
    bucket, kind, length, first = tokens(data, offsets)
    rows = len(offsets) - 1
    count = np.diff(first)
    some = count > 0
    out = np.zeros((rows, 2 * WIDTH + SURFACE), np.float32)
    if not some.any():
        return out
    begin, n = first[:-1][some], count[some][:, None].astype(np.float32)
    held = vectors[bucket]
    mean = np.add.reduceat(held, begin, axis=0) / n
    out[some, :WIDTH] = mean
    out[some, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(np.add.reduceat(held * held, begin, axis=0) / n - mean * mean, 0))
    doc = np.repeat(np.arange(rows), count)
    again = np.zeros(len(bucket), np.float32)
    again[1:] = (bucket[1:] == bucket[:-1]) & (doc[1:] == doc[:-1])
    pairs = np.unique(doc * BUCKETS + bucket)
    distinct = np.bincount(pairs // BUCKETS, minlength=rows)
    letters = np.concatenate([[0], np.cumsum(KIND[data] == _LETTER)])
    upper = np.concatenate([[0], np.cumsum(UPPER[data])])
    at = 2 * WIDTH
    out[some, at] = np.add.reduceat((kind == _MARK).astype(np.float32), begin) / n[:, 0]
    out[some, at + 1] = np.add.reduceat((kind == _DIGIT).astype(np.float32), begin) / n[:, 0]
    out[some, at + 2] = np.add.reduceat(again, begin) / n[:, 0]
    out[:, at + 3] = distinct / np.maximum(count, 1)
    out[:, at + 4] = (upper[offsets[1:]] - upper[offsets[:-1]]) / np.maximum(letters[offsets[1:]] - letters[offsets[:-1]], 1)
    out[:, at + 5] = np.log1p(count)
    out[some, at + 6] = np.add.reduceat(length.astype(np.float32), begin) / n[:, 0]
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer, one logit, a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Network fitted by Adam on four fifths of the rows; the temperature by least log loss on the rest.

    Without rows the score is 0.5; with one class only it is the smoothed share of that class.
    """
    width = x.shape[1]
    centre, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(width), np.ones(width))
    if len(x) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(centre, scale, np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    draw = np.random.default_rng(7)
    order = draw.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    z = ((x - centre) / scale).astype(np.float64)
    p = [draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs) + 1e-5
        draw.shuffle(used)
        for a in range(0, len(used), batch):
            rows = used[a : a + batch]
            hidden = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back + decay * p[0], back.sum(0), hidden.T @ error + decay * p[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]))
    logit = net.logit(x[held])
    heats = np.geomspace(0.25, 8, 60)
    losses = [np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logit / t).sum() for t in heats]
    net.temperature = float(heats[int(np.argmin(losses))])
    return net


def held_out() -> F.Column:
    """Rows kept from learning: crc32 of the id's digits is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_rows: int = MAX_LABELLED) -> Network:
    """Network for ``labels.quality``, from labelled rows that are not held out, at most ``max_rows`` by hash of their id.

    Rows without an id or a label are left out; of several labels of one id the
    larger counts, of several rows of one id the text with the least hash.
    """
    chosen = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    rows = joined.groupBy("doc_id", "__label").agg(one).select("doc_id", "__label", F.col("one.text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches, limit=BLOCK_BYTES):
            x = features(data, offsets, vectors)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"]
            )

    found = sorted((r.doc_id, r.label, bytes(r.x)) for r in rows.mapInArrow(run, "doc_id long, label int, x binary").collect())
    x = np.array([np.frombuffer(r[2], np.float32) for r in found], np.float64).reshape(len(found), 2 * WIDTH + SURFACE)
    return fit(x, np.array([r[1] for r in found], np.float64))


def scored(docs: DataFrame, vectors: np.ndarray, net: Network, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` and a score in (0, 1); higher means that label 1 is likelier. Null text counts as empty and is scored too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches, limit=BLOCK_BYTES):
            score = net.score(features(data, offsets, vectors))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score, pa.float64())], [*keep, name])

    plain = docs.select(*dict.fromkeys([*keep, "text"]))
    return plain.mapInArrow(run, schema_with(plain.select(*keep), **{name: "double"}))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = word_vectors(docs)
    net = learn(docs, table(spark, sf_dir, "labels"), vectors)
    return scored(docs, vectors, net, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ACCEPT or more."""
    columns = docs.columns
    vectors = word_vectors(docs)
    net = learn(docs, table(spark, sf_dir, "labels"), vectors)
    return scored(docs, vectors, net, columns, "__quality").filter(F.col("__quality") >= ACCEPT).select(*columns)
