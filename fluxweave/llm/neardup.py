"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

Documents with the same words are one node. Document frequencies come from all
documents through a table of fixed size that shingles share by hash. Each node
is sampled by improved consistent weighted sampling and banded, and again by
least hashes of its distinct shingles, since a pair may be alike in only one of
the two ways (a passage repeated in one text only); nodes of a band's bucket are linked to the bucket's hub only, which joins candidates into
clusters in linear work. Inside a cluster the Jaccard similarity decides,
weighted by count and idf or plain, whichever is larger: idf weighs the words
of an edit more than the words that copies share, and must not part texts that
share enough of them. Every node is held against the cluster's hub, and the nodes that the hub does
not take are held against all nodes of the cluster, in blocks. Nodes that the
hub takes are one class already and need no comparison among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm.components import components
from fluxweave.llm.sums import array_total
from fluxweave.llm.tables import stored, table
from fluxweave.llm.words import digest_halves, joined_words, mix, span_hash, text_blocks, word_names, word_spans

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
CELLS = 1 << 20  # of the document-frequency table
BLOCK = 512  # nodes of a cluster that one task holds against as many others
BROADCAST_IDS = 1_000_000
_U = np.uint64
_ODD = mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64)) | _U(1)
_SALT = mix(np.arange(501, 501 + BANDS * ROWS, dtype=np.uint64))
_PLAIN = mix(np.arange(901, 901 + BANDS * ROWS, dtype=np.uint64))


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) draws r, their inverses, and logarithms of Gamma(2, 1) draws c, as tables of 65536 entries."""
    u = ((mix(np.arange(1, 4 * 65536 + 1, dtype=np.uint64)) >> _U(11)).astype(np.float64) + 0.5) / 2.0**53
    r = -np.log(u[:65536] * u[65536:131072])
    c = -np.log(u[131072:196608] * u[196608:])
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(c).astype(np.float32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles sorted by (row, hash): row, hash and count of each.

    A text of fewer than SHINGLE words is one shingle; one without words has none.
    """
    starts, ends, first = word_spans(data, offsets)
    words, count = word_names(data, starts, ends), np.diff(first)
    number = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(count)), number)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + first[:-1][row]
    names = span_hash(words, begin, np.minimum(begin + SHINGLE, first[1:][row]))
    order = np.lexsort((names, row))
    row, names = row[order], names[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (names[1:] != names[:-1])
    at = np.flatnonzero(fresh)
    return row[at], names[at], np.diff(np.append(at, len(row)))


def idf_table(docs: DataFrame) -> np.ndarray:
    """Weight of the shingles of every cell: 1 + log((1 + N) / (1 + df)) / log(1 + N), between 1 and 2.

    df counts the documents with a shingle of the cell, over all ``docs``.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held = np.zeros(CELLS + 64, np.int64)
        for _, data, offsets in text_blocks(batches):
            row, names, _ = shingles(data, offsets)
            np.add.at(held, (names >> _U(44)).astype(np.int64), 1)
            held[CELLS] += len(np.unique(row))
        yield held

    total = array_total(docs.select("text"), CELLS + 64, parts)
    n = total[CELLS]
    return (1 + np.log((1.0 + n) / np.minimum(1.0 + total[:CELLS], 1.0 + n)) / np.log(2.0 + n)).astype(np.float32)


def samples(row: np.ndarray, names: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Improved consistent weighted sampling: BANDS * ROWS samples (element and its level, hashed) for each row; 0 without elements."""
    out = np.zeros((rows, BANDS * ROWS), np.uint64)
    if not len(row):
        return out
    r_table, inverse, c_table = _draws()
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    of = np.cumsum(np.r_[False, row[1:] != row[:-1]])
    have = row[begin]
    log_weight = np.log(weight).astype(np.float32)
    low = _U(0xFFFF)
    for j in range(BANDS * ROWS):
        x = (names ^ _SALT[j]) * _ODD[j]
        at_r = (x >> _U(48)).astype(np.int64)
        beta = ((x >> _U(16)) & low).astype(np.float32) * np.float32(1 / 65536)
        r = r_table[at_r]
        level = np.floor(log_weight * inverse[at_r] + beta)
        key = c_table[((x >> _U(32)) & low).astype(np.int64)] - r * (level - beta + 1)
        least = np.minimum.reduceat(key, begin)
        hit = np.flatnonzero(key == least[of])
        out[have[of[hit]], j] = mix(names[hit] + level[hit].astype(np.int64).view(np.uint64) * _ODD[0])
    return out


def plain_samples(row: np.ndarray, names: np.ndarray, rows: int) -> np.ndarray:
    """Least hashes of the distinct shingles, BANDS * ROWS for each row, without counts and idf; 0 without elements."""
    out = np.zeros((rows, BANDS * ROWS), np.uint64)
    if not len(row):
        return out
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    for j in range(BANDS * ROWS):
        x = (names ^ _PLAIN[j]) * _ODD[j]
        out[row[begin], j] = np.minimum.reduceat(x ^ (x >> _U(32)), begin)
    return out


def signed(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, words_key, bands): 128-bit digest of the words of every text, and its hash in every band, BANDS of weighted and BANDS of plain samples; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches, limit=500_000):
            row, names, count = shingles(data, offsets)
            picks = samples(row, names, idf[(names >> _U(44)).astype(np.int64)] * count, batch.num_rows)
            picks = np.hstack([picks, plain_samples(row, names, batch.num_rows)])
            bands = np.zeros((batch.num_rows, 2 * BANDS), np.uint64)
            for k in range(ROWS):
                bands = mix(bands + picks[:, k::ROWS])
            some = np.bincount(row, minlength=batch.num_rows) > 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(some * 2 * BANDS)]).astype(np.int32)), pa.array(bands[some].ravel().view(np.int64))
            )
            key = pa.StructArray.from_arrays([pa.array(half) for half in digest_halves(joined_words(data, offsets)).T], ["a", "b"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), key, lists], ["doc_id", "words_key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, words_key struct<a:long,b:long>, bands array<long>"
    )


def weighted_sets(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, items, weights): the shingles of every text in ascending order, repeated ones numbered, with their weights.

    A negative weight marks a repeat of a shingle that the text already has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches):
            row, names, count = shingles(data, offsets)
            weight = idf[(names >> _U(44)).astype(np.int64)]
            at = np.repeat(np.arange(len(names)), count)
            turn = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            items = np.where(turn > 0, mix(names[at] + turn.astype(np.uint64) * _ODD[1]), names[at])
            signed_weight = np.where(turn > 0, -weight[at], weight[at])
            order = np.lexsort((items, row[at]))
            cuts = pa.array(np.searchsorted(row[at], np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(cuts, pa.array(items[order].view(np.int64))),
                    pa.ListArray.from_arrays(cuts, pa.array(signed_weight[order])),
                ],
                ["doc_id", "items", "weights"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, items array<long>, weights array<float>"
    )


def likeness(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The larger of the weighted Jaccard similarity and the plain one of two sets as ``weighted_sets`` gives them."""
    common = wa[np.isin(a, b, assume_unique=True)]
    out = 0.0
    for measure in (np.abs, lambda w: w > 0):
        met = measure(common).sum(dtype=np.float64)
        union = measure(wa).sum(dtype=np.float64) + measure(wb).sum(dtype=np.float64) - met
        out = max(out, met / union if union > 0 else 0.0)
    return float(out)


def _taken_by_hub(pairs: DataFrame, similar: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("items", "weights", "hub_items", "hub_weights")]
            taken = [likeness(*[x[i].values.to_numpy() for x in lists]) >= similar for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("root", "node", "hub")], pa.array(taken, pa.bool_())], ["root", "node", "hub", "taken"])

    return pairs.mapInArrow(run, "root long, node long, hub long, taken boolean")


def _links_in_block(similar: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, all_ = pdf[pdf.asks], pdf[~pdf.asks]
        group = {int(x): int(x) for x in pdf.node}

        def root(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        items, weights = np.concatenate([*all_["items"]]), np.concatenate([*all_["weights"]])
        cuts = np.cumsum([0, *all_["items"].map(len)])
        nodes = all_.node.to_numpy()
        order = np.argsort(items, kind="stable")
        owner = np.repeat(np.arange(len(nodes)), np.diff(cuts))[order]
        items, weights = items[order], weights[order]
        measures = [lambda w: np.abs(w).astype(np.float64), lambda w: (w > 0).astype(np.float64)]
        sizes = [measure(weights) for measure in measures]
        totals = [np.bincount(owner, weights=size, minlength=len(nodes)) for size in sizes]
        links = []
        for node, item, weight in zip(mine.node, mine["items"], mine["weights"]):
            low, high = np.searchsorted(items, item, "left"), np.searchsorted(items, item, "right")
            met = high - low
            at = np.repeat(low - np.cumsum(met) + met, met) + np.arange(met.sum())
            alike = np.zeros(len(nodes), bool)
            for measure, size, total in zip(measures, sizes, totals):
                common = np.bincount(owner[at], weights=size[at], minlength=len(nodes))
                alike |= common >= similar * (measure(weight).sum() + total - common) - 1e-9
            for other in nodes[alike]:
                a, b = root(int(node)), root(int(other))
                if a != b:  # a link inside what is joined already says nothing new
                    group[max(a, b)] = min(a, b)
                    links.append((int(node), int(other)))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def _few(side: DataFrame) -> DataFrame:
    """``side`` (a few numbers a row), broadcast if it is counted to be small; a larger one joins by Spark's own plan."""
    return F.broadcast(side) if side.count() <= BROADCAST_IDS else side


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id) for every doc_id: the smallest doc_id that links of at least ``similar`` reach.

    Texts with the same words are always linked. Null, empty and blank texts
    have nothing to compare and stand alone, as rows with a null doc_id do not
    appear. Rows repeated under one doc_id are one document.
    """
    idf = idf_table(docs)
    marks = stored(signed(docs.filter("doc_id IS NOT NULL"), idf), "near-marks")
    worded = marks.filter(F.size("bands") > 0)
    node = worded.groupBy("words_key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min_by("bands", "doc_id").alias("bands"))
    nodes = stored(node, "near-nodes")
    cells = nodes.select("node", "copies", F.posexplode("bands").alias("band", "cell"))
    hubs = cells.groupBy("band", "cell").agg(F.max(F.struct("copies", F.negate("node").alias("key"))).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = cells.join(hubs, ["band", "cell"]).select(F.col("node").alias("u"), F.negate("top.key").alias("v")).filter("u <> v").distinct()
    edges = stored(edges, "near-candidates")
    clusters = components(edges, "near-clusters")
    degree = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    copies = nodes.groupBy("node").agg(F.max("copies").alias("copies"))
    chosen = stored(copies.join(_few(clusters), "node").join(degree, "node").select("node", "root", "copies", "degree"), "near-members")
    own = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = own.join(_few(chosen.select("node")), "node").withColumnRenamed("node", "doc_id")
    top = F.max(F.struct("copies", "degree", F.negate("node").alias("key"))).alias("top")
    hub = chosen.groupBy("root").agg(top, F.count(F.lit(1)).alias("size")).select("root", F.negate("top.key").alias("hub"), "size")
    hub = stored(hub, "near-hubs")
    sets = weighted_sets(texts, idf).withColumnRenamed("doc_id", "node").join(_few(chosen.select("node", "root")), "node")
    sets = stored(sets, "near-sets")
    hub_sets = sets.join(_few(hub), "root").filter("node = hub").select(
        "root", "hub", F.col("items").alias("hub_items"), F.col("weights").alias("hub_weights")
    )
    held = stored(_taken_by_hub(sets.join(hub_sets, "root").filter("node <> hub"), similar), "near-held")
    asking = held.filter(~F.col("taken")).select("root", "node")
    open_ = _few(hub).filter("size > 2").join(asking.select("root").distinct(), "root").select("root", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    open_ = stored(open_, "near-open")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    there = sets.select("root", "node", "items", "weights").join(_few(open_), "root").withColumn("block", block)
    asks = there.join(_few(asking), ["root", "node"], "left_semi").withColumn("asks", F.lit(True)).withColumn("mine", F.col("block")).withColumn("theirs", F.explode(every))
    all_ = there.withColumn("asks", F.lit(False)).withColumn("theirs", F.col("block")).withColumn("mine", F.explode(every))
    # dealt by block: by the cluster alone, all blocks of a large one would meet in one task
    blocks = asks.unionByName(all_).repartition("root", "mine", "theirs")
    rest = blocks.groupBy("root", "mine", "theirs").applyInPandas(_links_in_block(similar), "u long, v long")
    links = held.filter("taken").select(F.col("node").alias("u"), F.col("hub").alias("v")).unionByName(rest)
    classes = components(links, "near-classes")
    of_node = marks.join(nodes.select("words_key", "node"), "words_key").select("doc_id", "node").join(_few(classes), "node", "left")
    found = of_node.select("doc_id", F.coalesce("root", "node").alias("class_id")).unionByName(
        marks.filter(F.size("bands") == 0).select("doc_id", F.col("doc_id").alias("class_id"))
    )
    return found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: its class, and whether it is the one that stays."""
    return near_classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class; rows with a null doc_id stay."""
    gone = near_classes(docs).filter("doc_id <> class_id").select("doc_id")
    return docs.join(_few(gone), "doc_id", "left_anti").select(*docs.columns)
