"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Equal vectors of one label are one node with a number of copies. A node stands
in one bucket of every table; the nodes of a bucket are compared by blocks, so
that a large bucket is many tasks. A pair counts in the first table where its
nodes meet, so no pair is counted twice and none needs to be sent anywhere: a
block gives every node its number of links, and a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxweave.llm.components import components
from fluxweave.llm.tables import schema_with, stored, table

COSINE = 0.98
BITS, TABLES = 20, 44  # at a cosine of 0.98 a pair meets in no table once in a million times
BLOCK = 1024


def _planes(width: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((width, bits * tables))


def with_signs(nodes: DataFrame, bits: int = BITS, tables: int = TABLES) -> DataFrame:
    """``nodes`` (with ``vector`` array<double>) and their bucket in every table, as ``signs`` array<int>."""
    schema = schema_with(nodes, signs=T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            vectors = batch.column("vector")
            cuts, values = np.asarray(vectors.offsets), vectors.values.to_numpy()
            widths = np.diff(cuts)
            signs = np.zeros((batch.num_rows, tables), np.int32)
            for width in np.unique(widths).tolist():
                if width not in planes:
                    planes[width] = _planes(width, bits, tables)
                rows = np.flatnonzero(widths == width)
                x = values[cuts[rows][:, None] + np.arange(width)]
                signs[rows] = ((x @ planes[width]) > 0).reshape(len(rows), tables, bits) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(signs.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "signs"])

    return nodes.mapInArrow(run, schema)


PLACE = ["label", "width", "bucket_table", "bucket"]
GROUP = [*PLACE, "low", "high"]


def _links_of_group(table: int, within: bool, side, node, copies, x, signs, cosine: float) -> tuple[list, list, list]:
    """Number of links of every node of two blocks of a bucket (or of one), and a spanning forest of them."""
    a = np.arange(len(node)) if within else np.flatnonzero(side == 0)
    b = a if within else np.flatnonzero(side == 1)
    if not len(a) or not len(b):
        return [], [], []
    norm = np.sqrt((x * x).sum(1))
    linked = (x[a] @ x[b].T) / np.outer(norm[a], norm[b]) >= cosine
    for earlier in range(table):
        linked &= signs[a, earlier][:, None] != signs[b, earlier][None]
    if within:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return [], [], []
    nodes, counts, others = [], [], []
    for rows, sums in ((a, linked @ copies[b]), (b, linked.T @ copies[a]))[: 1 if within else 2]:
        some = sums > 0
        nodes += node[rows[some]].tolist()
        counts += sums[some].tolist()
        others += [None] * int(some.sum())
    group = {int(i): int(i) for i in node}

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for i in range(len(a)):
        for other in node[b[linked[i]]].tolist():
            p, q = root(int(node[a[i]])), root(other)
            if p != q:
                group[max(p, q)] = min(p, q)
                nodes.append(int(node[a[i]]))
                counts.append(0)
                others.append(other)
    return nodes, counts, others


def _compare(cosine: float):
    """Links of the groups in rows that are sorted by GROUP; a group may reach over batches."""

    def found(batch: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket_table", "low", "high", "side", "node", "copies")}
        lists = {c: (np.asarray(batch.column(c).offsets), batch.column(c).values.to_numpy()) for c in ("vector", "signs")}
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            x, signs = (values[at[a] : at[b]].reshape(b - a, -1) for at, values in (lists["vector"], lists["signs"]))
            made = _links_of_group(
                int(column["bucket_table"][a]), column["low"][a] == column["high"][a], *(column[c][a:b] for c in ("side", "node", "copies")), x, signs, cosine
            )
            for whole, part in zip(out, made):
                whole += part
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            fresh = np.zeros(batch.num_rows - 1, bool)
            for key in GROUP:
                values = batch.column(key).to_numpy(zero_copy_only=False)
                fresh |= values[1:] != values[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(fresh) + 1])
            if len(cuts) > 1:
                yield found(batch, cuts)
            held = batch.slice(int(cuts[-1]))
        if held is not None:
            yield found(held, np.array([0, held.num_rows]))

    return run


def links_and_components(vectors: DataFrame, cosine: float = COSINE, bits: int = BITS, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``.

    Vectors link if their labels are equal and not null and their cosine, in
    double precision, is ``cosine`` or more. Vectors that are null, empty, zero
    or hold a null or non-finite component link with nothing, nor do rows
    without a vec_id. Vectors of different lengths are never compared. Equal
    vectors are linked; ``n_links`` counts rows, so rows repeated under one
    vec_id count each. ``kept`` marks the smallest vec_id of a component.
    """
    rows = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    good = rows.filter(sound & finite)
    nodes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(with_signs(nodes, bits, tables), "vector-nodes")
    cells = nodes.select("label", "node", F.size("vector").alias("width"), F.posexplode("signs").alias("bucket_table", "bucket"))
    shared = cells.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("held")).filter("held > 1").withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
    met = cells.join(shared, PLACE).join(nodes.select("node", "label", "vector", "signs", "copies"), ["node", "label"])
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a block meets itself and every other one: once as the first side, once as the second
    pairs = met.withColumn("mine", mine).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(
        "*",
        F.least("mine", "other_block").alias("low"),
        F.greatest("mine", "other_block").alias("high"),
        (F.col("mine") > F.col("other_block")).cast("int").alias("side"),
    )
    # dealt by pair of blocks: by the bucket alone, all blocks of a large one would meet in one task
    dealt = pairs.select(*GROUP, "side", "node", "copies", "vector", "signs").repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = stored(dealt.mapInArrow(_compare(cosine), "node long, n long, other long"), "vector-links")
    count = found.filter("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")), "vector-components")
    of_row = good.join(nodes.select("label", "vector", "node", "copies"), ["label", "vector"]).join(count, "node", "left").join(roots, "node", "left")
    linked = of_row.select(
        "vec_id",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("root", "node").alias("component_id"),
    )
    alone = rows.filter(~F.coalesce(sound & finite, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return links_and_components(table(spark, sf_dir, "embeddings"))


OP4_SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= CAST({COSINE} AS DOUBLE)
), reach AS (
  SELECT vec_id AS x, vec_id AS r FROM embeddings UNION SELECT l.y, reach.r FROM reach JOIN links l ON l.x = reach.x
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.r AS component_id, e.vec_id = c.r AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = e.vec_id
JOIN (SELECT x, min(r) AS r FROM reach GROUP BY x) c ON c.x = e.vec_id
"""
