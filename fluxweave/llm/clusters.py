"""Centroid clustering of whole-number vectors, with Ptolemaic lower bounds from cached pivot distances.

For four points Ptolemy's inequality gives d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|. The
distances of every vector to a few fixed pivots are computed once and written beside the vector; each round adds
those of the centroids, so that every pair of pivots bounds a distance from below by four numbers instead of all
components. The bounds are rounded down by more than the arithmetic can err; a centroid is left out only if its bound
lies above a distance that is known exactly, so ties always reach the exact comparison.

A round is one pass over the written vectors: tasks send sums and counts of their centroids, which Spark adds up, and
only the centroids (``k`` vectors) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.llm.tables import schema_with, stored, table

CENTROIDS, ROUNDS, COMPONENTS, SCALE, SEED = 16, 3, 64, 64, 1
PIVOTS = 16  # they change the speed and never a result
LARGEST = 1 << 27  # of a component as a whole number: squared distances of up to 128 components then fit 64 bits
BLOCK = 2048
FACTS = 2  # before a task's sums of components: its rows and the distances it computed
SLACK = 32 * np.finfo(np.float64).eps  # above the relative error of a bound's few multiplications and roots


class Pivots(NamedTuple):
    points: np.ndarray  # int64, one row per pivot
    pairs: tuple[tuple[int, int, float], ...]  # two pivots and their distance


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    apart = rows - point
    return np.einsum("ij,ij->i", apart, apart)


def choose_pivots(starts: np.ndarray, count: int = PIVOTS) -> Pivots:
    """The first ``count`` different starting centroids, each paired with the pivots nearest to it and farthest from it.

    A starting centroid has the bound d(x, p) for itself, so the first round needs few comparisons; later centroids
    gain from every pair of which one pivot lies near the vector or the centroid.
    """
    points = starts[np.sort(np.unique(starts, axis=0, return_index=True)[1])][:count]
    pairs = {}
    for i, point in enumerate(points):
        apart = squared(points, point)
        others = np.flatnonzero(apart > 0)
        for j in (others[apart[others].argmin()], others[apart[others].argmax()]) if len(others) else ():
            pairs[min(i, int(j)), max(i, int(j))] = float(np.sqrt(apart[j]))
    return Pivots(points, tuple((i, j, d) for (i, j), d in sorted(pairs.items())))


def pivot_distances(rows: np.ndarray, pivots: Pivots) -> np.ndarray:
    out = np.zeros((len(rows), len(pivots.points)))
    for i, point in enumerate(pivots.points):
        out[:, i] = np.sqrt(squared(rows, point).astype(np.float64))
    return out


def lower_bounds(cached: np.ndarray, centres: np.ndarray, pairs: tuple[tuple[int, int, float], ...]) -> np.ndarray:
    """For every vector and centroid a number that is not above their distance, from distances to pivots alone."""
    best = np.zeros((len(cached), len(centres)))
    for i, j, apart in pairs:
        one = np.multiply.outer(cached[:, i], centres[:, j])
        two = np.multiply.outer(cached[:, j], centres[:, i])
        np.maximum(best, (np.abs(one - two) - SLACK * (one + two)) / apart, out=best)
    return best * (1 - SLACK)


def nearest(rows: np.ndarray, cached: np.ndarray, centroids: np.ndarray, centres: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row (ties: the smaller number), its squared distance, and how many distances were computed."""
    bounds = lower_bounds(cached, centres, pivots.pairs)
    first = bounds.argmin(axis=1)
    known = squared(rows, centroids[first])
    within = bounds * bounds * (1 - SLACK) <= known.astype(np.float64)[:, None] * (1 + SLACK)
    within[np.arange(len(rows)), first] = False
    best, number = known, first
    for c in range(len(centroids)):
        at = np.flatnonzero(within[:, c])
        if len(at):
            exact = squared(rows[at], centroids[c])
            closer = (exact < best[at]) | ((exact == best[at]) & (c < number[at]))
            best[at[closer]], number[at[closer]] = exact[closer], c
    return number, best, len(rows) + int(within.sum())


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def whole_vectors(df: DataFrame, vec: str, embedding: str, components: int, scale: int) -> DataFrame:
    """(vec_id, whole array<int>): vectors of exactly ``components`` finite numbers, as floor(scale * x)."""
    numbers = F.col(embedding).cast("array<double>")
    good = (F.size(numbers) == components) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.select(F.col(vec).cast("long").alias("vec_id"), numbers.alias("__numbers")).filter(F.coalesce(good, F.lit(False)))

    def whole(x):
        value = F.floor(x * scale)
        return F.when(F.abs(x * scale) < LARGEST, value).otherwise(F.raise_error(F.lit(f"a component of {LARGEST} or more after scaling"))).cast("int")

    return kept.select("vec_id", F.transform("__numbers", whole).alias("whole"))


def _least(vectors: DataFrame, seed: int, count: int) -> np.ndarray:
    """The vectors with the ``count`` least hashes of seed and id, in that order; equal ids are ordered by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(key.alias("key"), "vec_id", "whole").orderBy("key", "vec_id", "whole").limit(count).collect()
    return np.array([r.whole for r in rows], np.int64)


def _assigned(prepared: DataFrame, centroids: np.ndarray, pivots: Pivots, sums: bool) -> DataFrame:
    width = centroids.shape[1]
    centres = pivot_distances(centroids, pivots)

    def blocks(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = _matrix(part.column("whole"), width, np.int64)
                number, distance, examined = nearest(rows, _matrix(part.column("pivots"), len(pivots.points), np.float64), centroids, centres, pivots)
                yield part, rows, number, distance, examined

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(centroids), FACTS + width), np.int64)
        for _, rows, number, _, examined in blocks(batches):
            held[number[0], 1] += examined
            for c in np.unique(number):
                mine = rows[number == c]
                held[c, 0] += len(mine)
                held[c, FACTS:] += mine.sum(axis=0)
        at = np.flatnonzero(held[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(held[at]), pa.list_(pa.int64()))], ["cluster", "sums"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, distance, _ in blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    if sums:
        return prepared.mapInArrow(totals, "cluster int, sums array<long>")
    return prepared.mapInArrow(rows, "vec_id long, cluster int, distance long")


class Clusters(NamedTuple):
    rows: DataFrame  # vec_id, cluster, distance (squared)
    centroids: np.ndarray
    examined: list[tuple[int, int]]  # of every round: distances computed, and those a full comparison computes


def cluster(
    vectors: DataFrame,
    vec: str = "vec_id",
    embedding: str = "embedding",
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: int = SEED,
) -> Clusters:
    """Lloyd's rounds over the vectors as whole numbers floor(scale * x), exact in every step.

    Left out are vectors that are null, of another length, or hold a null or a
    number that is not finite. A component of LARGEST or more after scaling
    stops the run with a message, since distances would pass 64 bits. The first
    centroids are the vectors with the least sha256 of ``seed:id`` (a null id
    counts as ``null``; repeated rows are vectors of their own, ordered by their
    components); with fewer vectors there are fewer centroids. Ties go to the
    smaller centroid, an empty centroid stays where it is. Other columns of the
    input are not read. Without vectors the result is empty.
    """
    if components > 128:
        raise ValueError("more than 128 components can pass 64 bits")
    whole = whole_vectors(vectors, vec, embedding, components, scale)
    now = _least(whole, seed, centroids)
    if not len(now):
        return Clusters(whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, components), np.int64), [])
    pivots = choose_pivots(now)
    prepared = stored(_with_pivots(whole, pivots), "vectors")
    examined = []
    for _ in range(rounds):
        parts = _assigned(prepared, now, pivots, sums=True).select("cluster", F.posexplode("sums").alias("at", "x"))
        found: dict[int, dict[int, int]] = {}
        for r in parts.groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():  # centroids x components
            found.setdefault(r.cluster, {})[r["at"]] = r.x
        now = now.copy()
        for c, sums in found.items():
            now[c] = [sums[FACTS + i] // sums[0] for i in range(components)]
        examined.append((sum(s[1] for s in found.values()), sum(s[0] for s in found.values()) * len(now)))
    return Clusters(stored(_assigned(prepared, now, pivots, sums=False), "assigned"), now, examined)


def _with_pivots(whole: DataFrame, pivots: Pivots) -> DataFrame:
    width = pivots.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                near = pivot_distances(_matrix(part.column("whole"), width, np.int64), pivots)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("whole"), pa.array(list(near), pa.list_(pa.float64()))], ["vec_id", "whole", "pivots"])

    return whole.mapInArrow(run, schema_with(whole, pivots="array<double>"))


def op11_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every kept vector of ``embeddings``, with sums of distances and the digest of its centroid."""
    found = cluster(table(spark, sf_dir, "embeddings"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids.tolist())]
    sums = found.rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()  # one row per centroid
    inertia = {r.cluster: r.inertia for r in sums}
    facts = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), d) for i, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    kept = f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, sha256('{SEED}:' || coalesce(vec_id::VARCHAR, 'null')) AS h,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
parts AS (SELECT r, unnest(range({COMPONENTS})) AS d, unnest(v) AS x FROM kept),
c0 AS (
  SELECT n - 1 AS c, unnest(range({COMPONENTS})) AS d, unnest(v) AS x
  FROM (SELECT v, row_number() OVER (ORDER BY h, vec_id, v) AS n FROM kept) WHERE n <= {CENTROIDS})"""
    steps = [kept]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS (
  SELECT r, arg_min(c, (dist, c)) AS c, min(dist) AS dist
  FROM (SELECT r, c, sum((p.x - k.x) * (p.x - k.x))::BIGINT AS dist FROM parts p JOIN c{i} k USING (d) GROUP BY r, c) GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (
  SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN parts USING (r) GROUP BY c, d),
c{i + 1} AS (
  SELECT c, d, CASE WHEN n IS NULL THEN k.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} k LEFT JOIN m{i} USING (c, d))""")
    last = ROUNDS
    return "WITH " + ",\n".join(steps) + f""",
digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS digest FROM c{last} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, dist AS distance, sum(dist) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(dist) OVER ()::BIGINT AS inertia, digest AS centroid_sha256
FROM a{last} JOIN kept USING (r) JOIN digests USING (c)"""


OP11_SQL = _sql()
