"""Ordered operators that never put a whole key into one task.

A device or a performance may hold a large part of all rows, so ``lag`` and
``row_number`` over the bare key would sort that part in one task. Rows are cut
into time chunks instead: the window runs inside a chunk, and a few rows or one
count per chunk carry what the next chunk needs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from fluxweave.functions.scalars import bin_micros

CHUNK_SECONDS = 60


def over_rows_before(
    df: DataFrame,
    keys: Sequence[str],
    reach: int,
    made: Callable[[WindowSpec], Mapping[str, Column]],
    time: str = "time",
    ties: Sequence[str] = (),
    chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """``df`` and columns that look back over at most ``reach`` rows of the key, with one exchange of the rows.

    ``made`` gives the columns over a window that it is handed, which orders the
    rows; it may set a frame that reaches back ``reach`` rows. Keys are not
    NULL, and (keys, time) is unique unless ``ties`` names columns that order
    rows of equal time. Rows are dealt out by (keys, chunk). Behind the first
    ``reach`` rows of a chunk the window runs inside the chunk; those first rows
    are seen with the last rows of the chunks before them, which is a window
    over the key of at most 2 * ``reach`` rows per chunk. Both read the same
    exchange: they use the same columns of it, and filter only on what the
    window made.
    """
    keys, order, chunk = list(keys), [time, *ties], "__chunk"
    cut = df.withColumn(chunk, bin_micros(time, chunk_seconds)).repartition(*keys, chunk)
    in_chunk = Window.partitionBy(*keys, chunk).orderBy(*order)
    placed = cut.select(
        "*",
        F.row_number().over(in_chunk).alias("__at"),
        F.lead(F.lit(True), reach).over(in_chunk).isNull().alias("__last"),
        *[c.alias(name) for name, c in made(in_chunk).items()],
    )
    body = placed.filter(F.col("__at") > reach)
    edges = placed.filter((F.col("__at") <= reach) | F.col("__last"))
    along = Window.partitionBy(*keys).orderBy(chunk, *order)
    seams = edges.select(*cut.columns, "__at", *[c.alias(name) for name, c in made(along).items()]).filter(F.col("__at") <= reach)
    columns = [*df.columns, *made(in_chunk)]
    return body.select(*columns).unionByName(seams.select(*columns))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    time: str = "time",
    ties: Sequence[str] = (),
    chunk_seconds: float = CHUNK_SECONDS,
    prefix: str = "prev_",
) -> DataFrame:
    """Add ``prev_<value>``: the value of the key's preceding row (see ``over_rows_before``)."""
    return over_rows_before(df, keys, 1, lambda w: {f"{prefix}{v}": F.lag(v).over(w) for v in values}, time, ties, chunk_seconds)


def with_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column,
    name: str = "row_no",
) -> DataFrame:
    """Exact row number (from 1) within the key, computed chunk by chunk.

    ``chunk`` must not decrease along ``order``; chunk sizes are summed into an
    offset per chunk, so no task sees more than one chunk's rows.
    """
    keys = list(keys)
    cut = df.withColumn("__chunk", chunk)
    sizes = cut.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__chunk", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__off"))
    in_chunk = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    return (
        cut.withColumn("__rn", F.row_number().over(in_chunk))
        .join(offsets, [*keys, "__chunk"], "left")
        .select(*df.columns, (F.col("__off") + F.col("__rn")).cast("long").alias(name))
    )


def hash_order(*parts: str | Column, seed: int = 0) -> Column:
    """A repeatable random order: hex digest of the row's identity and a seed."""
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts], F.lit(str(seed))))


def hash_chunk(digest: str | Column, digits: int = 5) -> Column:
    """Leading digits of a digest: about ``16**digits`` equal chunks in digest order."""
    return F.substring(digest, 1, digits)


def latest_times(df: DataFrame, keys: Sequence[str], n: int, time: str = "time", chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """(keys, since): the earliest of each key's last ``n`` distinct times, for any ``n``.

    Times are counted per chunk; the newest chunks are summed up to the one that
    holds the n-th time, and only inside that chunk are times ranked. A key with
    fewer than ``n`` times gets its first time.
    """
    keys, chunk = list(keys), "__chunk"
    times = df.select(*keys, time).distinct().withColumn(chunk, bin_micros(time, chunk_seconds))
    sizes = times.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("__n"), F.min(time).alias("__min"))
    newest = Window.partitionBy(*keys).orderBy(F.desc(chunk))
    upto = sizes.withColumn("__newer", F.coalesce(F.sum("__n").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = upto.filter((F.col("__newer") < n) & (F.col("__newer") + F.col("__n") >= n)).select(*keys, chunk, "__newer")
    inside = Window.partitionBy(*keys, chunk).orderBy(F.desc(time))
    ranked = times.join(edge, [*keys, chunk]).withColumn("__rank", F.row_number().over(inside) + F.col("__newer"))
    cut = ranked.filter(F.col("__rank") == n).select(*keys, F.col(time).alias("since"))
    whole = sizes.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.min("__min").alias("since"))
    return cut.unionByName(whole.filter(F.col("__n") < n).select(*keys, "since"))
