"""Regular time grids, and filling them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.functions.scalars import SECOND

STEPS_PER_CHUNK = 3600


def time_grid(
    bounds: DataFrame,
    keys: Sequence[str],
    lo: str,
    hi: str,
    step_seconds: float,
    name: str = "time",
) -> DataFrame:
    """One row per key and step from ``lo`` to ``hi``, both included.

    The span is cut into chunks first and the chunks are spread over the
    cluster, so a single long key does not expand inside one task.
    """
    keys = list(keys)
    step = int(step_seconds * SECOND)
    block = step * STEPS_PER_CHUNK
    us = bounds.select(*keys, F.unix_micros(lo).alias("__lo"), F.unix_micros(hi).alias("__hi"))
    # a fixed number, because adaptive execution would merge these tiny rows into one task
    tasks = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = us.select(
        *keys, "__hi", F.explode(F.sequence("__lo", "__hi", F.lit(block).cast("long"))).alias("__c")
    ).repartition(tasks, *keys, "__c")
    stop = F.least(F.col("__hi"), F.col("__c") + F.lit(block - step).cast("long"))
    steps = chunks.select(*keys, F.explode(F.sequence("__c", stop, F.lit(step).cast("long"))).alias("__us"))
    return steps.select(*keys, F.timestamp_micros("__us").alias(name))


def densify(
    values: DataFrame,
    grid: DataFrame,
    keys: Sequence[str],
    fills: dict[str, object],
) -> DataFrame:
    """Grid rows with the values that exist there and ``fills`` elsewhere.

    Values off the grid are dropped. ``values`` must be unique on ``keys``.
    """
    joined = grid.join(values.select(*keys, *fills), list(keys), "left")
    return joined.select(
        *grid.columns,
        *[(F.coalesce(c, F.lit(f)) if f is not None else F.col(c)).alias(c) for c, f in fills.items()],
    )
