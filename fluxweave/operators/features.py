"""Feature vectors of touches: tumbling, rolling and whole-session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxweave.dims import DEV, FEATURE_COLUMNS, FEATURE_SECONDS, NO_CENTROID, PERF, TICK_SECONDS
from fluxweave.functions.scalars import SECOND, bin_start
from fluxweave.operators.grids import time_grid

_KEYS = [PERF, DEV]


def vector_columns(movement: str = "moving") -> list[Column]:
    """Aggregates of one feature vector, empty groups filled.

    ``movement='all'`` counts every touch as movement (tumbling frames),
    ``'moving'`` only touches with a velocity other than 0 (rolling frames).
    Rows with a NULL ``x_pos`` and ``velocity`` add nothing, so grid rows can
    be aggregated together with touches.
    """
    touch = F.count("x_pos")
    moving = touch if movement == "all" else F.count_if(F.col("velocity") != 0)
    return [
        F.coalesce(F.avg("x_pos"), F.lit(NO_CENTROID)).alias("centroid_x"),
        F.coalesce(F.avg("y_pos"), F.lit(NO_CENTROID)).alias("centroid_y"),
        F.coalesce(F.stddev_samp("x_pos"), F.lit(0.0)).alias("std_x"),
        F.coalesce(F.stddev_samp("y_pos"), F.lit(0.0)).alias("std_y"),
        touch.alias("freq"),
        moving.alias("movement_freq"),
        F.count_if(F.col("velocity") == 0).alias("touchdown_freq"),
        F.coalesce(F.avg("velocity"), F.lit(0.0)).alias("velocity"),
    ]


def _bounds(touches: DataFrame, width: float) -> DataFrame:
    """First and last bin start of every device."""
    span = touches.groupBy(*_KEYS).agg(F.min("time").alias("first"), F.max("time").alias("last"))
    return span.select(*_KEYS, bin_start("first", width).alias("lo"), bin_start("last", width).alias("hi"))


def _with_empty(hits: DataFrame, grid: DataFrame, movement: str) -> DataFrame:
    """Aggregate touches per tick; grid rows join in as empty rows.

    Union instead of a join: one shuffle gives both the vectors and the empty
    ticks, and ticks off the grid are dropped by their missing grid row.
    """
    empty = grid.select(
        *_KEYS,
        "time",
        *[F.lit(None).cast("double").alias(c) for c in ("x_pos", "y_pos", "velocity")],
        F.lit(1).alias("__grid"),
    )
    both = hits.withColumn("__grid", F.lit(0)).unionByName(empty)
    out = both.groupBy(*_KEYS, "time").agg(*vector_columns(movement), F.max("__grid").alias("__grid"))
    return out.filter("__grid = 1").drop("__grid")


def tumbling_features(
    touches: DataFrame, width: float = FEATURE_SECONDS, movement: str = "all", fill_gaps: bool = True
) -> DataFrame:
    """One vector per device and epoch-aligned bin, empty bins included."""
    hits = touches.select(*_KEYS, bin_start("time", width).alias("time"), "x_pos", "y_pos", "velocity")
    if not fill_gaps:
        return hits.groupBy(*_KEYS, "time").agg(*vector_columns(movement))
    return _with_empty(hits, time_grid(_bounds(touches, width), _KEYS, "lo", "hi", width), movement)


def rolling_features(
    touches: DataFrame,
    width: float = FEATURE_SECONDS,
    tick: float = TICK_SECONDS,
    movement: str = "moving",
) -> DataFrame:
    """One vector per device and tick over ``[tick - width, tick]``, both ends included.

    Each touch is sent to the few ticks that can see it and the ticks are then
    aggregated: the repetition is combined map-side, so a touch is never
    compared with ticks it does not belong to. Ticks run from the device's first
    to its last bin start.
    """
    step, span = int(tick * SECOND), int(width * SECOND)
    us = F.unix_micros("time")
    first = us + F.pmod(-us, F.lit(step).cast("long"))
    ticks = F.when(first <= us + span, F.sequence(first, us + span, F.lit(step).cast("long")))
    seen = touches.select(*_KEYS, F.explode(ticks).alias("__us"), "x_pos", "y_pos", "velocity")
    hits = seen.select(*_KEYS, F.timestamp_micros("__us").alias("time"), "x_pos", "y_pos", "velocity")
    return _with_empty(hits, time_grid(_bounds(touches, width), _KEYS, "lo", "hi", tick), movement)


def whole_features(touches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One vector over all rows of each frame."""
    return touches.groupBy(*(keys or _KEYS)).agg(*vector_columns("moving"))


def plain_features(touches: DataFrame, width: float = FEATURE_SECONDS) -> DataFrame:
    """The older vector: no spread columns."""
    return tumbling_features(touches, width, "all").drop("std_x", "std_y")


def last_features(features: DataFrame) -> DataFrame:
    """Only the latest vector of each device."""
    # one max_by per plain column stays on the hash-aggregate path
    latest = [F.max_by(c, "time").alias(c) for c in FEATURE_COLUMNS]
    return features.groupBy(*_KEYS).agg(F.max("time").alias("time"), *latest)


def activity(touches: DataFrame, width: float, by_device: bool = True) -> DataFrame:
    """Touches per tick, with 0 where there are none."""
    keys = _KEYS if by_device else [PERF]
    span = touches.groupBy(*keys).agg(F.min("time").alias("first"), F.max("time").alias("last"))
    bounds = span.select(*keys, bin_start("first", width).alias("lo"), bin_start("last", width).alias("hi"))
    grid = time_grid(bounds, keys, "lo", "hi", width).withColumn("hit", F.lit(0))
    hits = touches.select(*keys, bin_start("time", width).alias("time"), F.lit(1).alias("hit"))
    return hits.unionByName(grid).groupBy(*keys, "time").agg(F.sum("hit").alias("touches"))


def touches_per_device(touches: DataFrame) -> DataFrame:
    return touches.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("touches")).orderBy(F.desc("touches"), *_KEYS)


def resample(df: DataFrame, keys: list[str], value: str, width: float, how: str) -> DataFrame:
    """Value per bin: the largest ('max') or the earliest non-null ('first')."""
    binned = df.select(*keys, "time", bin_start("time", width).alias("bin"), value)
    if how == "max":
        picked = F.max(value)
    else:
        picked = F.min_by(value, F.when(F.col(value).isNotNull(), F.col("time")))
    return binned.groupBy(*keys, "bin").agg(picked.alias(value)).withColumnRenamed("bin", "time")
