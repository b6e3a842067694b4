"""Filters, routing, retention and lookups of messages and gestures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxweave import dims
from fluxweave.dims import DEV, PERF
from fluxweave.functions import scalars as sc
from fluxweave.operators.grids import densify, time_grid
from fluxweave.operators.ordering import CHUNK_SECONDS, latest_times
from fluxweave.operators.sides import with_side
from fluxweave.sources.formats import LogFormat


def message_kind(fmt: LogFormat, address: str = "address", tags: str = "tags") -> Column:
    """Kind of a client message by address and type tags; the first rule that fits wins."""
    a, t = F.col(address), F.col(tags)

    def at(path: str) -> Column:
        return F.contains(a, F.lit(fmt.address(path)))

    return (
        F.when(at("touch") & (t == "sfff"), "touch")
        .when(at("touch/ended") & (t == "s"), "touch/ended")
        .when(at("switch") & (t == "sss"), "switch")
        .when(at("online") & (t == "ss"), "online")
        .when(at("offline") & (t == "ss"), "offline")
        .when(at("acceleration") & (t == "sfff"), "accel")
        .when(at("app") & (t == "sss"), "app")
        .when(at("targetgesture"), "target")
        .otherwise("error")
    )


def route_messages(messages: DataFrame, fmt: LogFormat) -> DataFrame:
    return messages.withColumn("kind", message_kind(fmt))


def with_device_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """Device name from a (device_id, device_name) table, the id itself if unknown.

    The table's size is not known here, so the join strategy is left to Spark.
    """
    named = df.join(names.select(DEV, "device_name"), DEV, "left")
    return named.select(*df.columns, F.coalesce("device_name", DEV).alias("device_name"))


def with_seat(df: DataFrame, seats: Mapping[str, int] = dims.DEVICE_SEATS) -> DataFrame:
    """Seat of each device by a fixed table of a study; NULL for a device without a seat."""
    return df.withColumn("seat", sc.lookup(DEV, seats))


def gesture_report(gestures: DataFrame) -> DataFrame:
    """One readable ``device : name`` line per row."""
    return gestures.withColumn("line", F.concat_ws(" : ", DEV, sc.decode_gesture("gesture")))


def touch_kind_counts(touches: DataFrame) -> DataFrame:
    """Touch-downs (velocity 0) and movements per device."""
    return touches.groupBy(PERF, DEV).agg(
        F.count_if(F.col("velocity") == 0).alias("touchdowns"),
        F.count_if(F.col("velocity") != 0).alias("movements"),
    )


def between(df: DataFrame, lo: Column, hi: Column, time: str = "time") -> DataFrame:
    """Rows of an absolute time range, both ends included."""
    return df.filter(F.col(time).between(lo, hi))


def _newest(df: DataFrame) -> DataFrame:
    return df.groupBy(PERF).agg(F.max("time").alias("__asof"))


def retain_seconds(df: DataFrame, seconds: float, asof: Column | None = None) -> DataFrame:
    """Rows strictly newer than ``seconds`` before ``asof`` (default: each performance's last row)."""
    if asof is not None:
        return df.filter(F.col("time") > sc.shift(asof, -seconds))
    return with_side(df, _newest(df), [PERF]).filter(F.col("time") > sc.shift("__asof", -seconds)).drop("__asof")


def retain_ticks(df: DataFrame, ticks: int = dims.GESTURE_RETENTION_ROWS, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """The last ticks of each performance's gesture log, with the states of all its devices.

    An entry of the log is a tick: the rows of one time, however many devices play.
    """
    since = latest_times(df, [PERF], ticks, chunk_seconds=chunk_seconds)
    return with_side(df, since, [PERF]).filter(F.col("time") >= F.col("since")).drop("since")


def drop_bad_targets(df: DataFrame, target: str = "target") -> DataFrame:
    """Drop rows labelled as bad; a missing target stays."""
    return df.filter(~F.col(target).eqNullSafe(dims.BAD_TARGET))


def force_idle_target(df: DataFrame, target: str = "target") -> DataFrame:
    """No touches means state 0, whatever was asked for."""
    idle = F.col("centroid_x") == dims.NO_CENTROID
    return df.withColumn(target, F.when(idle, F.lit(0)).otherwise(F.col(target)))


def fill_vectors(df: DataFrame) -> DataFrame:
    """Missing features: -1 for a centroid, 0 for everything else."""
    return df.na.fill({c: dims.NO_CENTROID if c.startswith("centroid") else 0.0 for c in dims.FEATURE_COLUMNS})


def new_idea_events(events: DataFrame, event_type: str = "new_idea") -> DataFrame:
    return events.filter(F.col("event_type") == event_type)


def coded_transitions(transitions: DataFrame) -> DataFrame:
    return transitions.withColumn("state_code", sc.ensemble_state_code("transition_type"))


def with_elapsed(df: DataFrame, lead_in: float = 0.0) -> DataFrame:
    """Elapsed seconds and playback frame of each row of its performance."""
    first = df.groupBy(PERF).agg(F.min("time").alias("__first"))
    timed = with_side(df, first, [PERF]).withColumn("elapsed", sc.elapsed_seconds("time", "__first", lead_in))
    return timed.withColumn("frame", sc.playback_frame("elapsed")).drop("__first")


def colour_slots(df: DataFrame, slots: int = dims.COLOUR_SLOTS) -> DataFrame:
    """Slot of each device by order of first appearance, modulo the palette.

    The ranking runs over one row per device.
    """
    seen = df.groupBy(PERF, DEV).agg(F.min("time").alias("first_seen"))
    w = Window.partitionBy(PERF).orderBy("first_seen", DEV)
    return seen.withColumn("slot", F.pmod(F.row_number().over(w) - 1, F.lit(slots)))


def reachable_gestures(gestures: DataFrame, sources: DataFrame) -> DataFrame:
    """Gestures of devices that have an address to send to."""
    return gestures.join(sources, [PERF, DEV], "left_semi")


def gesture_grid(gestures: DataFrame, tick: float, fill: int | None = 0) -> DataFrame:
    """Every device of a performance at every tick; the tick's last gesture, else ``fill``.

    Devices and ticks meet by a join on the performance: one row per device
    against one row per tick, which is exactly the table asked for.
    """
    at_tick = gestures.groupBy(PERF, DEV, sc.bin_start("time", tick).alias("tick")).agg(
        F.max_by("gesture", "time").alias("gesture")
    )
    span = gestures.groupBy(PERF, DEV).agg(F.min("time").alias("a"), F.max("time").alias("b"))
    whole = span.groupBy(PERF).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    bounds = span.select(PERF, DEV).join(whole, PERF).select(
        PERF, DEV, sc.bin_start("a", tick).alias("lo"), sc.bin_start("b", tick).alias("hi")
    )
    grid = time_grid(bounds, [PERF, DEV], "lo", "hi", tick, "tick")
    return densify(at_tick, grid, [PERF, DEV, "tick"], {"gesture": fill}).withColumnRenamed("tick", "time")


def latest_apps(online: DataFrame) -> DataFrame:
    """The app each device came online with last."""
    return online.groupBy(PERF, DEV).agg(F.max_by("app_id", "time").alias("app_id"), F.max("time").alias("last_seen"))
