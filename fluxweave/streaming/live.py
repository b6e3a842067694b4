"""Live analysis with Structured Streaming.

Every stage is a streaming DataFrame; stages that follow a stateful one may be
chained through tables in the shared folder, so a lost executor or a restart
only replays from the last checkpoint.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluxweave.dims import (
    DEV,
    FEATURE_SECONDS,
    FLUX_SECONDS,
    GESTURE_RETENTION_ROWS,
    GESTURE_RETENTION_SECONDS,
    NEW_IDEA_LIVE,
    PERF,
    TICK_SECONDS,
)
from fluxweave.functions import matrix as mx
from fluxweave.operators import transitions as tr
from fluxweave.operators.features import vector_columns
from fluxweave.operators.messages import route_messages
from fluxweave.operators.ordering import CHUNK_SECONDS
from fluxweave.operators.sides import with_side
from fluxweave.session import shared_folder
from fluxweave.sources.formats import DEFAULT_FORMAT, LogFormat

DELAY = "10 seconds"
FORGET_SECONDS = 3600  # after which a performance's live view is dropped


# the devices of a performance are dealt to this many states: a call of Python for each device costs more than its rows
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64(DEV), F.lit(BUCKETS)).cast("int")


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _span(seconds: float) -> str:
    """Seconds, whole or not, as an interval."""
    return f"{round(seconds * 1_000_000)} microseconds"


def message_stream(
    spark: SparkSession,
    path: str,
    schema: str,
    glob: str | None = None,
    files: int | None = None,
    size: str | None = None,
) -> DataFrame:
    """Messages arriving as parquet files in a folder.

    ``files`` or ``size`` bound a micro-batch, and with it what one task sorts
    for a single busy device.
    """
    options = {"pathGlobFilter": glob, "maxFilesPerTrigger": files, "maxBytesPerTrigger": size}
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, value)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, name: str, partition_by: str | None = None, path: str | None = None) -> str:
    """Run a stream over all that is available into a parquet table; returns its path."""
    path = path or shared_folder(stream.sparkSession, name)
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/_state")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.format("parquet").trigger(availableNow=True).start(f"{path}/data").awaitTermination()
    return f"{path}/data"


def live_features(
    touches: DataFrame, width: float = FEATURE_SECONDS, slide: float = TICK_SECONDS, delay: str = DELAY
) -> DataFrame:
    """Vector per device over a window that slides by one tick."""
    window = F.window("time", _span(width), _span(slide))
    grouped = touches.withWatermark("time", delay).groupBy(PERF, DEV, window)
    return grouped.agg(*vector_columns("moving")).withColumn("time", F.col("window.end"))


def leaving(messages: DataFrame) -> DataFrame:
    """When devices leave: the offline messages of a routed stream (or table), for ``fill_idle``."""
    return messages.filter(F.col("kind") == "offline").select(PERF, DEV, "time")


def fill_idle(predicted: DataFrame, tick: float = TICK_SECONDS, offline: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """A state for every active device at every tick: the prediction, else 0, up to the watermark.

    A device is active from its first prediction on, silent or not, until it
    leaves, and again from its next prediction. ``offline`` (performance,
    device, time) says when devices leave. As a stream it joins the predictions
    in one stream of events with a state of every device, so a device may leave at
    any time after its last prediction, or before its last ones have come; as a
    table it tells what is known when a device's predictions come. Ticks come
    from the watermark, which the predictions alone move: a device that has
    fallen silent gets its zeros when the stream's time moves on. What was given
    out before an offline message came stays. ``predicted`` holds one row per
    device and tick, so one device is a row each tick, whatever it plays. A
    prediction older than the watermark is dropped.
    """
    step, block = round(tick * 1_000_000), 100_000
    rows = predicted.select(PERF, DEV, "time", F.col("prediction").cast("int").alias("gesture"))
    if offline is None:
        rows = rows.withColumn("stops", F.array().cast("array<long>"))
    elif offline.isStreaming:
        # without a time of its own such a row is never late and moves no watermark
        left = offline.select(PERF, DEV, F.lit(None).cast("timestamp").alias("time"), F.lit(None).cast("int").alias("gesture"), F.array(F.unix_micros("time")).alias("stops"))
        rows = rows.withColumn("stops", F.array().cast("array<long>")).unionByName(left)
    else:
        stops = offline.groupBy(PERF, DEV).agg(F.collect_set(F.unix_micros("time")).alias("stops"))
        rows = rows.join(stops, [PERF, DEV], "left").withColumn("stops", F.coalesce("stops", F.array().cast("array<long>")))

    def ticks(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto = state.getCurrentWatermarkMs() * 1000
        # of every device: the next tick to give out (None while inactive), the last one heard, when the device leaves
        kept = {d: (f, h, list(g)) for d, f, h, g in zip(*state.get)} if state.exists else {}
        given: dict[str | None, dict[int, int]] = {}
        for part in batches:
            for device, stops in zip(part[DEV], part["stops"]):
                if len(stops):
                    device = _text(device)
                    following, heard, gone = kept.get(device, (None, None, []))
                    kept[device] = following, heard, sorted({*gone, *map(int, stops)})
            part = part[part["time"].notna()]
            micros = part["time"].to_numpy().astype("datetime64[us]").astype("int64")
            for device, at, gesture in zip(part[DEV], micros.tolist(), part["gesture"].astype("int64").tolist()):
                given.setdefault(_text(device), {})[at] = gesture
        after: dict[str | None, tuple] = {}

        def states(device: str | None) -> Iterator[tuple[str | None, int, int]]:
            following, heard, gone = kept.get(device, (None, None, []))

            def idle(last: int) -> Iterator[tuple[str | None, int, int]]:
                """Zeros up to ``last``, or to when the device leaves."""
                nonlocal following
                leaves = next((t for t in gone if t >= heard), None)
                end = last if leaves is None else min(last, leaves)
                while following <= end:
                    yield device, following, 0
                    following += step
                if leaves is not None and last > leaves:
                    following = None

            mine = given.get(device, {})
            for at in sorted(mine):
                if following is not None:
                    yield from idle(at - step)
                if following is None or at >= following:
                    yield device, at, mine[at]
                    following, heard = at + step, at
            if following is not None:
                yield from idle(upto)
            # an active device needs what lies behind its last prediction, another what the watermark has not passed
            gone = [t for t in gone if t >= (upto if following is None else heard)]
            if following is not None or gone:
                after[device] = following, heard, gone

        every = itertools.chain.from_iterable(states(device) for device in {**kept, **given})
        while some := list(itertools.islice(every, block)):
            yield pd.DataFrame({PERF: key[0], DEV: [d for d, _, _ in some], "time": pd.to_datetime([t for _, t, _ in some], unit="us"), "gesture": [g for _, _, g in some]})
        if not after:
            if state.exists:
                state.remove()
            return
        state.update((list(after), *map(list, zip(*after.values()))))
        # a time-out needs a watermark beyond it, a tick one that has reached it
        first = min(gone[-1] if following is None else following for following, _, gone in after.values())
        state.setTimeoutTimestamp(max(first // 1000 - 1, upto // 1000))

    key = rows.schema[PERF].dataType.simpleString()
    return rows.withWatermark("time", delay).withColumn("bucket", _bucket()).groupBy(PERF, "bucket").applyInPandasWithState(
        ticks,
        f"{PERF} {key}, {DEV} string, time timestamp, gesture int",
        "devices array<string>, following array<long>, heard array<long>, gone array<array<long>>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def live_recent(log: DataFrame, ticks: int = GESTURE_RETENTION_ROWS, seconds: float = GESTURE_RETENTION_SECONDS, delay: str = DELAY, forget: float = FORGET_SECONDS) -> DataFrame:
    """What a live view shows of a gesture log: each performance's last ``ticks`` ticks, of these the last ``seconds``.

    The state is a ring of those rows, whatever the length of the performance,
    and is dropped once the watermark is ``forget`` seconds past them. With
    every batch a performance's whole view comes out with ``upto``, its newest
    time; the rows with the greatest one are the view (``current_view``).
    """
    keep = round(seconds * 1_000_000)

    def view(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.DataFrame(dict(zip(("time", DEV, "gesture"), state.get if state.exists else ([], [], []))))
        for part in batches:
            micros = part["time"].to_numpy().astype("datetime64[us]").astype("int64")
            fresh = pd.DataFrame({"time": micros, DEV: part[DEV].to_numpy(), "gesture": part["gesture"].to_numpy()})
            rows = pd.concat([rows, fresh]) if len(rows) else fresh
            times = rows["time"].drop_duplicates().nlargest(ticks)
            rows = rows[(rows["time"] >= times.min()) & (rows["time"] > times.max() - keep)]
        newest = int(rows["time"].max())
        state.update((rows["time"].tolist(), rows[DEV].tolist(), [None if pd.isna(g) else int(g) for g in rows["gesture"]]))
        state.setTimeoutTimestamp(max(newest // 1000 + round(forget * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({PERF: key[0], "upto": pd.to_datetime(newest, unit="us"), DEV: rows[DEV].to_numpy(), "time": pd.to_datetime(rows["time"], unit="us").to_numpy(), "gesture": rows["gesture"].to_numpy()})

    key = log.schema[PERF].dataType.simpleString()
    rows = log.select(PERF, DEV, "time", F.col("gesture").cast("int").alias("gesture")).withWatermark("time", delay)
    return rows.groupBy(PERF).applyInPandasWithState(
        view,
        f"{PERF} {key}, upto timestamp, {DEV} string, time timestamp, gesture int",
        "times array<long>, devices array<string>, gestures array<int>",
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )


def current_view(spark: SparkSession, path: str) -> DataFrame:
    """Each performance's newest view among what ``run_updates`` has written of ``live_recent``."""
    batches = spark.read.parquet(path)  # with the number of the batch as a column
    newest = batches.groupBy(PERF).agg(F.max("batch").alias("batch"))
    return with_side(batches, newest, [PERF, "batch"], "left_semi").select(PERF, DEV, "time", "gesture")


def live_chunks(gestures: DataFrame, states: str = "group", gesture: str = "gesture", chunk: float = CHUNK_SECONDS, delay: str = DELAY) -> DataFrame:
    """A device's rows of one chunk of time, in order, once the watermark has passed the chunk.

    Rows may come in any order within ``delay``; later ones are dropped. A chunk
    holds what a device sends in ``chunk`` seconds, so a busy device is many tasks.
    """
    state = F.coalesce(tr.map_state(states, gesture).cast("int"), F.lit(-1)).alias("state")
    rows = gestures.select(PERF, DEV, "time", state).withWatermark("time", delay)
    grouped = rows.groupBy(PERF, DEV, F.window("time", _span(chunk)).alias("chunk"))
    return grouped.agg(F.sort_array(F.collect_list(F.struct("time", "state"))).alias("rows")).select(
        PERF, DEV, F.col("chunk.start").alias("chunk"), "rows"
    )


def _pairs(to: str, before: str) -> list[Column]:
    both = (F.col(to) >= 0) & (F.col(before) >= 0)
    return [F.when(both, F.col(to)).alias(mx.TO), F.when(both, F.col(before)).alias(mx.FROM)]


def inner_steps(chunks: DataFrame) -> DataFrame:
    """State pairs of all rows but the first of each chunk; nothing is kept between chunks."""
    each = F.transform(
        F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))),
        lambda r, i: F.struct(r["time"].alias("time"), r["state"].alias("to"), F.col("rows")[i]["state"].alias("before")),
    )
    rows = chunks.select(PERF, DEV, F.explode(each).alias("r"))
    return rows.select(PERF, DEV, F.col("r.time").alias("time"), F.col("r.to").alias("__to"), F.col("r.before").alias("__before")).select(
        PERF, DEV, "time", *_pairs("__to", "__before")
    )


def first_steps(chunks: DataFrame) -> DataFrame:
    """The pair of each chunk's first row with the last row of the device's chunk before; that row's state is kept.

    One short row per device and chunk reaches the stateful part. Read a chunk
    table without a file limit: a batch then holds whole batches of the stream
    that wrote it, and those follow each other in time.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("chunk")
        devices, before = [_text(d) for d in rows[DEV]], []
        last = dict(zip(*state.get)) if state.exists else {}
        for device, left in zip(devices, rows["last_state"].tolist()):
            before.append(last.get(device, -1))
            last[device] = left
        state.update((list(last), list(last.values())))
        yield pd.DataFrame({PERF: key[0], DEV: devices, "time": rows["time"].to_numpy(), "__to": rows["first_state"].to_numpy(), "__before": before})

    light = chunks.select(
        PERF, DEV, "chunk", F.col("rows")[0]["time"].alias("time"), F.col("rows")[0]["state"].alias("first_state"), F.element_at("rows", -1)["state"].alias("last_state")
    )
    key = chunks.schema[PERF].dataType.simpleString()
    paired = light.withColumn("bucket", _bucket()).groupBy(PERF, "bucket").applyInPandasWithState(
        step, f"{PERF} {key}, {DEV} string, time timestamp, __to int, __before int", "devices array<string>, states array<int>", "append", GroupStateTimeout.NoTimeout
    )
    return paired.select(PERF, DEV, "time", *_pairs("__to", "__before"))


def write_steps(
    gestures: DataFrame, name: str, path: str | None = None, states: str = "group", chunk: float = CHUNK_SECONDS, delay: str = DELAY
) -> str:
    """State pairs of a gesture stream, in the folders under the returned path; read it as ``{path}/*/data``.

    Rows in any order within ``delay`` give what the ordered table gives; rows
    of chunks that are not closed yet wait in the state.
    """
    spark = gestures.sparkSession
    path = path or shared_folder(spark, name)
    chunks = run_to_table(live_chunks(gestures, states, chunk=chunk, delay=delay), name, path=f"{path}-chunks")
    key = gestures.schema[PERF].dataType.simpleString()
    schema = f"{PERF} {key}, {DEV} string, chunk timestamp, rows array<struct<time: timestamp, state: int>>"
    run_to_table(inner_steps(message_stream(spark, chunks, schema)), name, path=f"{path}/inner")
    run_to_table(first_steps(message_stream(spark, chunks, schema)), name, path=f"{path}/first")
    return path


def live_cells(steps: DataFrame, width: float = FLUX_SECONDS, delay: str = DELAY) -> DataFrame:
    """Transition cells per performance and tumbling window."""
    window = F.window("time", _span(width))
    grouped = steps.withWatermark("time", delay).groupBy(PERF, window, mx.TO, mx.FROM)
    return grouped.agg(F.count(mx.TO).alias(mx.N))


def live_flux(steps: DataFrame, width: float = FLUX_SECONDS, delay: str = DELAY) -> DataFrame:
    """Flux of each closed window of the ensemble."""
    window = F.window("time", _span(width))
    grouped = steps.withWatermark("time", delay).groupBy(PERF, window)
    pairs, moved = F.count(mx.TO), F.count_if(F.col(mx.TO) != F.col(mx.FROM))
    return grouped.agg(mx.ratio_or(moved, pairs, 0.0).alias("flux")).select(
        PERF, F.col("window.start").alias("time"), "flux"
    )


def live_state(steps: DataFrame, width: float = FLUX_SECONDS, delay: str = DELAY) -> DataFrame:
    """Ensemble state of each closed window (two aggregations in a row)."""
    return tr.ensemble_state(live_cells(steps, width, delay), [PERF, "window"])


def live_new_ideas(flux: DataFrame, threshold: float = NEW_IDEA_LIVE, delay: str = "0 seconds") -> DataFrame:
    """Windows whose flux rose above the threshold over the window before.

    Windows wait in the state until the watermark has passed them and are then
    compared in order of time, so neither batch boundaries nor windows that come
    late within ``delay`` change what a window is compared with. A table that
    another stream has written is read without a file limit, or with a delay that
    covers one of that stream's batches: its files are in no order of time.
    """

    def rise(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, times, values = state.get if state.exists else (None, [], [])
        waiting = dict(zip(times, values))
        for rows in batches:
            micros = rows["time"].to_numpy().astype("datetime64[us]").astype("int64")
            waiting.update(zip(micros.tolist(), rows["flux"].tolist()))
        upto = state.getCurrentWatermarkMs() * 1000
        risen: list[tuple[int, float]] = []
        for at in sorted(t for t in waiting if t <= upto):
            value = waiting.pop(at)
            if before is not None and value - before > threshold:
                risen.append((at, value))
            before = value
        left = sorted(waiting)
        state.update((before, left, [waiting[t] for t in left]))
        if left:
            state.setTimeoutTimestamp(max(left[0] // 1000 - 1, upto // 1000))
        yield pd.DataFrame({PERF: key[0], "time": pd.to_datetime([t for t, _ in risen], unit="us"), "flux": [v for _, v in risen]})

    key = flux.schema[PERF].dataType.simpleString()
    return flux.withWatermark("time", delay).groupBy(PERF).applyInPandasWithState(
        rise,
        f"{PERF} {key}, time timestamp, flux double",
        "before double, times array<long>, fluxes array<double>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def live_routes(messages: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    """Messages with their kind; write it partitioned by kind for one table per kind."""
    return route_messages(messages, fmt)


def live_sources(messages: DataFrame) -> DataFrame:
    """Per device: when it was last heard, its latest app, and whether it is online."""
    app = F.when(F.col("kind") == "online", F.col("app_id"))
    when = F.when(F.col("kind") == "online", F.col("time"))
    return messages.groupBy(PERF, DEV).agg(
        F.max("time").alias("last_seen"),
        F.max_by(app, when).alias("app_id"),
        (F.max_by("kind", "time") != "offline").alias("is_online"),
    )


def run_updates(stream: DataFrame, name: str, path: str | None = None) -> str:
    """Run an aggregate in update mode; each batch's changed rows go to one folder, overwritten on a replay.

    Called again with the same ``path`` it goes on where it stopped.
    """
    path = path or shared_folder(stream.sparkSession, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    query = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/_state")
    query.trigger(availableNow=True).start().awaitTermination()
    return f"{path}/data"


def live_sessions(touches: DataFrame, gap: float, delay: str = DELAY) -> DataFrame:
    """A device's stretch of activity; it ends when the device is silent for ``gap`` seconds."""
    session = F.session_window("time", _span(gap))
    grouped = touches.withWatermark("time", delay).groupBy(PERF, DEV, session.alias("session"))
    return grouped.agg(F.count(F.lit(1)).alias("touches")).select(
        PERF, DEV, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "touches"
    )
