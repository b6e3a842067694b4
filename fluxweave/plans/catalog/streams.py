"""Streaming queries: the event table arrives as a stream of files.

The table is cut into BATCHES batches by arrival: a row arrives up to the delay
after its time, by its id, so that rows of a batch are in no order and overlap
those of the next. A batch is as many files as its rows need. A stream closes a window once the
watermark (newest row minus the delay) has passed its end, so the SQL checks
keep exactly those windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxweave.dims import DEV, FEATURE_COLUMNS, PERF
from fluxweave.operators import learning as ln
from fluxweave.plans import testviews as tv
from fluxweave.plans.catalog.base import iso, iso_sql, query, rounded, rounded_sql
from fluxweave.plans.catalog.files import raw_messages
from fluxweave.plans.catalog.matrices import FLUX, RISES, STEPS5, WINDOW5, state_sql
from fluxweave.plans.catalog.vectors import VECTOR_SQL, shown, shown_sql, tumbling
from fluxweave.plans.testviews import DAY, TICK, VECTOR, WIDTH, bin_sql, with_sql
from fluxweave.session import path_exists, shared_folder
from fluxweave.streaming import live

EVENTS_DDL = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"
DELAY_SECONDS = 3600
DELAY = f"{DELAY_SECONDS} seconds"
# the watermark has millisecond precision
WATERMARK = f"(SELECT date_trunc('millisecond', max(time)) - INTERVAL {DELAY_SECONDS} SECOND FROM ev)"


BATCHES = 4
FILE_ROWS = 250_000


def arriving(spark, d, late=None):
    """The event table as files in order of arrival, and how many files are one batch; rows that ``late`` picks come in a batch of their own at the end."""
    wait = F.col("event_id") * 7919 % DELAY_SECONDS * 1_000_000
    rows = tv.table(spark, d, "events").withColumn("arrival", F.unix_micros(F.col("ts").cast("timestamp")) + wait)
    lo, hi, n = rows.agg(F.min("arrival"), F.max("arrival"), F.count(F.lit(1))).first()
    part = F.least(F.expr(f"(arrival - {lo}) * {BATCHES} div {max(hi - lo, 1)}"), F.lit(BATCHES - 1))
    if late is not None:
        part = F.when(late, BATCHES).otherwise(part)
    path, files = shared_folder(spark, "arriving"), max(1, -(-n // (BATCHES * FILE_ROWS)))
    for k in range(BATCHES + (late is not None)):
        write_batch(rows.filter(part == k).drop("arrival"), path, files)
    return path, files


def write_batch(rows, path, files):
    """Rows as exactly ``files`` files, written side by side; where there are too few rows the rest are empty."""
    spread = rows.coalesce(1) if files == 1 else rows.repartition(files)
    before = len(rows.sparkSession.read.schema(EVENTS_DDL).parquet(path).inputFiles()) if path_exists(rows.sparkSession, path) else 0
    spread.write.mode("append").parquet(path)
    for _ in range(before + files - len(rows.sparkSession.read.schema(EVENTS_DDL).parquet(path).inputFiles())):
        rows.limit(0).coalesce(1).write.mode("append").parquet(path)


def event_stream(spark, d, late=None, batched=True):
    path, files = arriving(spark, d, late)
    raw = live.message_stream(spark, path, EVENTS_DDL, files=files if batched else None)
    return raw.select(
        "event_id",
        (F.col("user_id") % 10).alias(PERF),
        F.col("ts").cast("timestamp").alias("time"),
        F.col("user_id").cast("string").alias(DEV),
        "event_type",
        "value",
    )


def touch_stream(spark, d):
    return event_stream(spark, d).select(
        PERF,
        "time",
        DEV,
        (F.col("event_id") * 37 % 1024).cast("double").alias("x_pos"),
        (F.col("event_id") * 53 % 768).cast("double").alias("y_pos"),
        F.when(F.col("event_id") % 4 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("velocity"),
    )


def gesture_stream(spark, d):
    return event_stream(spark, d).select(PERF, "time", DEV, (F.floor("value").cast("int") % 11).alias("gesture"))


SLIDING = f"""SELECT performance_id, device_id, make_timestamp(b + {VECTOR * 1_000_000}) AS time, {VECTOR_SQL.format(moving='velocity <> 0')} FROM
    (SELECT *, unnest(range(epoch_us(time) - epoch_us(time) % {TICK * 1_000_000} - {(VECTOR - TICK) * 1_000_000},
     epoch_us(time) + 1, {TICK * 1_000_000})) AS b FROM touches) GROUP BY 1, 2, 3"""


@query(
    "stream_features",
    with_sql(
        f"SELECT performance_id, device_id, {iso_sql('time')}, {shown_sql()} FROM vectors WHERE time <= {WATERMARK}",
        "touches",
        vectors=SLIDING,
    ),
)
def stream_features(spark, d):
    vectors = live.live_features(touch_stream(spark, d), VECTOR, TICK, DELAY).drop("window")
    path = live.run_to_table(vectors, "live-features")
    return spark.read.parquet(path).select(PERF, DEV, iso("time"), *shown())


@query(
    "stream_gesture_log",
    with_sql(
        f"""SELECT performance_id, device_id, CAST((epoch_us((SELECT max(time) FROM closed)) - epoch_us(min(time))) // {TICK * 1_000_000} + 1 AS BIGINT) AS ticks,
        CAST(0 AS BIGINT) AS outside, count(*) AS heard FROM closed GROUP BY 1, 2""",
        "touches",
        closed=f"SELECT * FROM ({SLIDING}) WHERE time <= {WATERMARK}",
    ),
)
def stream_gesture_log(spark, d):
    """Stream to vectors to states: every device has a state in range at every tick from its first one on."""
    log = gesture_log(spark, d)
    return log.groupBy(PERF, DEV).agg(
        F.count(F.lit(1)).alias("ticks"), F.count_if(~F.col("gesture").between(0, 8)).alias("outside"), F.sum("heard").alias("heard")
    )


def gesture_log(spark, d):
    """The live log, with ``heard`` 1 where a tick has a vector."""
    train = tumbling(spark, d).withColumn("gesture", F.col("freq") % 9)
    model = ln.train_forest(train, FEATURE_COLUMNS)
    vectors = live.live_features(touch_stream(spark, d), VECTOR, TICK, DELAY).drop("window")
    predicted = live.run_to_table(ln.classify(model, vectors).select(PERF, DEV, "time", "prediction"), "live-predictions")
    schema = f"{PERF} long, {DEV} string, time timestamp, prediction int"
    path = live.run_to_table(live.fill_idle(live.message_stream(spark, predicted, schema), TICK), "live-gestures")
    heard = spark.read.parquet(predicted).select(PERF, DEV, "time", F.lit(1).alias("heard"))
    return spark.read.parquet(path).join(heard, [PERF, DEV, "time"], "left")


LEFT = f"""SELECT h.*, lead(time) OVER (PARTITION BY performance_id, device_id ORDER BY time) AS following,
    (SELECT min(e.time) FROM ev e WHERE e.event_type = 'error' AND e.performance_id = h.performance_id AND e.device_id = h.device_id AND e.time >= h.time) AS leaves
    FROM closed h"""


@query(
    "stream_devices_leave",
    with_sql(
        f"""SELECT performance_id, device_id, {iso_sql('time')}, CAST(gesture AS INT) AS gesture FROM (
          SELECT performance_id, device_id, time, freq % 9 AS gesture FROM closed UNION ALL
          SELECT performance_id, device_id, unnest(generate_series(time + INTERVAL {TICK} SECOND, least(coalesce(following - INTERVAL {TICK} SECOND, last), coalesce(leaves, last), last), INTERVAL {TICK} SECOND)) AS time, 0 AS gesture
          FROM left_at, (SELECT max(time) AS last FROM closed))""",
        "touches",
        closed=f"SELECT * FROM ({SLIDING}) WHERE time <= {WATERMARK}",
        left_at=LEFT,
    ),
)
def stream_devices_leave(spark, d):
    """Predictions and offline messages as one stream of events: a device is idle up to when it leaves, also after its last vector."""
    vectors = live.live_features(touch_stream(spark, d), VECTOR, TICK, DELAY).drop("window")
    guess = (F.col("freq") % 9).cast("int").alias("prediction")  # stands for a model's
    predicted = live.run_to_table(vectors.select(PERF, DEV, "time", guess), "live-guesses")
    kind = F.when(F.col("event_type") == "error", "offline").otherwise("touch")
    # all that has arrived is one batch, so every departure is known when the ticks come
    messages = event_stream(spark, d, batched=False).select(PERF, DEV, "time", kind.alias("kind"))
    guesses = live.message_stream(spark, predicted, f"{PERF} long, {DEV} string, time timestamp, prediction int")
    path = live.run_to_table(live.fill_idle(guesses, TICK, live.leaving(messages)), "live-log")
    return spark.read.parquet(path).select(PERF, DEV, iso("time"), "gesture")


VIEW_TICKS, VIEW_SECONDS = 12, 3 * DAY  # stand for 300 ticks and 60 s


@query(
    "stream_recent_log",
    with_sql(
        f"""SELECT performance_id, device_id, {iso_sql('time')}, gesture FROM
        (SELECT *, max(time) OVER (PARTITION BY performance_id) AS newest, dense_rank() OVER (PARTITION BY performance_id ORDER BY gestures.time DESC) AS tick FROM gestures)
        WHERE tick <= {VIEW_TICKS} AND time > newest - INTERVAL {VIEW_SECONDS} SECOND""",
        "gestures",
    ),
)
def stream_recent_log(spark, d):
    """The bounded live view after the last batch."""
    view = live.live_recent(gesture_stream(spark, d), VIEW_TICKS, VIEW_SECONDS, DELAY)
    return live.current_view(spark, live.run_updates(view, "live-view")).select(PERF, DEV, iso("time"), "gesture")


CHUNK_SQL = f"{bin_sql('time', WIDTH)} + INTERVAL {WIDTH} SECOND"
ARRIVED = f"SELECT * FROM ({STEPS5}) WHERE {CHUNK_SQL} <= {WATERMARK}"  # steps of closed chunks


@query(
    "stream_transition_steps_unordered",
    with_sql(
        f"SELECT performance_id, device_id, {iso_sql('time')}, coalesce(to_state, -1) AS to_state, coalesce(from_state, -1) AS from_state FROM steps",
        "gestures",
        steps=ARRIVED,
    ),
)
def stream_transition_steps_unordered(spark, d):
    """Rows out of order within the delay give the steps of the ordered table."""
    return shown_steps(spark.read.parquet(f"{step_table(spark, d)}/*/data"))


@query(
    "stream_transition_steps",
    with_sql(
        """SELECT performance_id, coalesce(to_state, -1) AS to_state, coalesce(from_state, -1) AS from_state, count(*) AS n FROM steps GROUP BY ALL""",
        "gestures",
        steps=ARRIVED,
    ),
)
def stream_transition_steps(spark, d):
    steps = shown_steps(spark.read.parquet(f"{step_table(spark, d)}/*/data"))
    return steps.groupBy(PERF, "to_state", "from_state").agg(F.count(F.lit(1)).alias("n"))


def shown_steps(steps):
    states = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("to_state", "from_state")]
    return steps.select(PERF, DEV, iso("time"), *states)


LATE = "event_id % 97 = 0"


@query(
    "stream_late_rows",
    with_sql(
        f"""SELECT performance_id, device_id, count(*) AS kept, count(*) FILTER ({LATE}) AS kept_late FROM ev
        WHERE {CHUNK_SQL} <= {WATERMARK} AND (NOT {LATE} OR {CHUNK_SQL} > (SELECT date_trunc('millisecond', max(time)) - INTERVAL {DELAY_SECONDS} SECOND FROM arrived
        WHERE NOT {LATE} AND (arrival - lo) * {BATCHES} // greatest(hi - lo, 1) < {BATCHES - 1})) GROUP BY 1, 2""",
        "ev",
        arrived=f"""SELECT *, min(arrival) OVER () AS lo, max(arrival) OVER () AS hi FROM
        (SELECT *, epoch_us(time) + event_id * 7919 % {DELAY_SECONDS} * 1000000 AS arrival FROM ev)""",
    ),
)
def stream_late_rows(spark, d):
    """Rows that come after their chunk was given out are dropped, and only those.

    A batch gives out what the rows of the batches before it have closed, so the
    late file meets the watermark of all files but the last before it.
    """
    rows = event_stream(spark, d, F.expr(LATE)).select(PERF, DEV, "time", F.expr(f"CASE WHEN {LATE} THEN 1 ELSE 0 END").alias("gesture"))
    path = live.run_to_table(live.live_chunks(rows, "full", chunk=WIDTH, delay=DELAY), "live-late")
    each = spark.read.parquet(path).select(PERF, DEV, F.explode("rows").alias("r"))
    return each.groupBy(PERF, DEV).agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("r.state") == 1).alias("kept_late"))


def step_table(spark, d):
    return live.write_steps(gesture_stream(spark, d), "live-steps", chunk=WIDTH, delay=DELAY)


def step_stream(spark, d):
    """Steps stored by one stream and read by the next."""
    return live.message_stream(
        spark, f"{step_table(spark, d)}/*/data", f"{PERF} long, {DEV} string, time timestamp, to_state int, from_state int"
    )


CLOSED = f"window_start + INTERVAL {WIDTH} SECOND <= {WATERMARK.replace('FROM ev', 'FROM steps')}"
SERIES = f"SELECT performance_id, window_start, {FLUX} AS flux FROM counts WHERE {CLOSED} GROUP BY ALL"


@query(
    "stream_flux",
    with_sql(
        f"SELECT performance_id, {iso_sql('window_start', 'time')}, {rounded_sql('flux')} FROM series",
        "gestures",
        steps=ARRIVED,
        counts=WINDOW5,
        series=SERIES,
    ),
)
def stream_flux(spark, d):
    path = live.run_to_table(live.live_flux(step_stream(spark, d), WIDTH, DELAY), "live-flux")
    return spark.read.parquet(path).select(PERF, iso("time"), rounded("flux"))


@query(
    "stream_ensemble_state",
    state_sql(
        f"SELECT performance_id, {iso_sql('window_start')}, state, {rounded_sql('spread')}, {rounded_sql('ratio')} FROM states WHERE {CLOSED}",
        5,
        steps=ARRIVED,
        counts=WINDOW5,
    ),
)
def stream_ensemble_state(spark, d):
    path = live.run_to_table(live.live_state(step_stream(spark, d), WIDTH, DELAY), "live-state")
    return spark.read.parquet(path).select(
        PERF, iso("window.start", "window_start"), "state", rounded("spread"), rounded("ratio")
    )


@query(
    "stream_new_ideas",
    with_sql(
        f"SELECT performance_id, {iso_sql('window_start', 'time')}, {rounded_sql('flux')} FROM rises WHERE rise > CAST(0.3 AS DOUBLE)",
        "gestures",
        steps=ARRIVED,
        counts=WINDOW5,
        series=SERIES,
        rises=RISES,
    ),
)
def stream_new_ideas(spark, d):
    flux_path = live.run_to_table(live.live_flux(step_stream(spark, d), WIDTH, DELAY), "live-flux")
    flux = live.message_stream(spark, flux_path, f"{PERF} long, time timestamp, flux double")
    path = live.run_to_table(live.live_new_ideas(flux), "live-ideas")
    return spark.read.parquet(path).select(PERF, iso("time"), rounded("flux"))


KINDS = """CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_type = 'click' THEN 'touch' WHEN event_type = 'error' THEN 'touch/ended'
    WHEN event_type = 'purchase' THEN 'online' WHEN event_type = 'signup' THEN 'app' ELSE 'accel' END"""


@query(
    "stream_routes",
    with_sql(f"SELECT performance_id, {KINDS} AS kind, count(*) AS n FROM ev GROUP BY 1, 2", "ev"),
)
def stream_routes(spark, d):
    routed = live.live_routes(raw_messages(event_stream(spark, d)))
    path = live.run_to_table(routed, "live-routes", partition_by="kind")
    return spark.read.parquet(path).groupBy(PERF, "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_sources",
    with_sql(
        f"""SELECT performance_id, device_id, {iso_sql('max(time)', 'last_seen')},
        coalesce(max_by('App' || (event_id % 3), time) FILTER (event_type = 'signup'), 'none') AS app_id,
        max_by(event_type, time) <> 'error' AS is_online FROM ev GROUP BY 1, 2""",
        "ev",
    ),
)
def stream_sources(spark, d):
    kind = F.when(F.col("event_type") == "signup", "online").when(F.col("event_type") == "error", "offline").otherwise("touch")
    app = F.concat(F.lit("App"), (F.col("event_id") % 3).cast("string"))
    messages = event_stream(spark, d).select(PERF, DEV, "time", kind.alias("kind"), app.alias("app_id"))
    path = live.run_updates(live.live_sources(messages), "live-sources")
    rows = spark.read.parquet(path)
    newest = [F.max_by(c, "last_seen").alias(c) for c in ("app_id", "is_online")]
    return rows.groupBy(PERF, DEV).agg(F.max("last_seen").alias("seen"), *newest).select(
        PERF, DEV, iso("seen", "last_seen"), F.coalesce("app_id", F.lit("none")).alias("app_id"), "is_online"
    )


@query(
    "stream_sessions",
    with_sql(
        f"""SELECT performance_id, device_id, {iso_sql('min(time)', 'start')}, {iso_sql(f'max(time) + INTERVAL {DAY} SECOND', 'end')}, count(*) AS touches FROM
        (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {DAY * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY performance_id, device_id ORDER BY time) AS s FROM
         (SELECT *, epoch_us(time) - epoch_us(lag(time) OVER (PARTITION BY performance_id, device_id ORDER BY time)) AS gap FROM touches))
        GROUP BY performance_id, device_id, s HAVING max(time) + INTERVAL {DAY} SECOND <= {WATERMARK}""".replace("AS end", 'AS "end"'),
        "touches",
    ),
)
def stream_sessions(spark, d):
    path = live.run_to_table(live.live_sessions(touch_stream(spark, d), DAY, DELAY), "live-sessions")
    return spark.read.parquet(path).select(PERF, DEV, iso("start"), iso("end"), "touches")
