"""Feature vectors, activity counts, filters and joins of touches and gestures."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxweave.dims import DEV, FEATURE_COLUMNS, PERF
from fluxweave.functions import scalars as sc
from fluxweave.operators import features as fv
from fluxweave.operators import learning as ln
from fluxweave.operators import messages as ms
from fluxweave.operators import study as st
from fluxweave.plans import testviews as tv
from fluxweave.plans.catalog.base import iso, iso_sql, query, rounded, rounded_sql
from fluxweave.plans.testviews import DAY, HOUR, TICK, VECTOR, bin_sql, with_sql

COUNTS = ["freq", "movement_freq", "touchdown_freq"]
REALS = [c for c in FEATURE_COLUMNS if c not in COUNTS]
VECTOR_SQL = """coalesce(avg(x_pos), -1) AS centroid_x, coalesce(avg(y_pos), -1) AS centroid_y,
    coalesce(stddev_samp(x_pos), 0) AS std_x, coalesce(stddev_samp(y_pos), 0) AS std_y,
    count(x_pos) AS freq, count(x_pos) FILTER ({moving}) AS movement_freq,
    count(x_pos) FILTER (velocity = 0) AS touchdown_freq, coalesce(avg(velocity), 0) AS velocity"""


def shown(columns=FEATURE_COLUMNS):
    return [F.col(c) if c in COUNTS else rounded(c) for c in columns]


def shown_sql(columns=FEATURE_COLUMNS):
    return ", ".join(c if c in COUNTS else rounded_sql(c) for c in columns)


def us(c):
    return f"epoch_us({c})"


def grid_sql(step: int, width: int, keys: str = "performance_id, device_id") -> str:
    """Grid of each device from its first to its last bin start."""
    return f"""SELECT {keys}, unnest(generate_series(lo, hi, INTERVAL {step} SECOND)) AS tick FROM
        (SELECT {keys}, {bin_sql('min(time)', width)} AS lo, {bin_sql('max(time)', width)} AS hi FROM touches GROUP BY {keys})"""


TUMBLING = f"""SELECT g.performance_id, g.device_id, g.tick AS time, {VECTOR_SQL.format(moving='true')}
    FROM grid g LEFT JOIN touches t ON t.performance_id = g.performance_id AND t.device_id = g.device_id
    AND t.time >= g.tick AND t.time < g.tick + INTERVAL {VECTOR} SECOND GROUP BY 1, 2, 3"""
ROLLING = f"""SELECT g.performance_id, g.device_id, g.tick AS time, {VECTOR_SQL.format(moving='velocity <> 0')}
    FROM grid g LEFT JOIN touches t ON t.performance_id = g.performance_id AND t.device_id = g.device_id
    AND t.time BETWEEN g.tick - INTERVAL {VECTOR} SECOND AND g.tick GROUP BY 1, 2, 3"""


def tumbling_sql(body: str, **extra: str) -> str:
    return with_sql(body, "touches", grid=grid_sql(VECTOR, VECTOR), vectors=TUMBLING, **extra)


def rolling_sql(body: str, *views: str, **extra: str) -> str:
    return with_sql(body, "touches", *views, grid=grid_sql(TICK, VECTOR), vectors=ROLLING, **extra)


def tumbling(spark, d):
    return fv.tumbling_features(tv.touches(spark, d), VECTOR)


def rolling(spark, d):
    return fv.rolling_features(tv.touches(spark, d), VECTOR, TICK)


@query("features_tumbling", tumbling_sql(f"SELECT performance_id, device_id, {iso_sql('time')}, {shown_sql()} FROM vectors"))
def features_tumbling(spark, d):
    return tumbling(spark, d).select(PERF, DEV, iso("time"), *shown())


@query("features_rolling", rolling_sql(f"SELECT performance_id, device_id, {iso_sql('time')}, {shown_sql()} FROM vectors"))
def features_rolling(spark, d):
    return rolling(spark, d).select(PERF, DEV, iso("time"), *shown())


@query(
    "features_whole_session",
    with_sql(
        f"SELECT performance_id, device_id, {shown_sql()} FROM (SELECT performance_id, device_id, "
        f"{VECTOR_SQL.format(moving='velocity <> 0')} FROM touches GROUP BY 1, 2)",
        "touches",
    ),
)
def features_whole_session(spark, d):
    return fv.whole_features(tv.touches(spark, d)).select(PERF, DEV, *shown())


PLAIN = [c for c in FEATURE_COLUMNS if not c.startswith("std")]


@query(
    "features_without_spread",
    tumbling_sql(f"SELECT performance_id, device_id, {iso_sql('time')}, {shown_sql(PLAIN)} FROM vectors"),
)
def features_without_spread(spark, d):
    return fv.plain_features(tv.touches(spark, d), VECTOR).select(PERF, DEV, iso("time"), *shown(PLAIN))


@query(
    "features_latest_per_device",
    tumbling_sql(
        f"SELECT performance_id, device_id, {iso_sql('time')}, {shown_sql()} FROM vectors "
        "QUALIFY row_number() OVER (PARTITION BY performance_id, device_id ORDER BY time DESC) = 1"
    ),
)
def features_latest_per_device(spark, d):
    return fv.last_features(tumbling(spark, d)).select(PERF, DEV, iso("time"), *shown())


@query(
    "activity_per_device",
    with_sql(
        f"SELECT performance_id, device_id, {iso_sql('tick', 'time')}, count(x_pos) AS touches FROM grid g LEFT JOIN "
        f"(SELECT performance_id, device_id, {bin_sql('time', DAY)} AS tick, x_pos FROM touches) t USING (performance_id, device_id, tick) GROUP BY 1, 2, 3",
        "touches",
        grid=grid_sql(DAY, DAY),
    ),
)
def activity_per_device(spark, d):
    return fv.activity(tv.touches(spark, d), DAY).select(PERF, DEV, iso("time"), "touches")


@query(
    "activity_of_ensemble",
    with_sql(
        f"SELECT performance_id, {iso_sql('tick', 'time')}, count(x_pos) AS touches FROM grid g LEFT JOIN "
        f"(SELECT performance_id, {bin_sql('time', 2 * HOUR)} AS tick, x_pos FROM touches) t USING (performance_id, tick) GROUP BY 1, 2",
        "touches",
        grid=grid_sql(2 * HOUR, 2 * HOUR, "performance_id"),
    ),
)
def activity_of_ensemble(spark, d):
    return fv.activity(tv.touches(spark, d), 2 * HOUR, by_device=False).select(PERF, iso("time"), "touches")


@query("touches_per_device", with_sql("SELECT performance_id, device_id, count(*) AS touches FROM touches GROUP BY ALL", "touches"))
def touches_per_device(spark, d):
    return fv.touches_per_device(tv.touches(spark, d))


@query(
    "targets_resampled_max",
    with_sql(
        f"SELECT performance_id, {iso_sql('tick', 'time')}, max(target) AS target FROM "
        f"(SELECT *, {bin_sql('time', DAY)} AS tick FROM targets) GROUP BY performance_id, tick",
        "targets",
    ),
)
def targets_resampled_max(spark, d):
    return fv.resample(tv.targets(spark, d), [PERF], "target", DAY, "max").select(PERF, iso("time"), "target")


@query(
    "targets_resampled_first",
    with_sql(
        f"SELECT performance_id, {iso_sql('tick', 'time')}, min_by(target, time) AS target FROM "
        f"(SELECT *, {bin_sql('time', DAY)} AS tick FROM targets) GROUP BY performance_id, tick",
        "targets",
    ),
)
def targets_resampled_first(spark, d):
    return fv.resample(tv.targets(spark, d), [PERF], "target", DAY, "first").select(PERF, iso("time"), "target")


@query(
    "touch_kinds",
    with_sql(
        "SELECT performance_id, device_id, count(*) FILTER (velocity = 0) AS touchdowns, "
        "count(*) FILTER (velocity <> 0) AS movements FROM touches GROUP BY ALL",
        "touches",
    ),
)
def touch_kinds(spark, d):
    return ms.touch_kind_counts(tv.touches(spark, d))


LO, HI = "2024-01-05 00:00:00", "2024-01-09 12:00:00"


@query(
    "touches_in_time_range",
    with_sql(
        f"SELECT performance_id, device_id, {iso_sql('time')}, x_pos FROM touches WHERE time BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'",
        "touches",
    ),
)
def touches_in_time_range(spark, d):
    picked = ms.between(tv.touches(spark, d), F.lit(LO).cast("timestamp"), F.lit(HI).cast("timestamp"))
    return picked.select(PERF, DEV, iso("time"), "x_pos")


@query(
    "touches_retained",
    with_sql(
        f"""SELECT performance_id, device_id, {iso_sql('time')} FROM touches JOIN
        (SELECT performance_id, max(time) AS newest FROM touches GROUP BY 1) USING (performance_id)
        WHERE time > newest - INTERVAL {5 * DAY} SECOND""",
        "touches",
    ),
)
def touches_retained(spark, d):
    return ms.retain_seconds(tv.touches(spark, d), 5 * DAY).select(PERF, DEV, iso("time"))


HOURLY = f"SELECT performance_id, device_id, {tv.bin_sql('time', tv.HOUR)} AS time, max_by(gesture, time) AS gesture FROM gestures GROUP BY ALL"


def hourly(spark, d):
    """A gesture log: the last state of every device in each of its hours."""
    tick = sc.bin_start("time", tv.HOUR).alias("tick")
    log = tv.gestures(spark, d).groupBy(PERF, DEV, tick).agg(F.max_by("gesture", "time").alias("gesture"))
    return log.withColumnRenamed("tick", "time")


@query(
    "gestures_retained",
    with_sql(
        f"SELECT performance_id, device_id, {iso_sql('time')}, gesture FROM hourly "
        "QUALIFY dense_rank() OVER (PARTITION BY performance_id ORDER BY time DESC) <= 300",
        "gestures",
        hourly=HOURLY,
    ),
)
def gestures_retained(spark, d):
    """The last 300 ticks; several devices share a tick."""
    return ms.retain_ticks(hourly(spark, d), chunk_seconds=DAY).select(PERF, DEV, iso("time"), "gesture")


@query(
    "gestures_last_minute",
    with_sql(
        f"""SELECT performance_id, device_id, {iso_sql('time')}, gesture FROM
        (SELECT *, max(time) OVER (PARTITION BY performance_id) AS newest, dense_rank() OVER (PARTITION BY performance_id ORDER BY time DESC) AS tick FROM hourly)
        WHERE tick <= 300 AND time > newest - INTERVAL {60 * tv.HOUR} SECOND""",
        "gestures",
        hourly=HOURLY,
    ),
)
def gestures_last_minute(spark, d):
    """All ticks of the last minute (an hour stands for a second), with every device of each."""
    kept = ms.retain_ticks(hourly(spark, d), chunk_seconds=DAY)
    return ms.retain_seconds(kept, 60 * tv.HOUR).select(PERF, DEV, iso("time"), "gesture")


@query(
    "targets_without_bad",
    with_sql(f"SELECT performance_id, {iso_sql('time')}, target FROM targets WHERE target <> 100", "targets"),
)
def targets_without_bad(spark, d):
    return ms.drop_bad_targets(tv.targets(spark, d)).select(PERF, iso("time"), "target")


@query(
    "idle_vectors_forced_to_zero",
    rolling_sql(
        f"SELECT performance_id, device_id, {iso_sql('time')}, CASE WHEN centroid_x = -1 THEN 0 ELSE freq % 9 END AS target FROM vectors"
    ),
)
def idle_vectors_forced_to_zero(spark, d):
    labelled = rolling(spark, d).withColumn("target", F.col("freq") % 9)
    return ms.force_idle_target(labelled).select(PERF, DEV, iso("time"), "target")


@query(
    "vectors_with_missing_filled",
    rolling_sql(
        f"""SELECT g.performance_id, g.device_id, {iso_sql('g.tick', 'time')}, round(coalesce(centroid_x, -1), 6) AS centroid_x,
        round(coalesce(v.std_x, 0), 6) AS std_x, coalesce(freq, 0) AS freq FROM every g LEFT JOIN vectors v
        ON v.performance_id = g.performance_id AND v.device_id = g.device_id AND v.time = g.tick""",
        every=f"""SELECT performance_id, device_id, unnest(generate_series(lo, hi, INTERVAL {TICK} SECOND)) AS tick FROM
        (SELECT DISTINCT performance_id, device_id FROM touches) JOIN
        (SELECT performance_id, {bin_sql('min(time)', TICK)} AS lo, {bin_sql('max(time)', TICK)} AS hi FROM touches GROUP BY 1) USING (performance_id)""",
    ),
)
def vectors_with_missing_filled(spark, d):
    """Ticks of the whole performance joined with each device's vectors, gaps filled."""
    t = tv.touches(spark, d)
    ticks = ms.gesture_grid(t.select(PERF, DEV, "time", F.lit(0).alias("gesture")), TICK).select(PERF, DEV, "time")
    joined = ticks.join(fv.rolling_features(t, VECTOR, TICK), [PERF, DEV, "time"], "left")
    return ms.fill_vectors(joined).select(PERF, DEV, iso("time"), rounded("centroid_x"), rounded("std_x"), "freq")


@query(
    "gesture_codes_encoded",
    with_sql(
        """SELECT code, CASE code WHEN 'FT' THEN 1 WHEN 'ST' THEN 2 WHEN 'FS' THEN 3 WHEN 'C' THEN 8 ELSE 0 END AS state, count(*) AS n
        FROM (SELECT CASE event_type WHEN 'click' THEN 'FT' WHEN 'error' THEN 'ST' WHEN 'purchase' THEN 'FS' WHEN 'signup' THEN '' ELSE 'C' END AS code FROM ev)
        GROUP BY 1, 2""",
        "ev",
    ),
)
def gesture_codes_encoded(spark, d):
    codes = {"click": "FT", "error": "ST", "purchase": "FS", "signup": "", "view": "C"}
    coded = tv.events(spark, d).select(sc.lookup("event_type", codes).alias("code"))
    return coded.withColumn("state", sc.encode_gesture("code")).groupBy("code", "state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "gesture_report_lines",
    with_sql(
        f"""SELECT performance_id, {iso_sql('time')}, concat_ws(' : ', device_id, CASE gesture WHEN 0 THEN 'n' WHEN 1 THEN 'ft' WHEN 2 THEN 'st'
        WHEN 3 THEN 'fs' WHEN 4 THEN 'fsa' WHEN 5 THEN 'vss' WHEN 6 THEN 'bs' WHEN 7 THEN 'ss' WHEN 8 THEN 'c' END) AS line FROM gestures""",
        "gestures",
    ),
)
def gesture_report_lines(spark, d):
    return ms.gesture_report(tv.gestures(spark, d)).select(PERF, iso("time"), "line")


@query(
    "gesture_groups",
    with_sql(
        f"SELECT performance_id, coalesce({tv.GROUP_OF.format(g='gesture')}, -1) AS grp, count(*) AS n FROM gestures GROUP BY 1, 2",
        "gestures",
    ),
)
def gesture_groups(spark, d):
    grp = F.coalesce(sc.gesture_group("gesture"), F.lit(-1)).alias("grp")
    return tv.gestures(spark, d).groupBy(PERF, grp).agg(F.count(F.lit(1)).alias("n"))


@query(
    "gesture_grid_dense",
    with_sql(
        f"""SELECT e.performance_id, e.device_id, {iso_sql('e.tick', 'time')}, coalesce(g.gesture, 0) AS gesture FROM every e LEFT JOIN
        (SELECT performance_id, device_id, {bin_sql('time', DAY)} AS tick, max_by(gesture, time) AS gesture FROM gestures GROUP BY ALL) g
        ON g.performance_id = e.performance_id AND g.device_id = e.device_id AND g.tick = e.tick""",
        "gestures",
        every=f"""SELECT performance_id, device_id, unnest(generate_series(lo, hi, INTERVAL {DAY} SECOND)) AS tick FROM
        (SELECT DISTINCT performance_id, device_id FROM gestures) JOIN
        (SELECT performance_id, {bin_sql('min(time)', DAY)} AS lo, {bin_sql('max(time)', DAY)} AS hi FROM gestures GROUP BY 1) USING (performance_id)""",
    ),
)
def gesture_grid_dense(spark, d):
    return ms.gesture_grid(tv.gestures(spark, d), DAY).select(PERF, DEV, iso("time"), "gesture")


@query(
    "elapsed_and_frames",
    with_sql(
        f"""SELECT performance_id, device_id, {rounded_sql('elapsed')}, CAST(floor(elapsed * 25) + 1 AS BIGINT) AS frame FROM
        (SELECT performance_id, device_id, (epoch_us(time) - (f - f % 1000000)) / CAST(1000000 AS DOUBLE) + 1 AS elapsed FROM touches JOIN
         (SELECT performance_id, epoch_us(min(time)) AS f FROM touches GROUP BY 1) USING (performance_id))""",
        "touches",
    ),
)
def elapsed_and_frames(spark, d):
    return ms.with_elapsed(tv.touches(spark, d), lead_in=1).select(PERF, DEV, rounded("elapsed"), "frame")


@query(
    "colour_slots",
    with_sql(
        f"SELECT performance_id, device_id, {iso_sql('first_seen')}, CAST((row_number() OVER (PARTITION BY performance_id ORDER BY first_seen, device_id) - 1) % 14 AS INT) AS slot "
        "FROM (SELECT performance_id, device_id, min(time) AS first_seen FROM gestures GROUP BY 1, 2)",
        "gestures",
    ),
)
def colour_slots(spark, d):
    return ms.colour_slots(tv.gestures(spark, d)).select(PERF, DEV, iso("first_seen"), "slot")


@query(
    "reachable_gestures",
    with_sql(
        f"""SELECT performance_id, device_id, {iso_sql('time')}, gesture FROM gestures WHERE EXISTS (SELECT 1 FROM ev e
        WHERE e.performance_id = gestures.performance_id AND e.device_id = gestures.device_id AND e.event_type = 'signup' AND e.value > 60)""",
        "gestures",
    ),
)
def reachable_gestures(spark, d):
    sources = tv.events(spark, d).filter("event_type = 'signup' AND value > 60").select(PERF, DEV)
    return ms.reachable_gestures(tv.gestures(spark, d), sources).select(PERF, DEV, iso("time"), "gesture")


@query(
    "device_names",
    with_sql(
        """SELECT e.performance_id, e.device_id, coalesce(s.s_name, e.device_id) AS device_name, count(*) AS n
        FROM ev e LEFT JOIN supplier s ON s.s_suppkey = e.user_id GROUP BY 1, 2, 3""",
        "ev",
    ),
)
def device_names(spark, d):
    names = tv.table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias(DEV), F.col("s_name").alias("device_name")
    )
    named = ms.with_device_name(tv.touches(spark, d).select(PERF, DEV), names)
    return named.groupBy(PERF, DEV, "device_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "performance_type_names",
    with_sql(
        """SELECT code, CASE code WHEN 0 THEN 'Performance-Local' WHEN 1 THEN 'Performance-Remote' WHEN 2 THEN 'Experiment-Both'
        WHEN 3 THEN 'Experiment-None' WHEN 4 THEN 'Experiment-Button' WHEN 5 THEN 'Experiment-Server' WHEN 6 THEN 'Experiment-ButtonFade'
        ELSE 'unknown' END AS name, count(*) AS n FROM (SELECT CAST(user_id % 8 AS INT) AS code FROM ev) GROUP BY 1, 2""",
        "ev",
    ),
)
def performance_type_names(spark, d):
    coded = tv.events(spark, d).select((F.col("user_id") % 8).cast("int").alias("code"))
    name = F.coalesce(sc.performance_type_name("code"), F.lit("unknown")).alias("name")
    return coded.groupBy("code", name).agg(F.count(F.lit(1)).alias("n"))


@query(
    "vectors_with_targets",
    tumbling_sql(
        f"""SELECT v.performance_id, v.device_id, {iso_sql('v.time', 'time')}, v.freq, coalesce(t.target, -1) AS target FROM vectors v
        LEFT JOIN (SELECT performance_id, {bin_sql('time', VECTOR)} AS time, min_by(target, time) AS target FROM tg GROUP BY 1, 2) t
        ON t.performance_id = v.performance_id AND t.time = v.time""",
        tg=tv.SQL_VIEWS["targets"],
    ),
)
def vectors_with_targets(spark, d):
    asked = fv.resample(tv.targets(spark, d), [PERF], "target", VECTOR, "first")
    joined = ln.vectors_with_targets(tumbling(spark, d), asked)
    return joined.select(PERF, DEV, iso("time"), "freq", F.coalesce("target", F.lit(-1)).alias("target"))


@query(
    "training_set",
    rolling_sql(
        f"""SELECT performance_id, device_id, {iso_sql('time')}, {shown_sql()},
        coalesce(CASE WHEN centroid_x = -1 THEN 0 ELSE target END, -1) AS target FROM
        (SELECT v.*, t.target FROM vectors v LEFT JOIN (SELECT performance_id, {bin_sql('time', TICK)} AS time, max(target) AS target FROM tg GROUP BY 1, 2) t
         ON t.performance_id = v.performance_id AND t.time = v.time) WHERE target IS DISTINCT FROM 100""",
        tg=tv.SQL_VIEWS["targets"],
    ),
)
def training_set(spark, d):
    rows = ln.training_set(tv.touches(spark, d), tv.targets(spark, d), VECTOR, TICK)
    return rows.select(PERF, DEV, iso("time"), *shown(), F.coalesce("target", F.lit(-1)).alias("target"))


@query(
    "graded_match_scores",
    with_sql(
        f"""SELECT performance_id, device_id, count(*) AS n, count(*) FILTER (gesture <> prediction) AS mislabelled,
        {rounded_sql('avg(CASE WHEN gesture = prediction THEN 1 ELSE 0 END)', 'accuracy')},
        CAST(sum(CASE WHEN gesture = prediction THEN 0 WHEN pg = tg THEN 1 WHEN pg IS NOT NULL THEN 3 ELSE 5 END) AS BIGINT) AS score FROM
        (SELECT *, {{p}} AS pg, {{t}} AS tg FROM pred) GROUP BY 1, 2""".format(
            p="CASE WHEN prediction = 0 THEN 0 WHEN prediction IN (1, 2) THEN 1 WHEN prediction IN (3, 4, 5) THEN 2 WHEN prediction IN (6, 7) THEN 3 WHEN prediction = 8 THEN 4 WHEN prediction = 9 THEN 5 END",
            t="CASE WHEN gesture = 0 THEN 0 WHEN gesture IN (1, 2) THEN 1 WHEN gesture IN (3, 4, 5) THEN 2 WHEN gesture IN (6, 7) THEN 3 WHEN gesture = 8 THEN 4 WHEN gesture = 9 THEN 5 END",
        ),
        "ev",
        pred="SELECT performance_id, device_id, CAST(floor(value) AS INT) % 11 AS gesture, CAST(floor(value / 2) AS INT) % 11 AS prediction FROM ev",
    ),
)
def graded_match_scores(spark, d):
    return st.graded_scores(_paired_states(spark, d), [PERF, DEV]).select(
        PERF, DEV, "n", "mislabelled", rounded("accuracy"), "score"
    )


def _paired_states(spark, d):
    return tv.events(spark, d).select(
        PERF,
        DEV,
        (F.floor("value").cast("int") % 11).alias("gesture"),
        (F.floor(F.col("value") / 2).cast("int") % 11).alias("prediction"),
    )


@query(
    "confusion_matrix",
    with_sql(
        f"SELECT performance_id, gesture, prediction, n, {rounded_sql('n / sum(n) OVER (PARTITION BY performance_id)', 'share')} FROM "
        "(SELECT performance_id, CAST(floor(value) AS INT) % 11 AS gesture, CAST(floor(value / 2) AS INT) % 11 AS prediction, count(*) AS n FROM ev GROUP BY 1, 2, 3)",
        "ev",
    ),
)
def confusion_matrix(spark, d):
    return st.confusion(_paired_states(spark, d), [PERF]).select(PERF, "gesture", "prediction", "n", rounded("share"))
