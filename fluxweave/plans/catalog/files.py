"""Log splitting, captures, and tables written to files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxweave.dims import DEV, PERF
from fluxweave.functions import scalars as sc
from fluxweave.operators import messages as ms
from fluxweave.operators import study as st
from fluxweave.operators import transitions as tr
from fluxweave.plans import testviews as tv
from fluxweave.plans.catalog.base import iso, iso_sql, query, rounded, rounded_sql
from fluxweave.plans.catalog.matrices import (
    COMPLETE,
    DEBOUNCE,
    ENSEMBLE,
    SHARES,
    STATE_ROWS,
    STEPS5,
    WHOLE,
    WINDOW5,
    daily,
    state_sql,
    window5,
)
from fluxweave.plans.catalog.vectors import TUMBLING, grid_sql, shown, shown_sql, tumbling
from fluxweave.plans.testviews import DAY, GAP, VECTOR, bin_sql, with_sql
from fluxweave.session import shared_folder
from fluxweave.sources import captures as cp
from fluxweave.sources import logs as lg
from fluxweave.sources import tables as tb
from fluxweave.sources.formats import DEFAULT_FORMAT

# --- views of the test tables as messages -----------------------------------

ONLINE_SQL = "SELECT performance_id, time, device_id, 'App' || (event_id % 3) AS app_id FROM ev WHERE event_type = 'signup'"


def online(spark, d):
    e = tv.events(spark, d).filter("event_type = 'signup'")
    app = F.concat(F.lit("App"), (F.col("event_id") % 3).cast("string"))
    return e.select(PERF, "time", F.lit(DEFAULT_FORMAT.address("online")).alias("type"), DEV, app.alias("app_id"))


def ensemble_states(spark, d):
    states = tr.ensemble_state(window5(spark, d), [PERF, "window_start"])
    return states.select(
        PERF, F.col("window_start").alias("time"), F.col("state").alias("transition_type"), "spread", "ratio"
    )


def log_lines(spark, d):
    """One log with every kind of line."""
    app = tv.app_messages(spark, d).filter("label IS NOT NULL AND value IS NOT NULL")
    parts = [
        lg.touch_lines(tv.touches(spark, d)),
        lg.event_lines(tv.idea_events(spark, d)),
        lg.app_lines(app),
        lg.online_lines(online(spark, d)),
        lg.target_lines(tv.targets(spark, d)),
        lg.gesture_lines(tv.gestures(spark, d)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TOUCH_ROWS = f"SELECT performance_id, device_id, {iso_sql('time')}, x_pos, y_pos, {rounded_sql('velocity')} FROM touches"


@query("log_touches", with_sql(TOUCH_ROWS, "touches"))
def log_touches(spark, d):
    return lg.split_touches(log_lines(spark, d)).select(PERF, DEV, iso("time"), "x_pos", "y_pos", rounded("velocity"))


@query("log_events", with_sql(f"SELECT performance_id, {iso_sql('time')}, name, event_type FROM idea_events", "idea_events"))
def log_events(spark, d):
    return lg.split_events(log_lines(spark, d)).select(PERF, iso("time"), "name", "event_type")


@query(
    "log_app_messages",
    with_sql(
        f"SELECT performance_id, {iso_sql('time')}, type, device_id, label, value FROM app_messages WHERE label IS NOT NULL AND value IS NOT NULL",
        "app_messages",
    ),
)
def log_app_messages(spark, d):
    return lg.split_app_messages(log_lines(spark, d)).select(PERF, iso("time"), "type", DEV, "label", "value")


@query(
    "log_online",
    with_sql(f"SELECT performance_id, {iso_sql('time')}, '/ensemble/online' AS type, device_id, app_id FROM onl", "ev", onl=ONLINE_SQL),
)
def log_online(spark, d):
    return lg.split_online(log_lines(spark, d)).select(PERF, iso("time"), "type", DEV, "app_id")


@query(
    "log_transitions",
    state_sql(
        f"SELECT performance_id, {iso_sql('window_start', 'time')}, state AS transition_type, {rounded_sql('spread')}, {rounded_sql('ratio')} FROM states",
        5,
        steps=STEPS5,
        counts=WINDOW5,
    ),
)
def log_transitions(spark, d):
    lines = log_lines(spark, d).unionByName(lg.transition_lines(ensemble_states(spark, d)))
    return lg.split_transitions(lines).select(PERF, iso("time"), "transition_type", rounded("spread"), rounded("ratio"))


@query(
    "log_gestures",
    with_sql(f"SELECT performance_id, device_id, {iso_sql('time')}, gesture FROM gestures", "gestures"),
)
def log_gestures(spark, d):
    return lg.split_gestures(log_lines(spark, d)).select(PERF, DEV, iso("time"), "gesture")


DAILY = f"""SELECT performance_id, device_id, {bin_sql('time', DAY)} AS time, max_by(gesture, time) AS gesture FROM gestures GROUP BY 1, 2, 3"""


def daily_gestures(spark, d):
    return tv.gestures(spark, d).groupBy(PERF, DEV, sc.bin_start("time", DAY).alias("time")).agg(
        F.max_by("gesture", "time").alias("gesture")
    )


@query(
    "log_gestures_many_devices",
    with_sql(f"SELECT performance_id, device_id, {iso_sql('time')}, gesture FROM daily", "gestures", daily=DAILY),
)
def log_gestures_many_devices(spark, d):
    """Lines of several devices, some of them absent from some lines."""
    return lg.split_gestures(lg.gesture_lines(daily_gestures(spark, d))).select(PERF, DEV, iso("time"), "gesture")


@query(
    "log_legacy_gestures",
    with_sql(f"SELECT performance_id, device_id, {iso_sql('time')}, gesture FROM daily", "gestures", daily=DAILY),
)
def log_legacy_gestures(spark, d):
    lines = lg.gesture_lines(daily_gestures(spark, d), address=None)
    return lg.legacy_gestures(lines).select(PERF, DEV, iso("time"), "gesture")


@query("log_targets", with_sql(f"SELECT performance_id, {iso_sql('time')}, target FROM targets", "targets"))
def log_targets(spark, d):
    return lg.split_targets(log_lines(spark, d)).select(PERF, iso("time"), "target")


@query(
    "log_line_format",
    with_sql(
        "SELECT performance_id, strftime(time, '%Y-%m-%dT%H:%M:%S.%f') || ', ' || name || ', ' || event_type AS value FROM idea_events",
        "idea_events",
    ),
)
def log_line_format(spark, d):
    return lg.event_lines(tv.idea_events(spark, d))


ROUTES = [  # event type -> address and type tags
    ("click", "/ensemble/touch", "sfff"),
    ("error", "/ensemble/touch/ended", "s"),
    ("purchase", "/ensemble/online", "ss"),
    ("signup", "/ensemble/app", "sss"),
    ("view", "/ensemble/acceleration", "sfff"),
]


@query(
    "messages_routed",
    with_sql(
        """SELECT performance_id, kind, count(*) AS n FROM (SELECT performance_id, CASE WHEN event_id % 11 = 0 THEN 'error'
        WHEN event_type = 'click' THEN 'touch' WHEN event_type = 'error' THEN 'touch/ended' WHEN event_type = 'purchase' THEN 'online'
        WHEN event_type = 'signup' THEN 'app' ELSE 'accel' END AS kind FROM ev) GROUP BY 1, 2""",
        "ev",
    ),
)
def messages_routed(spark, d):
    """Every eleventh message carries tags that fit no route."""
    routed = ms.route_messages(raw_messages(tv.events(spark, d)), DEFAULT_FORMAT)
    return routed.groupBy(PERF, "kind").agg(F.count(F.lit(1)).alias("n"))


def raw_messages(e):
    address = sc.lookup("event_type", {t: a for t, a, _ in ROUTES})
    tags = sc.lookup("event_type", {t: g for t, _, g in ROUTES})
    return e.select(
        PERF,
        "time",
        DEV,
        "event_id",
        address.alias("address"),
        F.when(F.col("event_id") % 11 == 0, "ii").otherwise(tags).alias("tags"),
    )


# --- captures -----------------------------------------------------------------


def bracket_records(spark, d):
    """Touches as a bracketed capture started on the minute of the first touch."""
    t = tv.touches(spark, d)
    first = t.groupBy(PERF).agg(sc.bin_start(F.min("time"), 60).alias("start"))
    e = t.join(first, PERF)
    seconds = (F.unix_micros("time") - F.unix_micros("start")).cast("decimal(20,0)") / F.lit(1000000)
    ended = F.col("velocity") == 0
    body = F.when(
        ended, F.concat(F.lit(" [ /ensemble/touch/ended, "), F.col(DEV), F.lit(" ]"))
    ).otherwise(
        F.concat(
            F.lit(" [ /ensemble/touch, "),
            F.concat_ws(", ", DEV, F.col("x_pos").cast("string"), F.col("y_pos").cast("string"), F.col("velocity").cast("string")),
            F.lit(" ]"),
        )
    )
    line = F.concat(seconds.cast("decimal(20,6)").cast("string"), body, F.lit(" a NetAddr(10.0.1.6, 57120)"))
    name = F.concat(F.lit("Capture"), F.col(PERF).cast("string"), F.date_format("start", "-yyyyMMdd-HH'h'mm"))
    return e.select(PERF, name.alias("name"), "start", line.alias("value"))


def record_records(spark, d, multi_line=True):
    """Touches as a record capture started on the second of the first touch."""
    t = tv.touches(spark, d)
    first = t.groupBy(PERF).agg(sc.bin_start(F.min("time"), 1).alias("start"))
    e = t.join(first, PERF)
    seconds = (F.unix_micros("time") - F.unix_micros("start")).cast("decimal(20,0)") / F.lit(1000000)
    gap = "\n    " if multi_line else "    "
    args = F.concat_ws(
        f",{gap}", F.concat(F.lit('"'), F.col(DEV), F.lit('"')), F.col("x_pos").cast("string"),
        F.col("y_pos").cast("string"), F.col("velocity").cast("string"),
    )
    head = " 10.0.1.4 <OSCMutableMessage (/ensemble/touch) (" if multi_line else " 10.0.1.4 < (/ensemble/touch) ("
    tail = "\n)>" if multi_line else ")>"
    line = F.concat(seconds.cast("decimal(20,6)").cast("string"), F.lit(head + gap), args, F.lit(tail))
    name = F.concat(F.lit("Capture"), F.col(PERF).cast("string"), F.date_format("start", "-yyyyMMdd-HH'h'mm'm'ss's'"))
    return e.select(PERF, name.alias("name"), "start", line.alias("value"))


def _stored(spark, records, **how):
    path = shared_folder(spark, "capture")
    records.select("name", "value").write.partitionBy("name").text(path)
    return cp.read_capture(spark, path, **how)


MOVES = f"SELECT device_id, {iso_sql('time')}, x_pos, y_pos, {rounded_sql('velocity')} FROM touches"


@query("capture_bracket_touches", with_sql(MOVES + " WHERE velocity <> 0", "touches"))
def capture_bracket_touches(spark, d):
    """Written to files, then read back with the start time taken from the file name."""
    records = _stored(spark, bracket_records(spark, d), to_second=False)
    return cp.bracket_touches(records).select(DEV, iso("time"), "x_pos", "y_pos", rounded("velocity"))


@query("capture_multi_line_touches", with_sql(MOVES, "touches"))
def capture_multi_line_touches(spark, d):
    records = _stored(spark, record_records(spark, d), multi_line=True)
    return cp.record_touches(records).select(DEV, iso("time"), "x_pos", "y_pos", rounded("velocity"))


@query("capture_single_line_touches", with_sql(MOVES, "touches"))
def capture_single_line_touches(spark, d):
    records = record_records(spark, d, multi_line=False)
    return cp.record_touches(records).select(DEV, iso("time"), "x_pos", "y_pos", rounded("velocity"))


@query(
    "capture_plain_text",
    with_sql(
        """SELECT performance_id, split_part(v, ' ', 2) || ' ' || split_part(v, ' ', 3) || ' ' || split_part(v, ' ', 4) AS value, count(*) AS n
        FROM (SELECT performance_id, 't 10.0.1.4 /ensemble/touch ' || device_id AS v FROM touches) GROUP BY 1, 2""",
        "touches",
    ),
)
def capture_plain_text(spark, d):
    text = cp.record_text(record_records(spark, d))
    words = F.array_join(F.slice(F.split("value", " "), 2, 3), " ").alias("value")
    return text.groupBy(PERF, words).agg(F.count(F.lit(1)).alias("n"))


@query(
    "capture_space_separated",
    with_sql(
        """SELECT performance_id, '10.0.1.6 ' || CASE WHEN velocity = 0 THEN '/ensemble/touch/ended ' ELSE '/ensemble/touch ' END || device_id AS head,
        CASE WHEN velocity = 0 THEN 4 ELSE 7 END AS words, count(*) AS n FROM touches GROUP BY 1, 2, 3""",
        "touches",
    ),
)
def capture_space_separated(spark, d):
    words = F.split("value", " ")
    text = cp.bracket_text(bracket_records(spark, d))
    return text.groupBy(
        PERF, F.array_join(F.slice(words, 2, 3), " ").alias("head"), F.size(words).alias("words")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "capture_unit_square",
    with_sql(
        f"""SELECT performance_id, CAST(device_id AS INT) AS uid, 1 AS gid, 1 AS mode,
        {rounded_sql("(epoch_us(time) - (f - f % 60000000)) / CAST(1000000 AS DOUBLE)", 'time')},
        {rounded_sql('x_pos / 1024', 'x')}, {rounded_sql('y_pos / 768', 'y')} FROM touches
        JOIN (SELECT performance_id, epoch_us(min(time)) AS f FROM touches GROUP BY 1) USING (performance_id) WHERE velocity <> 0""",
        "touches",
    ),
)
def capture_unit_square(spark, d):
    uids = tv.touches(spark, d).select(DEV).distinct().withColumn("uid", F.col(DEV).cast("int"))
    out = cp.unit_square_touches(bracket_records(spark, d), uids)
    return out.select(PERF, rounded("time"), "uid", "gid", "mode", rounded("x"), rounded("y"))


@query(
    "coding_file_redated",
    with_sql(
        f"SELECT performance_id, {iso_sql('f + to_seconds(CAST(event_id % 7200 AS BIGINT))', 'time')}, event_type AS code FROM ev "
        "JOIN (SELECT performance_id, date_trunc('second', min(time)) AS f FROM ev GROUP BY 1) USING (performance_id)",
        "ev",
    ),
)
def coding_file_redated(spark, d):
    e = tv.events(spark, d)
    first = e.groupBy(PERF).agg(sc.bin_start(F.min("time"), 1).alias("start"))
    s = F.col("event_id") % 7200
    offset = F.concat_ws(":", F.floor(s / 60).cast("string"), (s % 60).cast("string"))
    rows = e.join(first, PERF).select(PERF, "start", offset.alias("offset"), F.col("event_type").alias("code"))
    return cp.redate_coding(rows).select(PERF, iso("time"), "code")


@query(
    "coding_grid",
    with_sql(
        """SELECT performance_id, CAST(s AS INT) AS second, CAST((s // 60) % 60 AS VARCHAR) || ':' || CAST(s % 60 AS VARCHAR) AS label FROM
        (SELECT performance_id, unnest(range(0, n, 5)) AS s FROM (SELECT performance_id, count(*) AS n FROM touches GROUP BY 1))""",
        "touches",
    ),
)
def coding_grid(spark, d):
    lengths = tv.touches(spark, d).groupBy(PERF).agg(F.count(F.lit(1)).cast("double").alias("seconds"))
    return cp.coding_grid(lengths).select(PERF, "second", "label")


# --- tables ---------------------------------------------------------------------

TITLES = """SELECT performance_id, strftime(min(time), '%Y-%m-%dT%H-%M-%S') || '-Log' || performance_id AS title,
    date_trunc('second', min(time)) AS start_time FROM ev GROUP BY 1"""


def titled(spark, d, df):
    """Rows with the title of their performance in place of its number."""
    first = tv.events(spark, d).groupBy(PERF).agg(F.min("time").alias("f"))
    title = F.concat(F.date_format("f", tb.TITLE_TIME), F.lit("-Log"), F.col(PERF).cast("string"))
    return df.join(first.select(PERF, title.alias("title")), PERF).drop(PERF)


def stored_csv(spark, d, df, kind):
    return tb.write_exact_csv(titled(spark, d, df), shared_folder(spark, kind), by="title")


@query(
    "table_touches",
    with_sql(
        f"SELECT title AS performance_id, device_id, {iso_sql('time')}, x_pos, y_pos, {rounded_sql('velocity')} FROM touches JOIN titles USING (performance_id)",
        "touches",
        titles=TITLES,
    ),
)
def table_touches(spark, d):
    path = stored_csv(spark, d, tv.touches(spark, d).select(PERF, "time", DEV, "x_pos", "y_pos", "velocity"), "touches")
    return tb.read_touches(spark, path).select(PERF, DEV, iso("time"), "x_pos", "y_pos", rounded("velocity"))


@query(
    "table_events",
    with_sql(
        f"SELECT title AS performance_id, {iso_sql('time')}, name, event_type FROM idea_events JOIN titles USING (performance_id)",
        "idea_events",
        titles=TITLES,
    ),
)
def table_events(spark, d):
    path = stored_csv(spark, d, tv.idea_events(spark, d).select(PERF, "time", "name", "event_type"), "events")
    return tb.read_events(spark, path).select(PERF, iso("time"), "name", "event_type")


@query(
    "table_app_messages",
    with_sql(
        f"SELECT title AS performance_id, {iso_sql('time')}, type, device_id, coalesce(label, 'none') AS label, value FROM app_messages JOIN titles USING (performance_id)",
        "app_messages",
        titles=TITLES,
    ),
)
def table_app_messages(spark, d):
    rows = tv.app_messages(spark, d).select(PERF, "time", "type", DEV, "label", "value")
    read = tb.read_app_messages(spark, stored_csv(spark, d, rows, "messages"))
    return read.select(PERF, iso("time"), "type", DEV, F.coalesce("label", F.lit("none")).alias("label"), "value")


@query(
    "table_online",
    with_sql(
        f"SELECT title AS performance_id, {iso_sql('time')}, '/ensemble/online' AS type, device_id, app_id FROM onl JOIN titles USING (performance_id)",
        "ev",
        titles=TITLES,
        onl=ONLINE_SQL,
    ),
)
def table_online(spark, d):
    path = stored_csv(spark, d, online(spark, d), "online")
    return tb.read_online(spark, path).select(PERF, iso("time"), "type", DEV, "app_id")


@query(
    "table_transitions",
    state_sql(STATE_ROWS, 5, steps=STEPS5, counts=WINDOW5).replace(
        " AS window_start, state,", " AS time, state AS transition_type,"
    ),
)
def table_transitions(spark, d):
    """Ensemble states, written once for all performances and read back."""
    path = tb.write_exact_csv(ensemble_states(spark, d), shared_folder(spark, "transitions"), by=PERF)
    read = tb.read_table(spark, path, tb.schemas.TRANSITIONS, keyed=False)
    return read.select(
        F.col(PERF).cast("long").alias(PERF), iso("time"), "transition_type", rounded("spread"), rounded("ratio")
    )


@query(
    "table_targets",
    with_sql(
        f"SELECT title AS performance_id, {iso_sql('time')}, target FROM targets JOIN titles USING (performance_id)",
        "targets",
        titles=TITLES,
    ),
)
def table_targets(spark, d):
    path = stored_csv(spark, d, tv.targets(spark, d), "targets")
    return tb.read_targets(spark, path).select(PERF, iso("time"), "target")


SEAT_SQL = "CAST(CAST(device_id AS BIGINT) // 10 % 4 + 1 AS INT)"


def seat_gestures(spark, d):
    """Gestures per seat: four columns when wide."""
    g = tv.gestures(spark, d).withColumn("seat", F.concat(F.lit("seat"), tv.seat().cast("string")))
    return g.groupBy(PERF, F.col("seat").alias(DEV), sc.bin_start("time", DAY).alias("time")).agg(
        F.max_by("gesture", "time").alias("gesture")
    )


SEAT_GESTURES = f"""SELECT performance_id, 'seat' || {SEAT_SQL} AS device_id, {bin_sql('time', DAY)} AS time,
    max_by(gesture, time) AS gesture FROM gestures GROUP BY 1, 2, 3"""
SEATS = [f"seat{i}" for i in range(1, 5)]


@query(
    "table_gestures_wide",
    with_sql(
        f"SELECT title AS performance_id, device_id, {iso_sql('time')}, gesture FROM seats JOIN titles USING (performance_id)",
        "gestures",
        seats=SEAT_GESTURES,
        titles=TITLES,
    ),
)
def table_gestures_wide(spark, d):
    """One column per seat, written per performance, read back as rows."""
    wide = tb.gestures_wide(seat_gestures(spark, d), SEATS)
    path = tb.write_csv(titled(spark, d, wide), shared_folder(spark, "gestures"), by="title")
    return tb.read_gestures(spark, path).select(PERF, DEV, iso("time"), "gesture")


@query(
    "table_coded_targets",
    with_sql(
        f"SELECT title AS performance_id, {iso_sql('time')}, device_id, CAST(gesture AS INT) AS state FROM seats JOIN titles USING (performance_id) WHERE gesture IN (1, 2, 8)",
        "gestures",
        seats=SEAT_GESTURES,
        titles=TITLES,
    ),
)
def table_coded_targets(spark, d):
    """Code strings per seat, most of them blank, written wide and read back."""
    code = F.when(F.col("gesture") == 1, "FT").when(F.col("gesture") == 2, "ST").when(F.col("gesture") == 8, "C")
    coded = seat_gestures(spark, d).withColumn("gesture", F.coalesce(code, F.lit("")))
    wide = titled(spark, d, tb.gestures_wide(coded, SEATS))
    read = tb.read_coded_targets(spark, tb.write_csv(wide, shared_folder(spark, "codes"), by="title"))
    return read.select(PERF, iso("time"), DEV, sc.encode_gesture("code").alias("state"))


@query(
    "table_feature_vectors",
    with_sql(
        f"SELECT {iso_sql('time')}, {shown_sql()}, CAST(freq % 9 AS INT) AS gesture FROM vectors",
        "touches",
        grid=grid_sql(VECTOR, VECTOR),
        vectors=TUMBLING,
    ),
)
def table_feature_vectors(spark, d):
    """Vectors labelled ``target`` are read back with the label called ``gesture``."""
    labelled = tumbling(spark, d).drop(PERF, DEV).withColumn("target", (F.col("freq") % 9).cast("int"))
    path = tb.write_exact_csv(labelled, shared_folder(spark, "vectors"))
    return tb.read_features(spark, path).select(iso("time"), *shown(), "gesture")


@query(
    "table_design",
    with_sql(f'SELECT {iso_sql("time")}, perf_number, "group", performance, button, server, button || server AS overall FROM design', "design"),
)
def table_design(spark, d):
    rows = tv.design(spark, d).withColumn("overall", F.concat("button", "server"))
    path = tb.write_exact_csv(rows, shared_folder(spark, "design"))
    return tb.read_design(spark, path).select(
        iso("time"), "perf_number", "group", "performance", "button", "server", "overall"
    )


@query(
    "performances_discovered",
    with_sql(f"SELECT title, {iso_sql('start_time')} FROM titles", "ev", titles=TITLES),
)
def performances_discovered(spark, d):
    path = stored_csv(spark, d, tv.touches(spark, d).select(PERF, "time", DEV), "touches")
    return tb.discover_performances(spark, path, "*.csv").select("title", iso("start_time"))


@query(
    "log_files_read",
    with_sql(
        "SELECT title AS performance_id, device_id, count(*) AS n, CAST(sum(x_pos) AS DOUBLE) AS sum_x FROM touches JOIN titles USING (performance_id) GROUP BY 1, 2",
        "touches",
        titles=TITLES,
    ),
)
def log_files_read(spark, d):
    """Whole logs written to text files, read back and split."""
    path = shared_folder(spark, "logs")
    titled(spark, d, log_lines(spark, d)).write.partitionBy("title").text(path)
    touches = lg.split_touches(lg.read_log(spark, path))
    return touches.groupBy(PERF, DEV).agg(F.count(F.lit(1)).alias("n"), F.sum("x_pos").alias("sum_x"))


@query(
    "latest_apps",
    with_sql(
        f"SELECT performance_id, device_id, max_by(app_id, time) AS app_id, {iso_sql('max(time)', 'last_seen')} FROM onl GROUP BY 1, 2",
        "ev",
        onl=ONLINE_SQL,
    ),
)
def latest_apps(spark, d):
    return ms.latest_apps(online(spark, d)).select(PERF, DEV, "app_id", iso("last_seen"))


# --- study ------------------------------------------------------------------------


@query(
    "performance_lengths",
    with_sql(
        f"SELECT performance_id, {iso_sql('min(time)', 'first_touch')}, {rounded_sql('(epoch_us(max(time)) - epoch_us(min(time))) / CAST(1000000 AS DOUBLE)', 'seconds')} FROM touches GROUP BY 1",
        "touches",
    ),
)
def performance_lengths(spark, d):
    return st.performance_lengths(tv.touches(spark, d)).select(PERF, iso("first_touch"), rounded("seconds"))


PERFORMER_LENGTHS = """SELECT performance_id, device_id, f AS first_touch, (epoch_us(max(time)) - epoch_us(f)) / CAST(1000000 AS DOUBLE) AS seconds
    FROM touches JOIN (SELECT performance_id, min(time) AS f FROM touches GROUP BY 1) USING (performance_id) GROUP BY 1, 2, 3"""


@query(
    "performer_lengths",
    with_sql(f"SELECT performance_id, device_id, {iso_sql('first_touch')}, {rounded_sql('seconds')} FROM lengths", "touches", lengths=PERFORMER_LENGTHS),
)
def performer_lengths(spark, d):
    return st.performer_lengths(tv.touches(spark, d)).select(PERF, DEV, iso("first_touch"), rounded("seconds"))


@query("performers", with_sql("SELECT DISTINCT performance_id, device_id FROM touches", "touches"))
def performers(spark, d):
    return st.performers(tv.touches(spark, d))


@query(
    "raw_new_ideas",
    with_sql("SELECT performance_id, count(*) FILTER (event_type = 'new_idea') AS raw_new_ideas FROM idea_events GROUP BY 1", "idea_events"),
)
def raw_new_ideas(spark, d):
    return st.raw_new_ideas(tv.idea_events(spark, d))


@query(
    "button_changes",
    with_sql("SELECT performance_id, count(*) FILTER (label = 'CompositionStep') AS button_presses FROM app_messages GROUP BY 1", "app_messages"),
)
def button_changes(spark, d):
    return st.button_changes(tv.app_messages(spark, d))


PRESSES = """SELECT performance_id, device_id, count(label) AS button_presses FROM (SELECT DISTINCT performance_id, device_id FROM touches)
    LEFT JOIN app_messages USING (performance_id, device_id) GROUP BY 1, 2"""


@query("button_presses", with_sql("SELECT * FROM presses", "touches", "app_messages", presses=PRESSES))
def button_presses(spark, d):
    return st.button_presses(tv.touches(spark, d), tv.app_messages(spark, d))


@query(
    "performer_length_table",
    with_sql(
        f"SELECT {iso_sql('first_touch', 'time')}, {SEAT_SQL} AS seat, {rounded_sql('seconds')} FROM lengths",
        "touches",
        lengths=PERFORMER_LENGTHS,
    ),
)
def performer_length_table(spark, d):
    return st.length_table(tv.touches(spark, d), tv.seat()).select(iso("time"), "seat", rounded("seconds"))


@query(
    "design_with_presses",
    with_sql(
        f'SELECT {iso_sql("coalesce(d.time, v.time)", "time")}, coalesce(d.button, \'none\') AS button, coalesce(v.presses, -1) AS presses FROM design d FULL JOIN vals v ON d.time = v.time',
        "design",
        "touches",
        "app_messages",
        presses=PRESSES,
        vals="""SELECT f AS time, CAST(sum(button_presses) AS BIGINT) AS presses FROM presses
            JOIN (SELECT performance_id, min(time) AS f FROM touches GROUP BY 1) USING (performance_id) GROUP BY 1""",
    ),
)
def design_with_presses(spark, d):
    """Full join: some design rows have no values, some values no design row."""
    firsts = st.performance_lengths(tv.touches(spark, d)).select(PERF, F.col("first_touch").alias("time"))
    presses = st.button_presses(tv.touches(spark, d), tv.app_messages(spark, d))
    values = presses.join(firsts, PERF).groupBy("time").agg(F.sum("button_presses").alias("presses"))
    joined = st.join_design(tv.design(spark, d), values)
    return joined.select(
        iso("time"), F.coalesce("button", F.lit("none")).alias("button"), F.coalesce("presses", F.lit(-1)).alias("presses")
    )


@query(
    "button_press_table",
    with_sql(
        f"""SELECT {iso_sql('coalesce(p.time, d.time)', 'time')}, coalesce(d."group", -1) AS "group", coalesce(p.seat, -1) AS seat,
        coalesce(p.button_presses, -1) AS button_presses, coalesce(chr(ascii('A') + (d."group" - 1) * 4 + p.seat - 1), '-') AS performer
        FROM (SELECT f AS time, {SEAT_SQL} AS seat, button_presses FROM presses
              JOIN (SELECT performance_id, min(time) AS f FROM touches GROUP BY 1) USING (performance_id)) p
        FULL JOIN design d ON d.time = p.time""",
        "design",
        "touches",
        "app_messages",
        presses=PRESSES,
    ),
)
def button_press_table(spark, d):
    rows = st.press_table(tv.touches(spark, d), tv.app_messages(spark, d), tv.design(spark, d), tv.seat())
    return rows.select(
        iso("time"),
        F.coalesce("group", F.lit(-1)).alias("group"),
        F.coalesce("seat", F.lit(-1)).alias("seat"),
        F.coalesce("button_presses", F.lit(-1)).alias("button_presses"),
        F.coalesce("performer", F.lit("-")).alias("performer"),
    )


@query(
    "participants_by_seat",
    with_sql(
        f"""SELECT grp, seat, chr(ascii('A') + (grp - 1) * 4 + seat - 1) AS participant, count(*) AS n FROM
        (SELECT CAST(performance_id % 4 + 1 AS INT) AS grp, {SEAT_SQL} AS seat FROM touches) GROUP BY 1, 2, 3""",
        "touches",
    ),
)
def participants_by_seat(spark, d):
    seated = tv.touches(spark, d).select((F.col(PERF) % 4 + 1).cast("int").alias("grp"), tv.seat().alias("seat"))
    return seated.groupBy("grp", "seat", sc.participant("grp", "seat").alias("participant")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "seats_of_devices",
    with_sql(
        """SELECT coalesce(seat, -1) AS seat, count(*) AS n FROM (SELECT CASE CAST(device_id AS INT) % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 END AS seat
        FROM touches) GROUP BY 1""",
        "touches",
    ),
)
def seats_of_devices(spark, d):
    """Test devices renamed to study tablets (and one unknown) before the lookup."""
    tablets = dict(enumerate([*ms.dims.DEVICE_SEATS, "unknown"]))
    named = tv.touches(spark, d).withColumn(DEV, sc.lookup((F.col(DEV).cast("int") % 5), tablets))
    return ms.with_seat(named).groupBy(F.coalesce("seat", F.lit(-1)).alias("seat")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "performance_summary",
    with_sql(
        f"""SELECT p.performance_id, {iso_sql('first_touch')}, raw_new_ideas, new_idea_changes, button_presses,
        {rounded_sql('coalesce(flux, 0)', 'flux')}, {rounded_sql('coalesce(entropy, -1)', 'entropy')}
        FROM (SELECT performance_id, min(time) AS first_touch FROM touches GROUP BY 1) p
        LEFT JOIN (SELECT performance_id, count(*) FILTER (event_type = 'new_idea') AS raw_new_ideas FROM idea_events GROUP BY 1) USING (performance_id)
        LEFT JOIN (SELECT performance_id, count(time) AS new_idea_changes FROM kept GROUP BY 1) USING (performance_id)
        LEFT JOIN (SELECT performance_id, count(*) FILTER (label = 'CompositionStep') AS button_presses FROM app_messages GROUP BY 1) USING (performance_id)
        LEFT JOIN measures USING (performance_id)""",
        "touches",
        "idea_events",
        "app_messages",
        "gestures",
        ideas="SELECT performance_id, time FROM idea_events WHERE event_type = 'new_idea'",
        kept=DEBOUNCE,
        daily=DAILY,
        complete=COMPLETE.replace("g.*", "g.performance_id, g.device_id, g.time, g.gesture"),
        steps=tv.steps_sql("complete", "full"),
        whole=WHOLE,
        shares=SHARES,
        measures=ENSEMBLE,
    ),
)
def performance_summary(spark, d):
    out = st.performance_summary(
        tv.touches(spark, d), tv.idea_events(spark, d), tv.app_messages(spark, d), daily(spark, d), gap_seconds=GAP
    )
    return out.select(
        PERF,
        iso("first_touch"),
        "raw_new_ideas",
        "new_idea_changes",
        "button_presses",
        rounded("flux"),
        rounded(F.coalesce("entropy", F.lit(-1.0)), "entropy"),
    )


@query(
    "performers_united",
    with_sql(
        "SELECT performance_id, device_id, count(*) AS n FROM (SELECT performance_id, device_id FROM touches UNION ALL SELECT performance_id, device_id FROM gestures) GROUP BY 1, 2",
        "touches",
        "gestures",
    ),
)
def performers_united(spark, d):
    both = tv.touches(spark, d).select(PERF, DEV).unionByName(tv.gestures(spark, d).select(DEV, PERF))
    return both.groupBy(PERF, DEV).agg(F.count(F.lit(1)).alias("n"))


@query(
    "measures_melted",
    with_sql(
        """SELECT performance_id, 'mean_x' AS variable, round(avg(x_pos), 6) AS value FROM touches GROUP BY 1
        UNION ALL SELECT performance_id, 'mean_y', round(avg(y_pos), 6) FROM touches GROUP BY 1""",
        "touches",
    ),
)
def measures_melted(spark, d):
    wide = tv.touches(spark, d).groupBy(PERF).agg(F.avg("x_pos").alias("mean_x"), F.avg("y_pos").alias("mean_y"))
    return st.melt(wide, [PERF], ["mean_x", "mean_y"]).select(PERF, "variable", rounded("value"))


@query(
    "gestures_pivoted",
    with_sql(
        f"""SELECT performance_id, {iso_sql('time')}, """
        + ", ".join(f"coalesce(max(CASE WHEN device_id = '{s}' THEN gesture END), -1) AS {s}" for s in SEATS)
        + " FROM seats GROUP BY performance_id, seats.time",
        "gestures",
        seats=SEAT_GESTURES,
    ),
)
def gestures_pivoted(spark, d):
    wide = st.pivot_first(seat_gestures(spark, d), [PERF, "time"], DEV, "gesture", SEATS)
    return wide.select(PERF, iso("time"), *[F.coalesce(s, F.lit(-1)).alias(s) for s in SEATS])
