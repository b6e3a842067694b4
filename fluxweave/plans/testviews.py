"""Session tables seen in the given test tables, for Spark and for SQL.

The event table supplies touches, gestures and messages; line items supply a
longer state sequence. Events lie minutes apart, so widths are given in hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.dims import DEV, PERF

HOUR, DAY = 3600, 86400
WIDTH, TRAIL = 6 * HOUR, 15 * HOUR  # stand for 15 s and 37 s
TICK, VECTOR = 6 * HOUR, 30 * HOUR  # stand for 1 s and 5 s
CHUNK = 7 * DAY
GAP = 6 * HOUR  # stands for 10 s
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    return raw.select(
        "event_id",
        (F.col("user_id") % 10).alias(PERF),
        F.col("ts").cast("timestamp").alias("time"),
        F.col("user_id").cast("string").alias(DEV),
        "user_id",
        "event_type",
        "value",
        "props",
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        PERF,
        "time",
        DEV,
        (F.col("event_id") * 37 % 1024).cast("double").alias("x_pos"),
        (F.col("event_id") * 53 % 768).cast("double").alias("y_pos"),
        F.when(F.col("event_id") % 4 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("velocity"),
    )


def gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States 0..10: 9 is the unsure state and 10 is in no map."""
    return events(spark, sf_dir).select(
        PERF, "time", DEV, (F.floor("value").cast("int") % 11).alias("gesture")
    )


def idea_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        PERF,
        "time",
        F.lit("LiveProc").alias("name"),
        F.when(F.col("event_type") == "purchase", "new_idea").otherwise(F.col("event_type")).alias("event_type"),
    )


def app_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third message has no label; views step the composition."""
    e = events(spark, sf_dir)
    label = F.when(F.col("event_type") == "view", "CompositionStep").otherwise(F.col("event_type"))
    return e.select(
        PERF,
        "time",
        F.lit("ensemble").alias("type"),
        DEV,
        F.when(F.col("event_id") % 3 != 0, label).alias("label"),
        F.get_json_object("props", "$.k").alias("value"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for gestures per performance: every fifth row is labelled bad."""
    e = events(spark, sf_dir).filter(F.col("event_type") == "signup")
    asked = F.when(F.col("event_id") % 5 == 0, 100).otherwise(F.floor("value").cast("int") % 9)
    return e.select(PERF, "time", asked.cast("int").alias("target"))


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One design row per performance, keyed by its first event that is no view.

    Where a performance opens with a view, that is not its first touch, so the
    design row and the values of the performance do not meet.
    """
    opening = F.when(F.col("event_type") != "view", F.col("time"))
    first = events(spark, sf_dir).groupBy(PERF).agg(F.min(opening).alias("time"))
    p = F.col(PERF)
    return first.select(
        "time",
        p.cast("int").alias("perf_number"),
        (p % 4 + 1).cast("int").alias("group"),
        (p % 3 + 1).cast("int").alias("performance"),
        F.when(p % 2 == 0, "ButtonOff").otherwise("ButtonOn").alias("button"),
        F.when(p % 4 < 2, "ServerOff").otherwise("ServerOn").alias("server"),
    )


def supply_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long state sequences: one device per supplier, one row per line item."""
    li = table(spark, sf_dir, "lineitem")
    within_day = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 20011 + F.col("l_partkey")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return li.select(
        (F.col("l_suppkey") % 10).alias(PERF),
        F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + within_day).alias("time"),
        F.col("l_suppkey").cast("string").alias(DEV),
        (flag * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).cast("int").alias("gesture"),
    )


def seat() -> Column:
    """Seat 1..4 of a test device."""
    return (F.floor(F.col(DEV).cast("long") / 10) % 4 + 1).cast("int")


# --- the same tables in SQL -------------------------------------------------

SQL_VIEWS = {
    "ev": """SELECT event_id, user_id % 10 AS performance_id, ts AS time, CAST(user_id AS VARCHAR) AS device_id,
        user_id, event_type, value, props FROM events""",
    "touches": """SELECT performance_id, time, device_id, CAST(event_id * 37 % 1024 AS DOUBLE) AS x_pos,
        CAST(event_id * 53 % 768 AS DOUBLE) AS y_pos,
        CASE WHEN event_id % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS velocity FROM ev""",
    "gestures": """SELECT performance_id, time, device_id, CAST(floor(value) AS INT) % 11 AS gesture FROM ev""",
    "idea_events": """SELECT performance_id, time, 'LiveProc' AS name,
        CASE WHEN event_type = 'purchase' THEN 'new_idea' ELSE event_type END AS event_type FROM ev""",
    "app_messages": """SELECT performance_id, time, 'ensemble' AS type, device_id,
        CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_type = 'view' THEN 'CompositionStep' ELSE event_type END END
        AS label, regexp_extract(props, '"k": *([0-9]+)', 1) AS value FROM ev""",
    "targets": """SELECT performance_id, time,
        CASE WHEN event_id % 5 = 0 THEN 100 ELSE CAST(floor(value) AS INT) % 9 END AS target
        FROM ev WHERE event_type = 'signup'""",
    "design": """SELECT min(time) FILTER (event_type <> 'view') AS time, CAST(performance_id AS INT) AS perf_number,
        CAST(performance_id % 4 + 1 AS INT) AS "group", CAST(performance_id % 3 + 1 AS INT) AS performance,
        CASE WHEN performance_id % 2 = 0 THEN 'ButtonOff' ELSE 'ButtonOn' END AS button,
        CASE WHEN performance_id % 4 < 2 THEN 'ServerOff' ELSE 'ServerOn' END AS server
        FROM ev GROUP BY performance_id""",
    "supply_states": """SELECT l_suppkey % 10 AS performance_id,
        make_timestamp(epoch_us(l_shipdate) + (l_orderkey * 8 + l_linenumber) * 20011 + l_partkey) AS time,
        CAST(l_suppkey AS VARCHAR) AS device_id,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2
        + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS gesture FROM lineitem""",
}
NEEDS = {
    "touches": ["ev"],
    "gestures": ["ev"],
    "idea_events": ["ev"],
    "app_messages": ["ev"],
    "targets": ["ev"],
    "design": ["ev"],
}

GROUP_OF = (
    "CASE WHEN {g} = 0 THEN 0 WHEN {g} IN (1, 2) THEN 1 WHEN {g} IN (3, 4) THEN 2 "
    "WHEN {g} IN (5, 6, 7) THEN 3 WHEN {g} IN (8, 9) THEN 4 END"
)
FULL_OF = "CASE WHEN {g} BETWEEN 0 AND 8 THEN {g} END"


def bin_sql(c: str, width: int) -> str:
    us = width * 1_000_000
    return f"make_timestamp(epoch_us({c}) - epoch_us({c}) % {us})"


def steps_sql(source: str = "gestures", states: str = "group") -> str:
    """Pairs of consecutive states per device."""
    mapped = (GROUP_OF if states == "group" else FULL_OF).format(g="gesture")
    return f"""SELECT performance_id, time, device_id, prev_time,
        CASE WHEN s IS NOT NULL AND p IS NOT NULL THEN s END AS to_state,
        CASE WHEN s IS NOT NULL AND p IS NOT NULL THEN p END AS from_state
        FROM (SELECT *, lag(s) OVER w AS p, lag(time) OVER w AS prev_time
              FROM (SELECT *, {mapped} AS s FROM {source})
              WINDOW w AS (PARTITION BY performance_id, device_id ORDER BY time))"""


def with_sql(body: str, *views: str, **extra: str) -> str:
    """A SQL string that defines the needed views, then extra ones, before its body."""
    ordered: list[str] = []
    for v in views:
        for need in [*NEEDS.get(v, []), v]:
            if need not in ordered:
                ordered.append(need)
    parts = [f"{v} AS ({SQL_VIEWS[v]})" for v in ordered] + [f"{k} AS ({v})" for k, v in extra.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
