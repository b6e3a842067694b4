"""Analysis-server logs: one text line per message, split into typed tables.

Every splitter takes lines ``(performance_id, value)`` and works on the whole
archive at once. Splitters are independent filters: a line may feed several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.dims import DEV, ENSEMBLE_STATES, PERF
from fluxweave.sources.formats import DEFAULT_FORMAT, LogFormat
from fluxweave.sources.tables import performance_of

# --- fixed values: tags of the log lines
TOUCH_TAG, ENDED_TAG, SWITCH_TAG, ACCEL_TAG = "touch", "touch/ended", "switch", "accel"
GESTURES_ADDRESS = "/classifier/gestures"
ERROR_ADDRESS = "/classifier/error"
# --- end of fixed values


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(performance_of("_metadata.file_path").alias(PERF), "value")


def _line() -> Column:
    return F.replace("value", F.lit(" "), F.lit(""))


def _fields(lines: DataFrame, line: Column, condition: Column) -> DataFrame:
    return lines.filter(condition).select(PERF, F.split(line, ",").alias("f"))


def _at(i: int, kind: str = "string") -> Column:
    c = F.get("f", F.lit(i))
    if kind == "timestamp":
        return F.try_to_timestamp(c)
    return c if kind == "string" else c.try_cast(kind)


def _project(fields: DataFrame, names: dict[str, str]) -> DataFrame:
    return fields.select(PERF, *[_at(i, kind).alias(name) for i, (name, kind) in enumerate(names.items())])


def split_touches(lines: DataFrame) -> DataFrame:
    line = _line()
    body = F.replace(line, F.lit(f"{TOUCH_TAG},"), F.lit(""))
    return _project(
        _fields(lines, body, line.contains(f"{TOUCH_TAG},")),
        {"time": "timestamp", DEV: "string", "x_pos": "double", "y_pos": "double", "velocity": "double"},
    )


def split_events(lines: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    line = _line()
    named = F.lit(False)
    for server in fmt.servers:
        named = named | line.contains(server)
    return _project(_fields(lines, line, named), {"time": "timestamp", "name": "string", "event_type": "string"})


def split_app_messages(lines: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    line = _line()
    return _project(
        _fields(lines, line, line.contains(f"{fmt.namespace},")),
        {"time": "timestamp", "type": "string", DEV: "string", "label": "string", "value": "string"},
    )


def split_online(lines: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    line = _line()
    return _project(
        _fields(lines, line, line.contains(fmt.address("online"))),
        {"time": "timestamp", "type": "string", DEV: "string", "app_id": "string"},
    )


def split_transitions(lines: DataFrame) -> DataFrame:
    line = _line()
    return _project(
        _fields(lines, line, line.rlike("|".join(ENSEMBLE_STATES))),
        {"time": "timestamp", "transition_type": "string", "spread": "double", "ratio": "double"},
    )


def _device_pairs(fields: DataFrame, value: str, kind: str) -> DataFrame:
    """``time, device, value, device, value, ...`` to one row per device.

    Lines may name any number of devices; one that is absent simply has no row.
    """
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((F.size("f") - 1) / 2).cast("int"))),
        lambda i: F.struct(F.get("f", 2 * i - 1).alias("device"), F.get("f", 2 * i).alias("value")),
    )
    each = fields.select(PERF, _at(0, "timestamp").alias("time"), F.explode(pairs).alias("p"))
    return each.filter(F.col("p.value").isNotNull()).select(
        PERF, "time", F.col("p.device").alias(DEV), F.col("p.value").try_cast(kind).alias(value)
    )


def split_gestures(lines: DataFrame) -> DataFrame:
    line = _line()
    body = F.replace(line, F.lit(f"{GESTURES_ADDRESS},"), F.lit(""))
    return _device_pairs(_fields(lines, body, line.contains(GESTURES_ADDRESS)), "gesture", "int")


def split_targets(lines: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    """Asked-for gestures; empty when the log holds none."""
    line, address = _line(), fmt.address("targetgesture")
    body = F.replace(line, F.lit(f"{address},"), F.lit(""))
    return _project(_fields(lines, body, line.contains(address)), {"time": "timestamp", "target": "int"})


def line_kinds(fmt: LogFormat = DEFAULT_FORMAT) -> Column:
    """All tables a line belongs to; the splitters' conditions in one array."""
    line = _line()
    named = F.lit(False)
    for server in fmt.servers:
        named = named | line.contains(server)
    rules = {
        "touches": line.contains(f"{TOUCH_TAG},"),
        "events": named,
        "messages": line.contains(f"{fmt.namespace},"),
        "online": line.contains(fmt.address("online")),
        "transitions": line.rlike("|".join(ENSEMBLE_STATES)),
        "gestures": line.contains(GESTURES_ADDRESS),
        "gesturetargets": line.contains(fmt.address("targetgesture")),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(kind)) for kind, rule in rules.items()]))


def store_by_kind(lines: DataFrame, path: str, fmt: LogFormat = DEFAULT_FORMAT) -> str:
    """Lines written once, one folder per kind, so that a splitter reads only its own lines."""
    routed = lines.select(PERF, F.explode(line_kinds(fmt)).alias("kind"), "value")
    # gathered by kind, so that an input task does not open a file for every kind; a large kind is split
    routed.hint("rebalance", F.col("kind")).write.mode("overwrite").partitionBy("kind").parquet(path)
    return path


def legacy_gestures(lines: DataFrame, separator: str = ", ") -> DataFrame:
    """Older gesture logs: no address, fields parted by comma and space, a header line."""
    fields = lines.filter(~F.col("value").contains("time")).select(PERF, F.split("value", separator).alias("f"))
    return _device_pairs(fields, "gesture", "int")


def iso_time(time: str | Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def format_line(*parts: str | Column, fmt: LogFormat = DEFAULT_FORMAT) -> Column:
    """A log line from its parts; the first is the time."""
    first, *rest = parts
    cells = [F.col(p) if isinstance(p, str) else p for p in rest]
    return F.concat_ws(fmt.separator, iso_time(first), *[c.cast("string") for c in cells])


def touch_lines(touches: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    return touches.select(
        PERF, format_line("time", F.lit(TOUCH_TAG), DEV, "x_pos", "y_pos", "velocity", fmt=fmt).alias("value")
    )


def event_lines(events: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    return events.select(PERF, format_line("time", "name", "event_type", fmt=fmt).alias("value"))


def app_lines(messages: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    return messages.select(
        PERF, format_line("time", F.lit(fmt.namespace), DEV, "label", "value", fmt=fmt).alias("value")
    )


def online_lines(online: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    return online.select(PERF, format_line("time", F.lit(fmt.address("online")), DEV, "app_id", fmt=fmt).alias("value"))


def transition_lines(transitions: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    return transitions.select(PERF, format_line("time", "transition_type", "spread", "ratio", fmt=fmt).alias("value"))


def target_lines(targets: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    return targets.select(
        PERF, format_line("time", F.lit(fmt.address("targetgesture")), "target", fmt=fmt).alias("value")
    )


def gesture_lines(gestures: DataFrame, fmt: LogFormat = DEFAULT_FORMAT, address: str | None = GESTURES_ADDRESS) -> DataFrame:
    """One line per time with every device's gesture, devices in order.

    A line holds the players of one performance, so the list stays short.
    """
    pairs = F.array_sort(F.collect_list(F.struct(DEV, "gesture")))
    rows = gestures.groupBy(PERF, "time").agg(pairs.alias("p"))
    body = F.array_join(
        F.transform("p", lambda p: F.concat_ws(fmt.separator, p[DEV], p["gesture"].cast("string"))), fmt.separator
    )
    parts = [F.lit(address), body] if address else [body]
    return rows.select(PERF, format_line("time", *parts, fmt=fmt).alias("value"))
