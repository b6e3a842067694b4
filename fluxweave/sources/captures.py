"""Captured message streams of older recorders, and other file layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.dims import DEV, PERF, SCREEN_HEIGHT, SCREEN_WIDTH
from fluxweave.functions.scalars import SECOND
from fluxweave.sources.formats import DEFAULT_FORMAT, LogFormat

# --- fixed values: shapes of the captures
# seconds [ /address, device, x, y, velocity ] a NetAddr(ip, port)
BRACKET_NOISE = r"[\[\],)]|a NetAddr\("
# seconds ip <Class (/address) ( "device", x, y, velocity )>
RECORD_NOISE = r"[\",\n\r]|<\w* ?\(|\) \(|\)>|\)$"
RECORD_END = ">"
MINUTE_TITLE, MINUTE_TIME = r"(\d{8}-\d{2}h\d{2})(?!m)", "yyyyMMdd-HH'h'mm"
SECOND_TITLE, SECOND_TIME = r"(\d{8}-\d{2}h\d{2}m\d{2}s)", "yyyyMMdd-HH'h'mm'm'ss's'"
# --- end of fixed values


def capture_start(path: str | Column, to_second: bool) -> Column:
    """Start time written in a capture's file name."""
    c = F.col(path) if isinstance(path, str) else path
    pattern, layout = (SECOND_TITLE, SECOND_TIME) if to_second else (MINUTE_TITLE, MINUTE_TIME)
    return F.try_to_timestamp(F.regexp_extract(c, pattern, 1), F.lit(layout))


def read_capture(spark: SparkSession, path: str, multi_line: bool = False, to_second: bool = True) -> DataFrame:
    """Raw records with the start time of their file."""
    reader = spark.read.option("lineSep", RECORD_END) if multi_line else spark.read
    start = capture_start("_metadata.file_path", to_second)
    return reader.text(path).select(F.col("_metadata.file_path").alias(PERF), start.alias("start"), "value")


def _words(noise: str) -> Column:
    return F.split(F.trim(F.regexp_replace(F.regexp_replace("value", noise, " "), r"\s+", " ")), " ")


def bracket_words() -> Column:
    return _words(BRACKET_NOISE)


def record_words() -> Column:
    return _words(RECORD_NOISE)


def _touches(words: DataFrame, address_at: int, fmt: LogFormat) -> DataFrame:
    def w(i: int) -> Column:
        return F.get("w", F.lit(address_at + i))

    offset = F.round(F.get("w", F.lit(0)).try_cast("double") * SECOND).cast("long")
    return words.filter(w(0) == fmt.address("touch")).select(
        PERF,
        F.timestamp_micros(F.unix_micros("start") + offset).alias("time"),
        w(1).alias(DEV),
        w(2).try_cast("double").alias("x_pos"),
        w(3).try_cast("double").alias("y_pos"),
        w(4).try_cast("double").alias("velocity"),
    )


def bracket_touches(records: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    """Touches of a bracketed capture, timed from the file's start."""
    return _touches(records.select(PERF, "start", bracket_words().alias("w")), 1, fmt)


def record_touches(records: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    """Touches of a record capture (records may span lines)."""
    return _touches(records.select(PERF, "start", record_words().alias("w")), 2, fmt)


def record_text(records: DataFrame) -> DataFrame:
    """Every record of a capture as one plain space-separated line."""
    words = records.select(PERF, record_words().alias("w"))
    return words.select(PERF, F.array_join("w", " ").alias("value")).filter("value <> ''")


def bracket_text(records: DataFrame) -> DataFrame:
    """Every bracketed message space-separated: port dropped, sender moved to second place."""
    words = records.select(PERF, bracket_words().alias("w")).withColumn("n", F.size("w")).filter("n >= 3")
    rearranged = F.concat(
        F.slice("w", 1, 1), F.slice("w", F.col("n") - 1, F.lit(1)), F.slice("w", F.lit(2), F.col("n") - 3)
    )
    return words.select(PERF, F.array_join(rearranged, " ").alias("value"))


def unit_square_touches(records: DataFrame, uids: DataFrame, fmt: LogFormat = DEFAULT_FORMAT) -> DataFrame:
    """Touches in unit coordinates with numeric users, times relative to the capture.

    ``uids`` maps device_id to uid.
    """
    def w(i: int) -> Column:
        return F.get("w", F.lit(i))

    words = records.select(PERF, bracket_words().alias("w")).filter(w(1) == fmt.address("touch"))
    flat = words.select(
        PERF,
        w(0).try_cast("double").alias("time"),
        w(2).alias(DEV),
        F.lit(1).alias("gid"),
        F.lit(1).alias("mode"),
        (w(3).try_cast("double") / SCREEN_WIDTH).alias("x"),
        (w(4).try_cast("double") / SCREEN_HEIGHT).alias("y"),
    )
    return flat.join(uids, DEV, "left").select(PERF, "time", "uid", "gid", "mode", "x", "y")


def redate_coding(rows: DataFrame, start: str = "start", offset: str = "offset") -> DataFrame:
    """``m:s`` offsets of a coding file as absolute times."""
    parts = F.split(offset, ":")
    seconds = F.get(parts, F.lit(0)).try_cast("double") * 60 + F.get(parts, F.lit(1)).try_cast("double")
    time = F.timestamp_micros(F.unix_micros(start) + F.round(seconds * SECOND).cast("long"))
    return rows.filter(F.col(offset) != "time").withColumn("time", time)


def coding_grid(lengths: DataFrame, step: int = 5, length: str = "seconds") -> DataFrame:
    """Empty coding form: one row per step from 0 up to (not including) the length."""
    last = F.ceil(F.col(length) / step).cast("int") - 1
    steps = lengths.filter(F.col(length) > 0).select(PERF, F.explode(F.sequence(F.lit(0), last)).alias("i"))
    at = F.col("i") * step
    # the label shows minutes of the hour and seconds
    label = F.concat_ws(":", (F.floor(at / 60) % 60).cast("string"), (at % 60).cast("string"))
    return steps.select(PERF, at.alias("second"), label.alias("label"), F.lit(None).cast("string").alias("code"))
