"""CSV tables of performances: readers, writers and the performance key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave import schemas
from fluxweave.dims import DEV, PERF
from fluxweave.operators.sides import with_side
from fluxweave.session import shared_folder

# --- fixed values: file name and timestamp formats
TITLE_PATTERN = r"(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-[A-Za-z0-9]+)"
TITLE_TIME = "yyyy-MM-dd'T'HH-mm-ss"
ROW_TIME = "yyyy-MM-dd'T'HH:mm:ss"
HEADER_MARK = "centroid_x"
KINDS = "touches|events|gestures|messages|online|transitions|gesturetargets"
# --- end of fixed values


def title_of(path: str | Column) -> Column:
    """Performance title in a file path: a start time and a log name."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(c, TITLE_PATTERN, 1)


def performance_of(path: str | Column) -> Column:
    """Performance key of a file: its title, else its name without kind and ending."""
    c = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(c, rf"([^/]+?)(?:-(?:{KINDS}))?(?:\.[A-Za-z]+)?$", 1)
    return F.coalesce(F.nullif(title_of(c), F.lit("")), name)


def start_of(title: str | Column) -> Column:
    """Start time in a performance title (its first 19 characters)."""
    c = F.col(title) if isinstance(title, str) else title
    return F.try_to_timestamp(F.substring(c, 1, 19), F.lit(TITLE_TIME))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn(PERF, performance_of("_metadata.file_path"))


def read_table(spark: SparkSession, path: str | list[str], schema: str, keyed: bool = True) -> DataFrame:
    """One kind of table for all performances under ``path`` at once."""
    df = spark.read.schema(schema).option("header", "true").csv(path)
    return _keyed(df) if keyed else df


def read_touches(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.TOUCHES)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.EVENTS)


def read_app_messages(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.APP_MESSAGES)


def read_online(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.ONLINE)


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.TRANSITIONS)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.TARGETS)


def read_design(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.DESIGN, keyed=False)


def wide_to_long(wide: DataFrame, ids: list[str], name: str, value: str) -> DataFrame:
    """Per-device columns to rows; empty cells are dropped."""
    devices = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, devices, name, value).filter(F.col(value).isNotNull())


def _with_own_header(spark: SparkSession, path: str, is_header: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, headers): every file's rows as ``cells`` beside its header's ``names``, as arrays of one length, the widest header's.

    ``is_header`` tells header lines by their text ``value``. They are written
    once, a row per file (the first of its header lines counts), and brought to
    the rows, which stay where they are. Spark's CSV parser cuts both, so cells
    may be quoted and hold commas. A file without a header gives no rows.
    """
    found = spark.read.text(path).filter(is_header).select(F.col("_metadata.file_path").alias("__file"), "value", F.monotonically_increasing_id().alias("__at"))
    first = found.groupBy("__file").agg(F.min_by("value", "__at").alias("value"))
    written = shared_folder(spark, "headers")
    first.write.parquet(written)
    headers = spark.read.schema(first.schema).parquet(written)
    width = headers.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    columns = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{c} STRING" for c in columns)
    named = headers.select("__file", F.from_csv("value", F.lit(schema)).alias("h")).select("__file", F.array(*[f"h.{c}" for c in columns]).alias("names"))
    rows = spark.read.schema(schema).csv(path).select(F.col("_metadata.file_path").alias("__file"), F.array(*columns).alias("cells"))
    return with_side(rows, named, ["__file"]), named


def read_wide(spark: SparkSession, path: str, value: str, value_type: str) -> DataFrame:
    """Tables with one column per device, as long rows; empty cells are dropped.

    Every performance has its own devices, so each file's header names the cells
    of that file's rows; nothing about the columns but their greatest number is
    needed on the driver.
    """
    rows, _ = _with_own_header(spark, path, F.col("value").rlike('^"?time"?(,|$)'))
    cells = F.filter(F.arrays_zip("names", "cells"), lambda c, i: (i > 0) & c["names"].isNotNull() & (F.trim(F.coalesce(c["cells"], F.lit(""))) != ""))
    own_rows = ~F.get("cells", F.lit(0)).eqNullSafe("time")
    each = rows.filter(own_rows).select("__file", F.get("cells", F.lit(0)).alias("time"), F.explode(cells).alias("c"))
    return each.select(
        performance_of("__file").alias(PERF),
        F.try_to_timestamp("time").alias("time"),
        F.col("c.names").alias(DEV),
        F.col("c.cells").try_cast(value_type).alias(value),
    )


def read_gestures(spark: SparkSession, path: str) -> DataFrame:
    return read_wide(spark, path, "gesture", "int")


def read_coded_targets(spark: SparkSession, path: str) -> DataFrame:
    return read_wide(spark, path, "code", "string")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Labelled feature vectors; the label may be called ``target`` or ``gesture``.

    Every file is read by the names in its own header, in whatever order they
    stand; the first column is the time. A column that a file lacks is NULL;
    one that no file has is absent.
    """
    rows, headers = _with_own_header(spark, path, F.col("value").contains(HEADER_MARK))
    present = {r[0] for r in headers.select(F.explode(F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))))).distinct().collect()}
    if not present:
        raise ValueError(f"no header with {HEADER_MARK} under {path}")
    unknown = present - {None, *schemas.FEATURE_TYPES}
    if unknown:
        raise ValueError(f"columns without a type: {sorted(unknown)}")

    def column(name: str) -> Column:
        return F.get("cells", F.array_position("names", F.lit(name)).cast("int") - 1).try_cast(schemas.FEATURE_TYPES[name])

    labels = {"target", "gesture"}
    named = [column(c).alias(c) for c in schemas.FEATURE_TYPES if c in present and c not in labels]
    named += [F.coalesce(*[column(c) for c in schemas.FEATURE_TYPES if c in present & labels]).alias("gesture")] if present & labels else []
    is_header = F.array_contains("cells", HEADER_MARK)
    own_rows = rows.filter(~F.coalesce(is_header, F.lit(False)))
    return own_rows.select(F.try_to_timestamp(F.get("cells", F.lit(0))).alias("time"), *named)


def discover_performances(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Performances found under a path, with the start time of each title."""
    # only the listing is used; file contents are pruned away
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    titles = files.select(title_of("path").alias("title")).filter("title <> ''").distinct()
    return titles.select("title", start_of("title").alias("start_time"))


def _write(df: DataFrame, path: str, by: str | None, time_format: str) -> str:
    # rebalancing gathers a performance's rows into few files and lets Spark
    # split one that is too large for a task
    spread = df.hint("rebalance", F.col(by)) if by else df
    writer = spread.write.mode("overwrite").option("header", "true").option("timestampFormat", time_format)
    (writer.partitionBy(by) if by else writer).csv(path)
    return path


def write_csv(df: DataFrame, path: str, by: str | None = PERF) -> str:
    """CSV with a header and second-precision times, one folder per performance."""
    return _write(df, path, by, ROW_TIME)


def write_exact_csv(df: DataFrame, path: str, by: str | None = None) -> str:
    """CSV with microsecond times."""
    return _write(df, path, by, ROW_TIME + ".SSSSSS")


def gestures_wide(gestures: DataFrame, devices: list[str] | None = None) -> DataFrame:
    """One column per device, for export. ``devices`` fixes the columns."""
    pivoted = gestures.groupBy(PERF, "time").pivot(DEV, devices) if devices else gestures.groupBy(PERF, "time").pivot(DEV)
    return pivoted.agg(F.max("gesture"))
