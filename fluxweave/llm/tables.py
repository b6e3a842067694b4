"""Reading the given tables and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxweave.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(df: DataFrame, **columns: str | T.DataType) -> T.StructType:
    """The schema of ``df`` and more columns (types or their DDL), as a new object."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out = out.add(name, T.StructType.fromDDL(f"c {kind}")[0].dataType if isinstance(kind, str) else kind)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that lost executors recompute nothing before it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LOCAL = "^file:/+"  # Spark writes local paths with one slash and with three
ROW_BITS = 40  # of a place; what is above them numbers the file


def with_place(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a long column ``name`` that orders the rows as its Parquet files hold them, whatever order they are read in.

    Files follow the numbers in their names (Spark's part and file numbers),
    then the paths; a place is the file's number and the row's index in it. Rows
    that do not come straight from files follow the partitions of ``df``. A
    column that is already called ``name`` is replaced.
    """
    plain = df.drop(name)
    try:
        placed = plain.select(*plain.columns, F.regexp_replace("_metadata.file_path", LOCAL, "file:/").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        placed.schema  # noqa: B018  analyses the columns
    except AnalysisException:
        return plain.withColumn(name, F.monotonically_increasing_id())
    files = sorted({re.sub(LOCAL, "file:/", f) for f in df.inputFiles()}, key=_file_order)
    numbers = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "__file string, __number long")
    place = F.coalesce(F.shiftleft("__number", ROW_BITS) + F.col("__row"), F.raise_error(F.concat(F.lit("not among the input files: "), "__file")).cast("long"))
    return placed.join(F.broadcast(numbers), "__file", "left").select(*plain.columns, place.alias(name))


def _file_order(path: str) -> tuple:
    part = re.match(r"part-(\d+)-.*?(?:-c(\d+))?(?:\.|$)", path.rsplit("/", 1)[-1])
    return (int(part[1]), int(part[2] or 0), path) if part else (-1, 0, path)
