"""Session settings and the shared working folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="fluxweave-")


def build_session(app: str = "fluxweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on.

    Cluster-sized settings (executors, memory, shuffle partitions) belong to
    the submitter; only semantics (time zone) and adaptive planning are set.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, under the folder the cluster shares.

    ``spark.checkpoint.dir`` names that folder. Where it is unset (tests on one
    machine) one temporary folder is made per process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names; any failure to look is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
