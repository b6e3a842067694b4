"""Joins of many rows with a table of one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def with_side(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` joined with ``side``, which has one row per key.

    The side is counted, and broadcast if it has at most BROADCAST_ROWS rows, so
    the rows of ``df`` stay where they are. A larger side joins by Spark's own
    plan, where the adaptive skew join splits a hot key.
    """
    few = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(side) if few else side, list(keys), how)
