"""Sums of fixed-size arrays over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNKS = 64


def array_total(df: DataFrame, size: int, parts: Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]]) -> np.ndarray:
    """Sum of the integer arrays (``size`` numbers each, a multiple of CHUNKS) that ``parts`` makes from the batches of a task.

    Every task sends its own sum in chunks; each chunk is summed as a stream.
    What reaches the driver is one array of the fixed size, whatever the input.
    """
    step = size // CHUNKS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for part in parts(batches):
            held += part
        narrow = held.astype(np.int32) if size and np.abs(held).max() < 2**31 else held
        for chunk in range(CHUNKS):
            values = narrow[chunk * step : (chunk + 1) * step].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([values], pa.binary())], ["chunk", "part"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("part").to_pylist()):
                values = np.frombuffer(part, np.int32 if len(part) == 4 * step else np.int64).astype(np.int64)
                sums[chunk] = sums[chunk] + values if chunk in sums else values
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "part"]
            )

    schema = "chunk int, part binary"
    rows = df.mapInArrow(partial, schema).repartition(CHUNKS, "chunk").mapInArrow(total, schema).collect()
    out = np.zeros(size, np.int64)
    for chunk, part in rows:
        out[chunk * step : (chunk + 1) * step] = np.frombuffer(part, np.int64)
    return out
