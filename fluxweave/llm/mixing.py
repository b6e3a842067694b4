"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

The documents of a source are cut into blocks of ``block_rows``. With a weight
of w, block i of the source may run from slot floor(i / w) on and must run
before slot ceil((i + 1) / w); one block runs in each slot. Earliest deadline
first gives every block a slot inside its window, so that after any number of
slots no source is a whole block ahead of or behind its share.

Weights are whole numbers over their sum, without rounding: a float is a
fraction with a power of two below it, and Python's integers hold their common
denominator. So the deviation is against the weights as given, however long the
mix is. Each slot follows from those before it, so one task walks through the
blocks of the whole run, with one block of every source in memory, and gives
out slots in batches of BATCH_BLOCKS; the rows are numbered and joined to their
blocks by all tasks. While all sources last, any prefix of the mix has the
target weights; a source that ends leaves its slots to blocks that are already
released, and the others keep their windows. Every row appears once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.llm.tables import stored, table
from fluxweave.operators.ordering import with_row_number

PERIOD = 1000
BLOCK_ROWS = 16
TEMPERATURE = 0.5  # target weight of a source: its number of rows to this power
MAX_SOURCES = 100_000
BROADCAST_ROWS = 1_000_000
BATCH_BLOCKS = 50_000


def whole_weights(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as positive whole numbers with the sum ``period`` (or the number of sources, if that is more), by largest remainder."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("every weight must be above 0")
    period = max(period, len(weights))
    total = sum(Fraction(w) for w in weights.values())
    spare = period - len(weights)  # one slot each, the rest by share of what is missing
    ideal = {s: max(Fraction(w) / total * period - 1, Fraction(0)) for s, w in weights.items()}
    scale = Fraction(spare) / sum(ideal.values()) if sum(ideal.values()) else Fraction(0)
    out = {s: 1 + int(x * scale) for s, x in ideal.items()}
    order = sorted(ideal, key=lambda s: (-(ideal[s] * scale % 1), s))
    for s in order[: period - sum(out.values())]:
        out[s] += 1
    return out


def exact_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights as positive whole numbers in exactly the same proportions."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("every weight must be above 0")
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: w.numerator * (common // w.denominator) for s, w in exact.items()}
    divisor = math.gcd(*whole.values()) or 1
    return {s: w // divisor for s, w in whole.items()}


def window(block: int, weight: int, period: int) -> tuple[int, int]:
    """Release slot and deadline (the slot before which it must have run) of a block."""
    return block * period // weight, -(-(block + 1) * period // weight)


def in_slots(weights: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of the first ``blocks`` blocks of each source: the released block with the earliest deadline runs.

    Equal deadlines: the block whose successor's window overlaps its own goes
    first, then the heavier source, then the name. A slot stays empty if no
    block is released.
    """
    total = sum(weights.values())

    def entry(source: str, block: int) -> tuple:
        release, deadline = window(block, weights[source], total)
        overlaps = (block + 1) * total % weights[source] != 0
        return release, (deadline, not overlaps, -weights[source], source, block, release)

    waiting = [entry(s, 0) for s in weights if blocks.get(s)]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1])
        deadline, _, _, source, block, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("no feasible schedule")  # cannot happen: the weights fill the slots
        yield source, block, release, deadline, slot
        if block + 1 < blocks[source]:
            heapq.heappush(waiting, entry(source, block + 1))
        slot += 1


def one_period(weights: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of one period of ``sum(weights)`` slots."""
    return [(source, block, slot) for source, block, _, _, slot in in_slots(weights, weights)]


def source_sizes(docs: DataFrame, source: str = "source", most: int = MAX_SOURCES) -> dict[str, int]:
    """Rows of each source; null is a source of its own, called ''."""
    rows = docs.groupBy(F.coalesce(source, F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources; pass weights for groups of them")
    return {r.s: r.n for r in rows}


def temperature_weights(docs: DataFrame, power: float = TEMPERATURE, source: str = "source") -> dict[str, float]:
    """Target weights from the sizes of the sources; null is a source of its own, called ''."""
    return {s: float(n) ** power for s, n in source_sizes(docs, source).items()}


def block_slots(spark: SparkSession, weights: Mapping[str, int], blocks: Mapping[str, int]) -> DataFrame:
    """``in_slots`` as a table (source, block, release, deadline, slot), made in one task from one row a source."""
    schema = "source string, block long, release long, deadline long, slot long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        walk = in_slots({r["source"]: int(r["weight"]) for r in rows}, {r["source"]: r["blocks"] for r in rows})
        while part := list(islice(walk, BATCH_BLOCKS)):
            names, *numbers = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(x, pa.int64()) for x in numbers]], ["source", "block", "release", "deadline", "slot"])

    # whole weights may have more digits than a long
    sources = spark.createDataFrame([(s, str(w), blocks.get(s, 0)) for s, w in weights.items()], "source string, weight string, blocks long")
    return sources.coalesce(1).mapInArrow(run, schema)


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None, source: str = "source") -> DataFrame:
    """(doc_id, source, source_row, block, release, deadline, slot, position) for every row of ``docs``.

    A source's rows follow a hash of their doc_id (equal ids their order is
    free); ``position`` orders the mix: the slot, then the row inside its block.
    Null sources are one source, ''. A null doc_id is scheduled as any other.
    ``weights`` must name every source; without them the ``temperature_weights``.
    With a ``period`` the weights are rounded to whole slots of it
    (``whole_weights``), and windows are those of the rounded weights.
    """
    sizes = source_sizes(docs, source, MAX_SOURCES if weights is None else max(MAX_SOURCES, len(weights)))
    weights = {s: float(n) ** TEMPERATURE for s, n in sizes.items()} if weights is None else weights
    if unnamed := sizes.keys() - weights.keys():
        raise ValueError(f"no weight for {len(unnamed)} sources, such as {min(unnamed)!r}")
    spark = docs.sparkSession
    if not weights:
        return spark.createDataFrame([], "doc_id long, source string, source_row long, block long, release long, deadline long, slot long, position long")
    whole = exact_weights(weights) if period is None else whole_weights(weights, period)
    blocks, total = {s: -(-n // block_rows) for s, n in sizes.items()}, sum(whole.values())
    if far := [s for s, n in blocks.items() if window(n - 1, whole[s], total)[1] * block_rows >= 1 << 63]:
        raise ValueError(f"the weight of {min(far)!r} is too small: its positions do not fit a long")
    light = docs.select("doc_id", F.coalesce(source, F.lit("")).alias("source"), F.xxhash64("doc_id").alias("__hash"))
    # rows are numbered inside chunks of the hash order, so a large source is many tasks
    numbered = with_row_number(light, ["source"], ["__hash", "doc_id"], F.shiftright("__hash", 52), "__row")
    row = F.col("__row") - 1
    numbered = numbered.withColumn("source_row", row).withColumn("block", F.floor(row / block_rows).cast("long"))
    placed = numbered.join(block_slots(spark, whole, blocks), ["source", "block"])  # at most block_rows rows a key
    return placed.select(
        "doc_id",
        "source",
        "source_row",
        "block",
        "release",
        "deadline",
        "slot",
        (F.col("slot") * block_rows + F.col("source_row") % block_rows).cast("long").alias("position"),
    )


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None) -> DataFrame:
    """``docs`` in the order of the mix: written as files, the files in order and the rows in them are the mix."""
    plan = schedule(docs, weights, block_rows, period).select("doc_id", "position")
    plan = stored(plan.groupBy("doc_id").agg(F.min("position").alias("__position")), "mix-positions")
    places = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan  # two numbers a row
    with_place = docs.join(places, docs.doc_id.eqNullSafe(places.doc_id), "left").drop(places.doc_id)
    return with_place.orderBy("__position", "doc_id").select(*docs.columns)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mix."""
    return mixed(docs)
