"""State transitions of an ensemble.

A matrix is kept sparse, one row per non-empty cell: ``to_state``,
``from_state``, ``n``. A device's first row and a row whose state is unmapped
have no pair; they appear as NULL states with ``n = 0`` so that their window
stays in the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxweave.dims import DEV, N_GROUPS, PERF
from fluxweave.functions import matrix as mx
from fluxweave.functions.scalars import SECOND, bin_start, full_state, gesture_group
from fluxweave.operators.ordering import CHUNK_SECONDS, with_previous
from fluxweave.operators.sides import with_side

CELL = [mx.TO, mx.FROM]


def map_state(states: str, c: str | Column) -> Column:
    """``states`` is 'group' (five groups) or 'full' (nine states)."""
    return gesture_group(c) if states == "group" else full_state(c)


def state_steps(
    gestures: DataFrame,
    states: str = "group",
    time: str = "time",
    gesture: str = "gesture",
    ties: Sequence[str] = (),
    chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """Each gesture row as a step from its device's previous row."""
    mapped = gestures.select(
        PERF, F.col(time).alias("time"), DEV, map_state(states, gesture).cast("int").alias("state"), *ties
    )
    stepped = with_previous(mapped, [PERF, DEV], ["state", "time"], "time", ties, chunk_seconds)
    paired = F.col("state").isNotNull() & F.col("prev_state").isNotNull()
    return stepped.select(
        PERF,
        "time",
        DEV,
        F.col("prev_time"),
        F.when(paired, F.col("state")).alias(mx.TO),
        F.when(paired, F.col("prev_state")).alias(mx.FROM),
    )


def count_cells(steps: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Pairs per key and cell; rows without a pair stay as one empty marker."""
    return steps.groupBy(*keys, *CELL).agg(F.count(mx.TO).alias(mx.N))


def cells(counts: DataFrame) -> DataFrame:
    """Only the real cells of a matrix."""
    return counts.filter(F.col(mx.N) > 0)


def window_counts(steps: DataFrame, width_seconds: float, keep_first_rows: bool = True) -> DataFrame:
    """One matrix per performance and tumbling window, summed over devices.

    A pair belongs to the window of its later row. With ``keep_first_rows``
    false, a window that holds only first rows disappears.
    """
    rows = steps if keep_first_rows else steps.filter(F.col("prev_time").isNotNull())
    return count_cells(rows, [PERF, bin_start("time", width_seconds).alias("window_start")])


def whole_counts(steps: DataFrame) -> DataFrame:
    """One matrix per performance."""
    return count_cells(steps, [PERF])


def device_counts(steps: DataFrame) -> DataFrame:
    """One matrix per performer: all consecutive pairs of a sequence."""
    return count_cells(steps, [PERF, DEV])


def complete_rows(gestures: DataFrame) -> DataFrame:
    """Rows of those times at which every player of the performance has a state.

    The number of players is one row per performance, counted and brought to
    the times, so that a performance with most rows is not gathered for it.
    """
    players = gestures.groupBy(PERF, DEV).agg(F.lit(1)).groupBy(PERF).agg(F.count(F.lit(1)).alias("__players"))
    rest = [c for c in gestures.columns if c not in (PERF, "time")]
    # a time's rows are one state per player, so they are kept beside their count instead of being joined back
    at_time = gestures.groupBy(PERF, "time").agg(F.count("gesture").alias("__present"), F.collect_list(F.struct(*rest)).alias("__rows"))
    full = with_side(at_time, players, [PERF]).filter(F.col("__present") == F.col("__players"))
    return full.select(PERF, "time", F.inline("__rows")).select(*gestures.columns)


def window_local_counts(gestures: DataFrame, width_seconds: float, states: str = "full") -> DataFrame:
    """Pairs inside one device's window only; no pair crosses a boundary."""
    rows = gestures.select(
        PERF,
        DEV,
        "time",
        bin_start("time", width_seconds).alias("window_start"),
        map_state(states, "gesture").cast("int").alias("state"),
    )
    # bounded by what a device can emit in one window
    w = Window.partitionBy(PERF, DEV, "window_start").orderBy("time")
    paired = rows.withColumn("before", F.lag("state").over(w))
    both = F.col("state").isNotNull() & F.col("before").isNotNull()
    steps = paired.select(
        PERF,
        DEV,
        "window_start",
        F.when(both, F.col("state")).alias(mx.TO),
        F.when(both, F.col("before")).alias(mx.FROM),
    )
    return count_cells(steps, [PERF, DEV, "window_start"])


def reduce_to_groups(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nine-state cells summed into five-group cells."""
    return counts.groupBy(*keys, gesture_group(mx.TO).alias(mx.TO), gesture_group(mx.FROM).alias(mx.FROM)).agg(
        F.sum(mx.N).alias(mx.N)
    )


def stochastic(counts: DataFrame, keys: Sequence[str], by: str = mx.TO, name: str = "p") -> DataFrame:
    """Each cell over the sum of its row (fixed *to*), or of its column with ``by='from_state'``.

    At most one row per cell enters a window partition, so it stays small.
    """
    w = Window.partitionBy(*keys, by)
    return cells(counts).withColumn(name, F.col(mx.N).cast("double") / F.sum(mx.N).over(w))


def normal(counts: DataFrame, keys: Sequence[str], name: str = "p") -> DataFrame:
    """Each cell over the sum of its matrix."""
    w = Window.partitionBy(*keys)
    return cells(counts).withColumn(name, F.col(mx.N).cast("double") / F.sum(mx.N).over(w))


def flux(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(mx.flux().alias("flux"))


def entropy(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells(counts).groupBy(*keys).agg(mx.entropy().alias("entropy"))


def ensemble_measures(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flux and entropy of the row-stochastic form of each matrix."""
    p = stochastic(counts, keys).select(*keys, *CELL, F.col("p").alias(mx.N))
    return p.groupBy(*keys).agg(mx.flux().alias("flux"), mx.entropy().alias("entropy"))


def changeyness(counts: DataFrame, keys: Sequence[str], empty_diagonal: float = 1.0) -> DataFrame:
    return counts.groupBy(*keys).agg(mx.changeyness(empty_diagonal).alias("changeyness"))


def heaviest_line(counts: DataFrame, keys: Sequence[str], axis: str = mx.TO) -> DataFrame:
    """The row (``axis='to_state'``) or column of each matrix that weighs most; the lowest index wins a tie."""
    lines = cells(counts).groupBy(*keys, axis).agg(
        F.sum(F.col(mx.N) * F.col(mx.N)).alias("weight"), F.sum(mx.N).alias(mx.N)
    )
    best = F.max(F.struct("weight", (-F.col(axis)).alias("order"), mx.N)).alias("b")
    return lines.groupBy(*keys).agg(best).select(
        *keys, (-F.col("b.order")).alias(axis), F.col("b.weight").alias("weight"), F.col(f"b.{mx.N}").alias(mx.N)
    )


def _sums(of: Column, axis: str, size: int) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col(axis) == i, of)), F.lit(0)) for i in range(size)]


def column_changeyness(counts: DataFrame, keys: Sequence[str], size: int = N_GROUPS) -> DataFrame:
    """Heaviest column sum minus the diagonal sum."""
    columns = F.greatest(*_sums(F.col(mx.N), mx.FROM, size))
    return counts.groupBy(*keys).agg((columns - mx.diagonal()).alias("changeyness"))


def line_measures(counts: DataFrame, keys: Sequence[str], axis: str = mx.TO, size: int = N_GROUPS) -> DataFrame:
    """Spread and ratio of every row (``axis='to_state'``) or column of each matrix."""
    lines = cells(counts).groupBy(*keys, axis).agg(
        F.sum(mx.N).alias("s1"), F.sum(F.col(mx.N) * F.col(mx.N)).alias("s2")
    )
    whole = F.sum("s1").over(Window.partitionBy(*keys))
    return lines.select(
        *keys,
        axis,
        mx.vector_spread(F.col("s1"), F.col("s2"), size).alias("spread"),
        mx.vector_ratio(F.col("s1"), whole).alias("ratio"),
    )


def ensemble_state(counts: DataFrame, keys: Sequence[str], size: int = N_GROUPS) -> DataFrame:
    """State of each matrix: which of diagonal, best column, best row weighs most.

    Weights are compared as integer sums of squares, so ties are exact. All row,
    column and diagonal sums come out of one aggregation.
    """
    n, n2 = F.col(mx.N), F.col(mx.N) * F.col(mx.N)
    diag = F.col(mx.TO) == F.col(mx.FROM)

    def total_of(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    sums = counts.groupBy(*keys).agg(
        F.array(*_sums(n, mx.TO, size)).alias("row1"),
        F.array(*_sums(n2, mx.TO, size)).alias("row2"),
        F.array(*_sums(n, mx.FROM, size)).alias("col1"),
        F.array(*_sums(n2, mx.FROM, size)).alias("col2"),
        total_of(F.when(diag, n)).alias("d1"),
        total_of(F.when(diag, n2)).alias("d2"),
        total_of(n).alias("all1"),
    )

    def best(one: str, two: str) -> tuple[Column, Column]:
        top = F.array_max(two)
        # the first position wins a tie
        return F.element_at(F.col(one), F.array_position(F.col(two), top).cast("int")), top

    (c1, c2), (r1, r2) = best("col1", "col2"), best("row1", "row2")
    flat = sums.select(*keys, "d1", "d2", "all1", c1.alias("c1"), c2.alias("c2"), r1.alias("r1"), r2.alias("r2"))
    d2, c2, r2 = F.col("d2"), F.col("c2"), F.col("r2")
    state = (
        F.when((d2 == c2) & (c2 == r2), "stasis")
        .when(c2 == r2, "development")
        .when(d2 == r2, "divergence")
        .when(d2 == c2, "convergence")
        .when((d2 > c2) & (d2 > r2), "stasis")
        .when(c2 > r2, "convergence")
        .otherwise("divergence")
    )
    picked = flat.withColumn("state", state).select(
        *keys,
        "state",
        "d1",
        "all1",
        F.when(F.col("state") == "convergence", F.col("c1"))
        .when(F.col("state") == "divergence", F.col("r1"))
        .otherwise(F.col("d1"))
        .alias("v1"),
        F.when(F.col("state") == "convergence", c2).when(F.col("state") == "divergence", r2).otherwise(d2).alias("v2"),
    )
    developing = F.col("state") == "development"
    return picked.select(
        *keys,
        "state",
        F.when(developing, F.lit(1.0))
        .otherwise(mx.vector_spread(F.col("v1"), F.col("v2"), size))
        .alias("spread"),
        F.when(developing, 1.0 - mx.vector_ratio(F.col("d1"), F.col("all1")))
        .otherwise(mx.vector_ratio(F.col("v1"), F.col("all1")))
        .alias("ratio"),
    )


def multi_width_counts(steps: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Matrices for several window widths from one pass over the steps.

    Pairs are first counted in bins of the widths' common divisor; only those
    counts are repeated once per width.
    """
    base = reduce(gcd, widths)
    fine = window_counts(steps.filter(F.col("prev_time").isNotNull()), base)
    wide = fine.withColumn("width", F.explode(F.array(*[F.lit(int(w)) for w in widths])))
    us, w = F.unix_micros("window_start"), F.col("width").cast("long") * F.lit(SECOND)
    start = F.timestamp_micros(us - F.pmod(us, w)).alias("window_start")
    return wide.groupBy(PERF, "width", start, *CELL).agg(F.sum(mx.N).alias(mx.N))


def matrix_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells in which two sets of matrices differ; empty when they are equal.

    Signed counts are summed per cell: one shuffle with partial aggregation.
    """
    cols = [*keys, *CELL]
    signed = a.select(*cols, F.col(mx.N).alias("n_a"), F.lit(0).cast("long").alias("n_b")).unionByName(
        b.select(*cols, F.lit(0).cast("long").alias("n_a"), F.col(mx.N).alias("n_b"))
    )
    return signed.groupBy(*cols).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")).filter("n_a <> n_b")


def _cell_map(counts: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Cells of each matrix as a map from position to count: at most ``size * size`` entries."""
    entry = F.struct((F.col(mx.TO) * size + F.col(mx.FROM)).alias("i"), F.col(mx.N).alias("n"))
    listed = F.collect_list(F.when(F.col(mx.N) > 0, entry))
    return counts.groupBy(*keys).agg(F.map_from_entries(listed).alias("__cells"), mx.total().alias("__all"))


def _cell(i: Column) -> Column:
    return F.coalesce(F.try_element_at("__cells", i), F.lit(0).cast("long"))


def dense_cells(counts: DataFrame, keys: Sequence[str], size: int = N_GROUPS) -> DataFrame:
    """Every cell of every matrix with its share of the total, zeros included."""
    places = F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("__i")
    each = _cell_map(counts, keys, size).select("*", places)
    return each.select(
        *keys,
        F.floor(F.col("__i") / size).cast("int").alias(mx.TO),
        (F.col("__i") % size).cast("int").alias(mx.FROM),
        _cell(F.col("__i")).alias(mx.N),
        mx.ratio_or(_cell(F.col("__i")), F.col("__all"), 0.0).alias("p"),
    )


def dense_matrix(counts: DataFrame, keys: Sequence[str], size: int = N_GROUPS, row_stochastic: bool = False) -> DataFrame:
    """Each matrix as ``array<array<double>>`` indexed ``[to][from]``."""
    index = F.sequence(F.lit(0), F.lit(size - 1))
    rows = F.transform(index, lambda t: F.transform(index, lambda f: _cell(t * size + f).cast("double")))
    out = _cell_map(counts, keys, size).select(*keys, rows.alias("matrix"))
    if not row_stochastic:
        return out

    def share(row: Column) -> Column:
        s = F.aggregate(row, F.lit(0.0), lambda a, x: a + x)
        return F.transform(row, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0)))

    return out.withColumn("matrix", F.transform("matrix", share))
