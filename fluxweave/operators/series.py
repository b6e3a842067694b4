"""Series over time: flux, new ideas, trailing flux, forward fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from fluxweave.dims import DEV, NEW_IDEA_LIVE, PERF, ROLLING_ROWS
from fluxweave.functions import matrix as mx
from fluxweave.functions.scalars import SECOND, bin_micros, bin_start, shift
from fluxweave.operators.grids import STEPS_PER_CHUNK
from fluxweave.operators.ordering import CHUNK_SECONDS, over_rows_before, with_previous


def _by_window() -> WindowSpec:
    """Order of a window-level series.

    Such a series holds one row per performance and window, so a bare
    per-performance window over it is bounded by (time span / window width).
    """
    return Window.partitionBy(PERF).orderBy("window_start")


def flux_series(counts: DataFrame) -> DataFrame:
    """Flux per performance and window; windows without rows do not appear."""
    return counts.groupBy(PERF, "window_start").agg(mx.flux().alias("flux"))


def flux_changes(series: DataFrame, value: str = "flux") -> DataFrame:
    """Rise of the series over the previous non-empty window."""
    return series.withColumn("rise", F.col(value) - F.lag(value).over(_by_window()))


def new_ideas(series: DataFrame, threshold: float = NEW_IDEA_LIVE, value: str = "flux") -> DataFrame:
    """Windows whose value rose by strictly more than the threshold."""
    return flux_changes(series, value).filter(F.col("rise") > threshold)


def latest_new_idea(series: DataFrame, threshold: float = NEW_IDEA_LIVE) -> DataFrame:
    """Per performance: did the last window rise above the threshold?"""
    newest = F.max(F.struct("window_start", "flux", F.coalesce("rise", F.lit(0.0)).alias("rise"))).alias("last")
    last = flux_changes(series).groupBy(PERF).agg(newest)
    return last.select(PERF, "last.window_start", "last.flux", (F.col("last.rise") > threshold).alias("is_new_idea"))


def rolling_flux(steps: DataFrame, rows: int = ROLLING_ROWS, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Flux over the ``rows`` rows before each row; the first ``rows`` give nothing.

    The rows of one time count as one row. A window that holds fewer than
    ``rows`` rows is that of one of the first, so no row is numbered.
    """
    per_time = steps.groupBy(PERF, "time").agg(
        F.count(mx.TO).alias("pairs"), F.count_if(F.col(mx.TO) != F.col(mx.FROM)).alias("moved")
    )

    def sums(w: WindowSpec) -> dict[str, Column]:
        before = w.rowsBetween(-rows, -1)
        return {
            "__rows": F.count(F.lit(1)).over(before),
            "__pairs": F.sum("pairs").over(before),
            "__moved": F.sum("moved").over(before),
        }

    summed = over_rows_before(per_time, [PERF], rows, sums, chunk_seconds=chunk_seconds).filter(F.col("__rows") == rows)
    return summed.select(PERF, "time", mx.ratio_or(F.col("__moved"), F.col("__pairs"), 0.0).alias("flux"))


def trailing_flux(steps: DataFrame, trailing_seconds: float, width_seconds: float) -> DataFrame:
    """At every row: flux of the last bin of the trailing frame, and its rise.

    The frame of a row at ``t`` is ``[t - trailing, t]``; a pair counts when both
    of its rows are in the frame, and bins are epoch-aligned. A pair is therefore
    seen by exactly the rows between its own time and ``prev_time + trailing``.
    That is written as changes: +1 at the pair's own row, +1 at the start of each
    later bin it can be seen from, -1 where it drops out. A running sum per bin
    then gives every row its counts, so the work grows with the rows, not with
    rows times frame length.
    """
    trail, width = int(trailing_seconds * SECOND), int(width_seconds * SECOND)
    reach = -(-trail // width)  # bins back that a frame can touch

    def bin_of(c: str) -> Column:
        return F.col(c) - F.pmod(F.col(c), F.lit(width).cast("long"))

    out = F.col("p") + F.lit(trail + 1)
    rows = (
        steps.select(
            PERF,
            F.unix_micros("time").alias("t"),
            F.unix_micros("prev_time").alias("p"),
            F.col(mx.TO).isNotNull().alias("pair"),
            (F.col(mx.TO) != F.col(mx.FROM)).alias("changed"),
        )
        .withColumn("own", bin_of("t"))
        # when the pair drops out of sight; NULL if no row ever sees it
        .withColumn("stop", F.when(F.col("pair") & (out > F.col("t")), out))
    )
    # change 0 is the row itself, 1..reach the bin starts, the last the drop-out
    j, drop = F.col("j"), reach + 1
    each = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(drop))))
    placed = each.withColumn(
        "at", F.when(j == 0, F.col("t")).when(j <= reach, F.col("own") + j.cast("long") * width).otherwise(F.col("stop"))
    ).withColumn("bin", bin_of("at"))
    back = ((F.col("bin") - F.col("own")) / width).cast("int")
    valid = (j <= reach) | ((j == drop) & (back <= reach))
    seen = (j == 0) | (F.col("stop") > F.col("at"))
    sign = F.when(F.col("stop").isNull(), 0).when(j > reach, -1).when(seen, 1).otherwise(0)
    changes = placed.filter(valid).select(
        PERF, "bin", "at", back.alias("k"), sign.alias("sign"), "changed", "j", "t"
    )

    def counter(i: int, only: Column | None = None) -> Column:
        mine = F.col("k") == i
        return F.sum(F.when(mine if only is None else mine & only, F.col("sign")).otherwise(0))

    # an earlier bin is in the frame while its last row is, which the starts of later bins are told
    lasts = [f"last{i}" for i in range(1, reach + 1)]
    # the changes of one instant are added up before the shuffle
    at = changes.groupBy(PERF, "bin", "at").agg(
        *[counter(i).alias(f"pairs{i}") for i in range(reach + 1)],
        *[counter(i, F.col("changed")).alias(f"moved{i}") for i in range(reach + 1)],
        *[F.max(F.when(F.col("j") == i, F.col("t"))).alias(f"last{i}") for i in range(1, reach + 1)],
        F.max(F.col("j") == 0).alias("is_row"),
    )
    counters = [f"{c}{i}" for i in range(reach + 1) for c in ("pairs", "moved")]
    # at most one row per microsecond of a bin
    run = Window.partitionBy(PERF, "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(c).over(run).alias(c) for c in counters] + [F.max(c).over(run).alias(c) for c in lasts]
    running = at.select(PERF, "at", "is_row", *sums).filter("is_row")

    def flux_of(i: int) -> Column:
        return mx.ratio_or(F.col(f"moved{i}"), F.col(f"pairs{i}"), 0.0)

    before = F.coalesce(
        *[F.when(F.col(f"last{i}") >= F.col("at") - trail, flux_of(i)) for i in range(1, reach + 1)]
    )
    return running.select(
        PERF,
        F.timestamp_micros("at").alias("time"),
        flux_of(0).alias("flux"),
        F.coalesce(flux_of(0) - before, F.lit(0.0)).alias("flux_rise"),
    )


def forward_fill(
    series: DataFrame, keys: list[str], time: str, values: list[str], step_seconds: float, chunk_seconds: float
) -> DataFrame:
    """Series on a regular step, the last value carried forward.

    Each row covers the steps up to the next row, so the grid is made by the
    rows themselves and no join is needed.
    """
    # reversed time turns "previous" into "next" without a second operator
    flipped = series.withColumn("__neg", F.timestamp_micros(-F.unix_micros(time)))
    nexts = with_previous(flipped, keys, [time], "__neg", chunk_seconds=chunk_seconds, prefix="__next_")
    step = int(step_seconds * SECOND)
    first = F.col("__first")
    last = F.coalesce(F.unix_micros(f"__next_{time}") - 1, F.unix_micros(time))
    on_step = nexts.withColumn(
        "__first", F.unix_micros(time) + F.pmod(-F.unix_micros(time), F.lit(step).cast("long"))
    ).withColumn("__last", last)
    # a long gap is cut into blocks of steps that are spread over the cluster, so no row holds a whole gap
    block = step * STEPS_PER_CHUNK
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.when(first <= F.col("__last"), F.sequence(first, F.col("__last"), F.lit(block).cast("long")))
    cut = on_step.select(*keys, "__last", F.explode(blocks).alias("__from"), *values).repartition(tasks, *keys, "__from")
    stop = F.least(F.col("__last"), F.col("__from") + F.lit(block - step).cast("long"))
    each = cut.select(*keys, F.explode(F.sequence("__from", stop, F.lit(step).cast("long"))).alias("__us"), *values)
    return each.select(*keys, F.timestamp_micros("__us").alias(time), *values)


def marker_shift(ideas: DataFrame, width_seconds: int, time: str = "window_start") -> DataFrame:
    """Where an idea is marked: half a window (whole seconds) after its start."""
    return ideas.withColumn("marker_time", shift(time, int(width_seconds) // 2))


def line_segments(gestures: DataFrame, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Each gesture point with the point before it on the same device."""
    return with_previous(gestures, [PERF, DEV], ["time", "gesture"], "time", chunk_seconds=chunk_seconds)


# --- greedy debounce --------------------------------------------------------

NEVER = -(1 << 62)  # the last kept time where there is none
FAN = 1024  # blocks that are put together into one of the next level
SPAN = 100 * 366 * 86400 * SECOND  # what a block of the highest level covers at least


# expressions over arrays; ``gap`` is a number of microseconds, the other arguments are expressions


def _after(steps: str, last: str, gap: int) -> str:
    """What a block's step function makes of the last kept time before it."""
    return f"coalesce(get(filter({steps}, s -> s.until > {last} + {gap}), 0).exit, {last})"


def _distinct(steps: str) -> str:
    """Of the pieces with one exit, which follow each other, the last is enough."""
    return f"filter({steps}, (p, i) -> coalesce(get({steps}, i + 1).exit <> p.exit, true))"


def _steps_of_times(times: str, gap: int) -> str:
    """Step function of a block: an event that may be kept first, and the one that is then kept last.

    The first kept event lies within a gap of the first event, or is the first one after that.
    """
    first = f"filter({times}, (t, i) -> i = 0 OR get({times}, i - 1) <= get({times}, 0) + {gap})"
    exit_ = f"aggregate({times}, c, (last, t) -> if(t > last + {gap}, t, last))"
    return f"transform({first}, c -> named_struct('until', c, 'exit', {exit_}))"


def _chained(children: str, limit: str, gap: int) -> str:
    """The step functions of neighbouring blocks, in order of time, as one.

    The last kept time before the blocks is less than a gap before ``limit``,
    so of the pieces behind it only the first can be reached.
    """
    kept = f"transform(so_far, p -> named_struct('until', p.until, 'exit', {_after('block.steps', 'p.exit', gap)}))"
    reached = f"filter(all, (q, i) -> i = 0 OR get(all, i - 1).until <= {limit})"
    # an array of one element stands for a value that is computed once
    chain = f"get(transform(array(concat({kept}, block.steps)), all -> {reached}), 0)"
    return f"aggregate({children}, filter(get({children}, 0).steps, s -> false), (so_far, block) -> {chain})"


def _entries(children: str, entry: str, gap: int) -> str:
    """(block, entry) for every block of ``children``: the last kept time before it, given that before the first one."""
    start = f"named_struct('last', {entry}, 'found', array(named_struct('block', 0L, 'entry', {entry})))"
    told = "array(named_struct('block', child.block, 'entry', now.last))"
    step = f"named_struct('last', {_after('child.steps', 'now.last', gap)}, 'found', concat(now.found, {told}))"
    return f"slice(aggregate({children}, {start}, (now, child) -> {step}).found, 2, size({children}))"


def _kept(times: str, entry: str, gap: int) -> str:
    start = f"named_struct('last', {entry}, 'kept', filter({times}, t -> false))"
    step = f"if(t > now.last + {gap}, named_struct('last', t, 'kept', concat(now.kept, array(t))), now)"
    return f"aggregate({times}, {start}, (now, t) -> {step}).kept"


def debounced(events: DataFrame, gap_seconds: float, chunk_gaps: int = 6, fan: int = FAN) -> DataFrame:
    """Greedy debounce: keep an event more than ``gap`` after the last kept one.

    The rule is sequential, but a block of time acts on the last kept time as a
    step function, and step functions can be chained in any grouping. Blocks of
    a few gaps compute theirs; ``fan`` neighbours are chained into a block of
    the next level, until a level's blocks cover a century; from the top the
    last kept time before every block is handed down, and the lowest blocks mark
    their events. No group holds more than ``fan`` rows of an earlier level, and
    a step function has a piece for each event of one gap at most, so a dense
    block costs events times events of a gap. Empty blocks have no row.
    """
    def start_of(c: str, length: int) -> Column:
        # never null, so that no join asks for it and both uses of a level read one exchange
        return F.coalesce(F.col(c) - F.pmod(c, F.lit(length).cast("long")), F.lit(0))

    gap, size = int(gap_seconds * SECOND), int(gap_seconds * chunk_gaps * SECOND)
    blocks = (
        events.select(PERF, F.unix_micros("time").alias("__t"))
        .filter(F.col(PERF).isNotNull() & F.col("__t").isNotNull())
        .groupBy(PERF, start_of("__t", size).alias("block"))
        .agg(F.sort_array(F.collect_set("__t")).alias("times"))
    )
    below = blocks.select(PERF, "block", F.expr(_steps_of_times("times", gap)).alias("steps"))
    levels = []
    while True:
        top = size >= SPAN
        size = min(size * fan, 1 << 61)
        above = F.lit(NEVER).cast("long") if top else start_of("block", size)
        child = F.struct("block", F.expr(_distinct("steps")).alias("steps")).alias("child")
        level = below.select(PERF, above.alias("above"), child).groupBy(PERF, "above").agg(F.sort_array(F.collect_list("child")).alias("children"))
        levels.append(level)
        if top:
            break
        below = level.select(PERF, F.col("above").alias("block"), F.expr(_chained("children", f"above + {gap}", gap)).alias("steps"))
    entries = levels.pop().select(PERF, F.expr(f"inline({_entries('children', f'{NEVER}L', gap)})"))
    while levels:
        told = levels.pop().join(entries.withColumnRenamed("block", "above"), [PERF, "above"])
        entries = told.select(PERF, F.expr(f"inline({_entries('children', 'entry', gap)})"))
    marked = blocks.join(entries, [PERF, "block"])
    return marked.select(PERF, F.expr(f"explode({_kept('times', 'entry', gap)})").alias("__us")).select(PERF, F.timestamp_micros("__us").alias("time"))


def with_debounce(events: DataFrame, gap_seconds: float) -> DataFrame:
    """Events with ``screen_changed``: true for the kept ones."""
    kept = debounced(events, gap_seconds).withColumn("__kept", F.lit(True))
    return events.join(kept, [PERF, "time"], "left").select(
        *events.columns, F.coalesce("__kept", F.lit(False)).alias("screen_changed")
    )


def with_window(df: DataFrame, width_seconds: float, time: str = "time") -> DataFrame:
    return df.withColumn("window_start", bin_start(time, width_seconds))
