"""Study summaries: lengths, presses, counts, and the tables built from them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxweave.dims import DEBOUNCE_SECONDS, DEV, PARTICIPANTS, PERF
from fluxweave.functions import scalars as sc
from fluxweave.operators import series, transitions


def performance_lengths(touches: DataFrame) -> DataFrame:
    """First touch and seconds from first to last touch."""
    span = touches.groupBy(PERF).agg(F.min("time").alias("first_touch"), F.max("time").alias("__last"))
    return span.select(PERF, "first_touch", sc.seconds_between("__last", "first_touch").alias("seconds"))


def performer_lengths(touches: DataFrame) -> DataFrame:
    """Seconds from the performance's first touch to each performer's last."""
    span = touches.groupBy(PERF, DEV).agg(F.min("time").alias("__first"), F.max("time").alias("__last"))
    first = span.groupBy(PERF).agg(F.min("__first").alias("first_touch"))
    return span.join(first, PERF).select(
        PERF, DEV, "first_touch", sc.seconds_between("__last", "first_touch").alias("seconds")
    )


def performers(touches: DataFrame) -> DataFrame:
    return touches.select(PERF, DEV).distinct()


def raw_new_ideas(events: DataFrame, event_type: str = "new_idea") -> DataFrame:
    return events.groupBy(PERF).agg(F.count_if(F.col("event_type") == event_type).alias("raw_new_ideas"))


def button_changes(messages: DataFrame, label: str = "CompositionStep") -> DataFrame:
    return messages.groupBy(PERF).agg(F.count_if(F.col("label") == label).alias("button_presses"))


def button_presses(touches: DataFrame, messages: DataFrame) -> DataFrame:
    """Labelled messages of each touching performer, 0 when there are none."""
    counts = messages.groupBy(PERF, DEV).agg(F.count("label").alias("__n"))
    return performers(touches).join(counts, [PERF, DEV], "left").select(
        PERF, DEV, F.coalesce("__n", F.lit(0)).alias("button_presses")
    )


def performance_summary(
    touches: DataFrame,
    events: DataFrame,
    messages: DataFrame,
    gestures: DataFrame,
    event_type: str = "new_idea",
    label: str = "CompositionStep",
    gap_seconds: float = DEBOUNCE_SECONDS,
) -> DataFrame:
    """One row per performance: idea and press counts, ensemble flux and entropy.

    The parts have one row per performance each and are put together by one
    union and one aggregation. Performances without touches are left out.
    """
    lengths = performance_lengths(touches).select(PERF, "first_touch")
    ideas = events.filter(F.col("event_type") == event_type)
    changes = series.debounced(ideas, gap_seconds).groupBy(PERF).agg(F.count(F.lit(1)).alias("new_idea_changes"))
    steps = transitions.state_steps(transitions.complete_rows(gestures), "full")
    measures = transitions.ensemble_measures(transitions.whole_counts(steps), [PERF])
    parts = [lengths, raw_new_ideas(events, event_type), changes, button_changes(messages, label), measures]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = rows.groupBy(PERF).agg(*[F.max(c).alias(c) for c in rows.columns if c != PERF]).filter("first_touch IS NOT NULL")
    counts = ["raw_new_ideas", "new_idea_changes", "button_presses"]
    return out.select(
        PERF,
        "first_touch",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("flux", F.lit(0.0)).alias("flux"),
        "entropy",
    )


def melt(wide: DataFrame, ids: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return wide.unpivot(ids, columns, name, value)


def pivot_first(long: DataFrame, ids: list[str], name: str, value: str, columns: list | None = None) -> DataFrame:
    """One column per ``name``; where a cell has several values, the largest, so that the result can be repeated."""
    grouped = long.groupBy(*ids)
    return (grouped.pivot(name, columns) if columns else grouped.pivot(name)).agg(F.max(value))


def length_table(touches: DataFrame, seat: Column) -> DataFrame:
    """Performer lengths with the seat in place of the device."""
    return performer_lengths(touches).select(
        F.col("first_touch").alias("time"), seat.alias("seat"), "seconds"
    )


def join_design(design: DataFrame, values: DataFrame) -> DataFrame:
    """Design and per-performance values side by side; rows of either side stay."""
    return design.join(values, "time", "full")


def press_table(
    touches: DataFrame,
    messages: DataFrame,
    design: DataFrame,
    seat: Column,
    participants: Mapping[tuple[int, int], str] = PARTICIPANTS,
) -> DataFrame:
    """Presses of every performer with the design columns and the participant.

    Stays in rows throughout: a pivot to one column per device and back would
    give the same rows and needs the devices on the driver.
    """
    firsts = performance_lengths(touches).select(PERF, F.col("first_touch").alias("time"))
    presses = button_presses(touches, messages).join(firsts, PERF).select("time", seat.alias("seat"), "button_presses")
    joined = join_design(design, presses)
    return joined.withColumn("performer", sc.participant("group", "seat", participants))


def graded_scores(predictions: DataFrame, keys: list[str], target: str = "gesture", prediction: str = "prediction") -> DataFrame:
    """Per key: rows, mislabelled rows, accuracy and the graded match score."""
    wrong = F.col(target) != F.col(prediction)
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(wrong).alias("mislabelled"),
        F.avg(F.when(wrong, 0.0).otherwise(1.0)).alias("accuracy"),
        F.sum(sc.match_score(prediction, target)).alias("score"),
    )


def confusion(predictions: DataFrame, keys: list[str], target: str = "gesture", prediction: str = "prediction") -> DataFrame:
    """Share of all rows in each (true, predicted) cell."""
    counts = predictions.groupBy(*keys, target, prediction).agg(F.count(F.lit(1)).alias("n"))
    if keys:
        rows = counts.join(counts.groupBy(*keys).agg(F.sum("n").alias("__all")), keys)
    else:
        rows = counts.withColumn("__all", predictions.agg(F.count(F.lit(1))).scalar())
    return rows.select(*keys, target, prediction, "n", (F.col("n").cast("double") / F.col("__all")).alias("share"))
