"""Whole jobs over an archive of performances, one call each.

Each reads every performance under a path at once; the performance is a key,
not a loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave import dims
from fluxweave.dims import DEV, PERF
from fluxweave.functions import scalars as sc
from fluxweave.operators import learning as ln
from fluxweave.operators import messages as ms
from fluxweave.operators import series as se
from fluxweave.operators import stats
from fluxweave.operators import study as st
from fluxweave.operators import transitions as tr
from fluxweave.operators.ordering import CHUNK_SECONDS
from fluxweave.session import shared_folder
from fluxweave.sources import logs as lg
from fluxweave.sources import tables as tb
from fluxweave.sources.formats import DEFAULT_FORMAT, LogFormat
from fluxweave.streaming import live


def split_logs(spark: SparkSession, logs: str, out: str, fmt: LogFormat = DEFAULT_FORMAT) -> dict[str, str]:
    """Logs to one table per kind of message; returns the table paths.

    The raw text is read once and routed; each table is then made from its own
    lines only.
    """
    routed = lg.store_by_kind(lg.read_log(spark, logs), shared_folder(spark, "lines"), fmt)
    lines = spark.read.schema(f"{PERF} STRING, value STRING, kind STRING").parquet(routed)
    splitters = {
        "touches": lg.split_touches,
        "events": lambda x: lg.split_events(x, fmt),
        "messages": lambda x: lg.split_app_messages(x, fmt),
        "online": lambda x: lg.split_online(x, fmt),
        "transitions": lg.split_transitions,
        "gestures": lg.split_gestures,
        "gesturetargets": lambda x: lg.split_targets(x, fmt),
    }
    paths = {}
    for kind, split in splitters.items():
        paths[kind] = f"{out}/{kind}"
        split(lines.filter(F.col("kind") == kind)).write.mode("overwrite").parquet(paths[kind])
    return paths


def score_touches(touches: DataFrame, model: PipelineModel, out: str) -> DataFrame:
    """Gesture score of every performance, stored in rows."""
    ln.gesture_score(model, touches, dims.FEATURE_SECONDS, dims.TICK_SECONDS).write.mode("overwrite").parquet(out)
    return touches.sparkSession.read.parquet(out)


def posthoc(gestures: DataFrame, width: float = dims.FLUX_SECONDS, threshold: float = dims.NEW_IDEA_POSTHOC) -> dict[str, DataFrame]:
    """Flux per window, new ideas, ensemble states, rolling and trailing flux, and matrices of each performance."""
    steps = tr.state_steps(gestures)
    counts = tr.window_counts(steps, width)
    series = se.flux_series(counts)
    ideas = se.new_ideas(series, threshold)
    return {
        "flux": series,
        "flux_filled": se.forward_fill(series, [PERF], "window_start", ["flux"], 1, 3600),
        "new_ideas": se.marker_shift(ideas, int(width)),
        "states": tr.ensemble_state(counts, [PERF, "window_start"]),
        "rolling_flux": se.rolling_flux(steps),
        "trailing_flux": se.trailing_flux(steps, dims.TRAILING_SECONDS, width),
        "matrices": tr.dense_cells(counts, [PERF, "window_start"]),
    }


def study_tables(
    touches: DataFrame, events: DataFrame, messages: DataFrame, gestures: DataFrame, design: DataFrame, seat: Column | None = None
) -> dict[str, DataFrame]:
    """The three study tables: performer lengths, performance data, button presses."""
    where = sc.lookup(DEV, dims.DEVICE_SEATS) if seat is None else seat
    return {
        "performance_lengths": st.length_table(touches, where),
        "performance_data": st.performance_summary(touches, events, messages, gestures),
        "button_presses": st.press_table(touches, messages, design, where),
    }


def training_data(touches: DataFrame, targets: DataFrame, out: str) -> str:
    """Labelled rolling vectors as CSV, the form the trainer reads."""
    rows = ln.training_set(touches, targets, dims.FEATURE_SECONDS, dims.TICK_SECONDS)
    return tb.write_exact_csv(rows.select("time", *dims.FEATURE_COLUMNS, "target"), out)


def evaluate(
    sets: Mapping[str, DataFrame], identity: Sequence[str], columns: Sequence[str] = dims.FEATURE_COLUMNS, label: str = "gesture", folds: int = 10, runs: int = 10, **options
) -> dict[str, DataFrame]:
    """Classifier evaluation over several training sets, each named: repeated stratified cross-validation and its statistics.

    Gives the accuracy of every set, run and fold (``scores``), each set's mean
    accuracy and twice its standard deviation (``intervals``), its confusion
    matrix, and the sets' analysis of variance and pairwise t over the scores.
    """
    guesses = [ln.cross_validate(df, columns, label, identity, folds, runs, **options).withColumn("set", F.lit(name)) for name, df in sets.items()]
    return evaluation(reduce(DataFrame.unionByName, guesses), list(sets), label)


def evaluation(predictions: DataFrame, names: Sequence[str], label: str = "gesture") -> dict[str, DataFrame]:
    """Statistics of the predictions (set, run, fold, label, prediction) of several training sets."""
    scores = st.graded_scores(predictions, ["set", "run", "fold"], label)
    return {
        "scores": scores,
        "intervals": stats.accuracy_interval(scores, "accuracy", ["set"]),
        "confusion": st.confusion(predictions, ["set"], label),
        "anova": stats.anova(scores, "set", "accuracy"),
        "t_tests": stats.pooled_t(scores, "set", "accuracy", list(combinations(names, 2))),
    }


def live_session(touches: DataFrame, model: PipelineModel, out: str, delay: str = live.DELAY, offline: DataFrame | None = None, chunk: float = CHUNK_SECONDS) -> dict[str, str]:
    """Live analysis of a touch stream up to what has arrived.

    Vectors are classified into a gesture log with a state at every tick of every
    active device (``offline``, a stream or a table, says when devices leave); the
    log feeds the bounded view (``live.current_view``) and state pairs, and these
    feed flux, ensemble state and new ideas. Each stage
    keeps its own checkpoint, so calling again goes on where the last call stopped.
    """
    spark = touches.sparkSession
    vectors = live.live_features(touches, delay=delay).drop("window")
    key = touches.schema[PERF].dataType.simpleString()
    columns = f"{PERF} {key}, {DEV} string, time timestamp"
    predicted = live.run_to_table(ln.classify(model, vectors).select(PERF, DEV, "time", "prediction"), "predicted", path=f"{out}/predicted")
    ticks = live.fill_idle(live.message_stream(spark, predicted, f"{columns}, prediction int"), offline=offline)
    log = live.run_to_table(ticks, "gestures", path=f"{out}/gestures")
    gestures = live.message_stream(spark, log, f"{columns}, gesture int")
    steps_path = live.write_steps(gestures, "steps", path=f"{out}/steps", chunk=chunk, delay=delay)

    def steps() -> DataFrame:
        return live.message_stream(spark, f"{steps_path}/*/data", f"{columns}, to_state int, from_state int")

    flux = live.run_to_table(live.live_flux(steps(), delay=delay), "flux", path=f"{out}/flux")
    series = live.message_stream(spark, flux, f"{PERF} {key}, time timestamp, flux double")
    return {
        "gestures": log,
        "view": live.run_updates(live.live_recent(gestures, delay=delay), "view", path=f"{out}/view"),
        "steps": steps_path,
        "flux": flux,
        "states": live.run_to_table(live.live_state(steps(), delay=delay), "states", path=f"{out}/states"),
        "new_ideas": live.run_to_table(live.live_new_ideas(series), "ideas", path=f"{out}/ideas"),
    }


def recent(gestures: DataFrame) -> DataFrame:
    """The part of a gesture log that the live view looks at: the last minute."""
    return ms.retain_seconds(ms.retain_ticks(gestures), dims.GESTURE_RETENTION_SECONDS)
