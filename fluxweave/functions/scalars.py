"""Column expressions: time binning, code lookups, small row operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxweave import dims

SECOND = 1_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    return F.unix_micros(col(c))


def bin_micros(c: str | Column, seconds: float) -> Column:
    """Start of the epoch-aligned bin, in microseconds (integer arithmetic)."""
    u, w = micros(c), F.lit(int(seconds * SECOND)).cast("long")
    return u - F.pmod(u, w)


def bin_start(c: str | Column, seconds: float) -> Column:
    """Start of the epoch-aligned bin as a timestamp."""
    return F.timestamp_micros(bin_micros(c, seconds))


def shift(c: str | Column, seconds: float) -> Column:
    return F.timestamp_micros(micros(c) + F.lit(int(seconds * SECOND)).cast("long"))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(SECOND))


def lookup(c: str | Column, table: Mapping) -> Column:
    """Value of a fixed table, NULL when the key is not in it."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col(c))


def encode_gesture(code: str | Column) -> Column:
    """Gesture code to state number; a blank code counts as N."""
    return lookup(F.coalesce(F.nullif(F.trim(col(code)), F.lit("")), F.lit("N")), dims.GESTURE_CODES)


def decode_gesture(state: str | Column) -> Column:
    return lookup(state, dims.GESTURE_NAMES)


def gesture_group(state: str | Column) -> Column:
    return lookup(col(state).cast("int"), dims.GESTURE_GROUPS)


def full_state(state: str | Column) -> Column:
    """State number when it belongs to the nine-state matrix, else NULL."""
    s = col(state).cast("int")
    return F.when(s.between(0, dims.N_STATES - 1), s)


def ensemble_state_code(name: str | Column) -> Column:
    return lookup(name, dims.ENSEMBLE_STATES)


def performance_type_name(code: str | Column) -> Column:
    return lookup(col(code).cast("int"), dims.PERFORMANCE_TYPES)


def participant(group: str | Column, seat: str | Column, table: Mapping[tuple[int, int], str] = dims.PARTICIPANTS) -> Column:
    """Participant by (group, seat), NULL when the table has no such pair."""
    key = F.concat(col(group).cast("int").cast("string"), F.lit("-"), col(seat).cast("int").cast("string"))
    return lookup(key, {f"{g}-{s}": name for (g, s), name in table.items()})


def elapsed_seconds(time: str | Column, first: str | Column, lead_in: float = 0.0) -> Column:
    """Seconds since the first row, whose time is cut to the whole second."""
    start = bin_start(first, 1)
    return seconds_between(time, start) + F.lit(float(lead_in))


def playback_frame(elapsed: str | Column, fps: int = dims.PLAYBACK_FPS) -> Column:
    """First frame whose time lies strictly after the row."""
    return (F.floor(col(elapsed) * fps) + 1).cast("long")


def match_score(prediction: str | Column, target: str | Column) -> Column:
    """0 exact, 1 same scoring group, 3 another group, 5 outside every group."""
    p, t = col(prediction), col(target)
    gp, gt = lookup(p, dims.SCORING_GROUPS), lookup(t, dims.SCORING_GROUPS)
    return F.when(p == t, 0).when(gp == gt, 1).when(gp.isNotNull(), 3).otherwise(5)


def weighted_choice(weights: str | Column, u: str | Column) -> Column:
    """Index drawn from an array of weights by a uniform number ``u`` in [0, 1).

    ``u`` is a column so that a draw can be repeated.
    """
    w = F.transform(col(weights), lambda x: x.cast("double"))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(
        (col(u).cast("double") * total).alias("left"),
        F.lit(0).alias("i"),
        F.lit(None).cast("int").alias("pick"),
    )

    def step(acc, x):
        left = acc["left"] - x
        hit = acc["pick"].isNull() & (left < 0)
        return F.struct(
            left.alias("left"),
            (acc["i"] + 1).alias("i"),
            F.when(hit, acc["i"]).otherwise(acc["pick"]).alias("pick"),
        )

    return F.aggregate(w, start, step, lambda acc: acc["pick"])
