"""Transition matrices, their measures, and series over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxweave.dims import DEV, PERF
from fluxweave.functions import scalars as sc
from fluxweave.operators import messages as ms
from fluxweave.operators import series as se
from fluxweave.operators import transitions as tr
from fluxweave.plans import testviews as tv
from fluxweave.plans.catalog.base import iso, iso_sql, query, rounded, rounded_sql
from fluxweave.plans.testviews import CHUNK, DAY, GAP, HOUR, TRAIL, WIDTH, bin_sql, steps_sql, with_sql

MONTH = 30 * DAY
W_KEYS = [PERF, "window_start"]
STEPS5, STEPS9 = steps_sql(), steps_sql(states="full")

WINDOW5 = f"""SELECT performance_id, {bin_sql('time', WIDTH)} AS window_start, to_state, from_state,
    count(to_state) AS n FROM steps GROUP BY ALL"""
WHOLE = "SELECT performance_id, to_state, from_state, count(*) AS n FROM steps WHERE to_state IS NOT NULL GROUP BY ALL"
FLUX = "CASE WHEN sum(n) > 0 THEN CAST(sum(n) - coalesce(sum(n) FILTER (to_state = from_state), 0) AS DOUBLE) / CAST(sum(n) AS DOUBLE) ELSE 0 END"
SERIES = f"SELECT performance_id, window_start, {FLUX} AS flux FROM counts GROUP BY ALL"


def window5_sql(body: str, **extra: str) -> str:
    return with_sql(body, "gestures", steps=STEPS5, counts=WINDOW5, **extra)


def series_sql(body: str, **extra: str) -> str:
    return window5_sql(body, series=SERIES, **extra)


def steps(spark, d, states="group"):
    return tr.state_steps(tv.gestures(spark, d), states, chunk_seconds=CHUNK)


def window5(spark, d):
    return tr.window_counts(steps(spark, d), WIDTH)


def series(spark, d):
    return se.flux_series(window5(spark, d))


def whole9(spark, d):
    return tr.cells(tr.whole_counts(steps(spark, d, "full")))


@query(
    "transition_steps",
    with_sql(
        f"SELECT performance_id, device_id, {iso_sql('time')}, coalesce(to_state, -1) AS to_state, "
        "coalesce(from_state, -1) AS from_state FROM steps",
        "gestures",
        steps=STEPS5,
    ),
)
def transition_steps(spark, d):
    return steps(spark, d).select(
        PERF, DEV, iso("time"), F.coalesce("to_state", F.lit(-1)).alias("to_state"),
        F.coalesce("from_state", F.lit(-1)).alias("from_state"),
    )


@query(
    "transition_steps_nine_states",
    with_sql(
        f"SELECT performance_id, device_id, {iso_sql('time')}, to_state, from_state FROM steps WHERE to_state IS NOT NULL",
        "gestures",
        steps=STEPS9,
    ),
)
def transition_steps_nine_states(spark, d):
    return steps(spark, d, "full").filter("to_state IS NOT NULL").select(PERF, DEV, iso("time"), "to_state", "from_state")


@query(
    "transition_counts_by_window",
    window5_sql(f"SELECT performance_id, {iso_sql('window_start')}, to_state, from_state, n FROM counts WHERE n > 0"),
)
def transition_counts_by_window(spark, d):
    return tr.cells(window5(spark, d)).select(PERF, iso("window_start"), "to_state", "from_state", "n")


@query(
    "transition_counts_by_window_nine_states",
    with_sql(
        f"SELECT performance_id, {iso_sql('window_start')}, to_state, from_state, n FROM counts WHERE n > 0",
        "gestures",
        steps=STEPS9,
        counts=WINDOW5,
    ),
)
def transition_counts_by_window_nine_states(spark, d):
    counts = tr.window_counts(steps(spark, d, "full"), WIDTH, keep_first_rows=False)
    return tr.cells(counts).select(PERF, iso("window_start"), "to_state", "from_state", "n")


@query(
    "transition_counts_whole",
    with_sql("SELECT * FROM whole", "gestures", steps=STEPS5, whole=WHOLE),
)
def transition_counts_whole(spark, d):
    return tr.cells(tr.whole_counts(steps(spark, d))).select(PERF, "to_state", "from_state", "n")


@query(
    "transition_counts_whole_nine_states",
    with_sql("SELECT * FROM whole", "gestures", steps=STEPS9, whole=WHOLE),
)
def transition_counts_whole_nine_states(spark, d):
    return whole9(spark, d).select(PERF, "to_state", "from_state", "n")


DAILY = f"""SELECT performance_id, device_id, {bin_sql('time', DAY)} AS time, max_by(gesture, time) AS gesture
    FROM gestures GROUP BY performance_id, device_id, {bin_sql('time', DAY)}"""
COMPLETE = """SELECT g.* FROM daily g
    JOIN (SELECT performance_id, time, count(*) AS present FROM daily GROUP BY ALL) USING (performance_id, time)
    JOIN (SELECT performance_id, count(DISTINCT device_id) AS players FROM daily GROUP BY ALL) USING (performance_id)
    WHERE present = players"""


def daily(spark, d):
    """One gesture per device and day; days without one are missing."""
    g = tv.gestures(spark, d)
    return g.groupBy(PERF, DEV, sc.bin_start("time", DAY).alias("time")).agg(F.max_by("gesture", "time").alias("gesture"))


@query(
    "transition_counts_complete_rows",
    with_sql(
        "SELECT * FROM whole",
        "gestures",
        daily=DAILY,
        complete=COMPLETE.replace("g.*", "g.performance_id, g.device_id, g.time, g.gesture"),
        steps=steps_sql("complete", "full"),
        whole=WHOLE,
    ),
)
def transition_counts_complete_rows(spark, d):
    full = tr.complete_rows(daily(spark, d))
    return tr.cells(tr.whole_counts(tr.state_steps(full, "full", chunk_seconds=CHUNK))).select(
        PERF, "to_state", "from_state", "n"
    )


@query(
    "transition_counts_by_device",
    with_sql(
        "SELECT performance_id, device_id, to_state, from_state, count(*) AS n FROM steps "
        "WHERE to_state IS NOT NULL GROUP BY ALL",
        "gestures",
        steps=STEPS5,
    ),
)
def transition_counts_by_device(spark, d):
    return tr.cells(tr.device_counts(steps(spark, d))).select(PERF, DEV, "to_state", "from_state", "n")


@query(
    "transition_counts_inside_window",
    with_sql(
        f"SELECT performance_id, device_id, {iso_sql('window_start')}, s AS to_state, p AS from_state, count(*) AS n "
        "FROM pairs WHERE s IS NOT NULL AND p IS NOT NULL GROUP BY performance_id, device_id, window_start, s, p",
        "gestures",
        pairs=f"""SELECT *, lag(s) OVER (PARTITION BY performance_id, device_id, window_start ORDER BY time) AS p
            FROM (SELECT *, {bin_sql('time', 2 * DAY)} AS window_start, {tv.FULL_OF.format(g='gesture')} AS s FROM gestures)""",
    ),
)
def transition_counts_inside_window(spark, d):
    counts = tr.window_local_counts(tv.gestures(spark, d), 2 * DAY)
    return tr.cells(counts).select(PERF, DEV, iso("window_start"), "to_state", "from_state", "n")


@query(
    "matrix_reduced_to_groups",
    with_sql(
        f"""SELECT performance_id, {tv.GROUP_OF.format(g='to_state')} AS to_state,
        {tv.GROUP_OF.format(g='from_state')} AS from_state, CAST(sum(n) AS BIGINT) AS n FROM whole GROUP BY 1, 2, 3""",
        "gestures",
        steps=STEPS9,
        whole=WHOLE,
    ),
)
def matrix_reduced_to_groups(spark, d):
    return tr.reduce_to_groups(whole9(spark, d), [PERF]).select(PERF, "to_state", "from_state", "n")


@query(
    "matrix_row_stochastic",
    with_sql(
        f"SELECT performance_id, to_state, from_state, "
        f"{rounded_sql('n / sum(n) OVER (PARTITION BY performance_id, to_state)', 'p')} FROM whole",
        "gestures",
        steps=STEPS9,
        whole=WHOLE,
    ),
)
def matrix_row_stochastic(spark, d):
    return tr.stochastic(whole9(spark, d), [PERF]).select(PERF, "to_state", "from_state", rounded("p"))


@query(
    "matrix_column_stochastic",
    with_sql(
        f"SELECT performance_id, to_state, from_state, "
        f"{rounded_sql('n / sum(n) OVER (PARTITION BY performance_id, from_state)', 'p')} FROM whole",
        "gestures",
        steps=STEPS9,
        whole=WHOLE,
    ),
)
def matrix_column_stochastic(spark, d):
    return tr.stochastic(whole9(spark, d), [PERF], by="from_state").select(PERF, "to_state", "from_state", rounded("p"))


@query(
    "matrix_normal",
    window5_sql(
        f"SELECT performance_id, {iso_sql('window_start')}, to_state, from_state, "
        f"{rounded_sql('n / sum(n) OVER (PARTITION BY performance_id, window_start)', 'p')} FROM counts WHERE n > 0"
    ),
)
def matrix_normal(spark, d):
    return tr.normal(window5(spark, d), W_KEYS).select(
        PERF, iso("window_start"), "to_state", "from_state", rounded("p")
    )


@query("matrix_flux", with_sql(f"SELECT performance_id, {rounded_sql(FLUX, 'flux')} FROM whole GROUP BY 1", "gestures", steps=STEPS9, whole=WHOLE))
def matrix_flux(spark, d):
    return tr.flux(whole9(spark, d), [PERF]).select(PERF, rounded("flux"))


@query(
    "matrix_entropy",
    window5_sql(
        f"SELECT performance_id, {iso_sql('window_start')}, {rounded_sql('-sum(p * log2(p))', 'entropy')} FROM shares GROUP BY 1, 2",
        shares="SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY performance_id, window_start) AS p FROM counts WHERE n > 0",
    ),
)
def matrix_entropy(spark, d):
    return tr.entropy(window5(spark, d), W_KEYS).select(PERF, iso("window_start"), rounded("entropy"))


ENSEMBLE = """SELECT performance_id, sum(CASE WHEN to_state <> from_state THEN p ELSE 0 END) / sum(p) AS flux,
    log2(sum(p)) - sum(p * log2(p)) / sum(p) AS entropy FROM shares GROUP BY 1"""
SHARES = "SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY performance_id, to_state) AS p FROM whole"


@query(
    "ensemble_flux_and_entropy",
    with_sql(
        f"SELECT performance_id, {rounded_sql('flux')}, {rounded_sql('entropy')} FROM measures",
        "gestures",
        daily=DAILY,
        complete=COMPLETE.replace("g.*", "g.performance_id, g.device_id, g.time, g.gesture"),
        steps=steps_sql("complete", "full"),
        whole=WHOLE,
        shares=SHARES,
        measures=ENSEMBLE,
    ),
)
def ensemble_flux_and_entropy(spark, d):
    full = tr.complete_rows(daily(spark, d))
    counts = tr.whole_counts(tr.state_steps(full, "full", chunk_seconds=CHUNK))
    return tr.ensemble_measures(counts, [PERF]).select(PERF, rounded("flux"), rounded("entropy"))


def spread_sql(s1: str, s2: str, n: int = 5) -> str:
    return (
        f"abs(sqrt({n}) * (1 - CASE WHEN {s1} > 0 THEN sqrt(CAST({s2} AS DOUBLE)) / CAST({s1} AS DOUBLE) ELSE 1 END)"
        f" / (1 - sqrt({n})))"
    )


LINES = "SELECT performance_id, {axis}, sum(n) AS s1, sum(n * n) AS s2 FROM whole GROUP BY 1, 2"


@query(
    "matrix_row_spread_and_ratio",
    with_sql(
        f"SELECT performance_id, to_state, {rounded_sql(spread_sql('s1', 's2', 9), 'spread')}, "
        f"{rounded_sql('s1 / sum(s1) OVER (PARTITION BY performance_id)', 'ratio')} FROM lines",
        "gestures",
        steps=STEPS9,
        whole=WHOLE,
        lines=LINES.format(axis="to_state"),
    ),
)
def matrix_row_spread_and_ratio(spark, d):
    return tr.line_measures(whole9(spark, d), [PERF], "to_state", 9).select(
        PERF, "to_state", rounded("spread"), rounded("ratio")
    )


@query(
    "matrix_column_spread_and_ratio",
    with_sql(
        f"SELECT performance_id, from_state, {rounded_sql(spread_sql('s1', 's2', 9), 'spread')}, "
        f"{rounded_sql('s1 / sum(s1) OVER (PARTITION BY performance_id)', 'ratio')} FROM lines",
        "gestures",
        steps=STEPS9,
        whole=WHOLE,
        lines=LINES.format(axis="from_state"),
    ),
)
def matrix_column_spread_and_ratio(spark, d):
    return tr.line_measures(whole9(spark, d), [PERF], "from_state", 9).select(
        PERF, "from_state", rounded("spread"), rounded("ratio")
    )


def state_sql(body: str, size: int, **views: str) -> str:
    """The state rules over a view ``counts``, by separate row, column and diagonal sums."""
    k = "performance_id, window_start"
    return with_sql(
        body,
        "gestures",
        **views,
        keys=f"SELECT DISTINCT {k} FROM counts",
        whole=f"SELECT {k}, sum(n) AS all1 FROM counts GROUP BY ALL",
        diag=f"SELECT {k}, sum(n) AS d1, sum(n * n) AS d2 FROM counts WHERE to_state = from_state GROUP BY ALL",
        r=f"""SELECT {k}, s1 AS r1, s2 AS r2 FROM (SELECT {k}, to_state, sum(n) AS s1, sum(n * n) AS s2 FROM counts
            WHERE n > 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY s2 DESC, to_state) = 1""",
        c=f"""SELECT {k}, s1 AS c1, s2 AS c2 FROM (SELECT {k}, from_state, sum(n) AS s1, sum(n * n) AS s2 FROM counts
            WHERE n > 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY s2 DESC, from_state) = 1""",
        weights=f"""SELECT {k}, coalesce(all1, 0) AS all1, coalesce(d1, 0) AS d1, coalesce(d2, 0) AS d2,
            coalesce(r1, 0) AS r1, coalesce(r2, 0) AS r2, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2
            FROM keys LEFT JOIN whole USING ({k}) LEFT JOIN diag USING ({k}) LEFT JOIN r USING ({k}) LEFT JOIN c USING ({k})""",
        named="""SELECT *, CASE WHEN d2 = c2 AND c2 = r2 THEN 'stasis' WHEN c2 = r2 THEN 'development'
            WHEN d2 = r2 THEN 'divergence' WHEN d2 = c2 THEN 'convergence'
            WHEN d2 > c2 AND d2 > r2 THEN 'stasis' WHEN c2 > r2 THEN 'convergence' ELSE 'divergence' END AS state
            FROM weights""",
        picked="""SELECT *, CASE state WHEN 'convergence' THEN c1 WHEN 'divergence' THEN r1 ELSE d1 END AS v1,
            CASE state WHEN 'convergence' THEN c2 WHEN 'divergence' THEN r2 ELSE d2 END AS v2 FROM named""",
        states=f"""SELECT {k}, state,
            CASE WHEN state = 'development' THEN 1 ELSE {spread_sql('v1', 'v2', size)} END AS spread,
            CASE WHEN state = 'development' THEN 1 - CASE WHEN all1 > 0 THEN CAST(d1 AS DOUBLE) / CAST(all1 AS DOUBLE) ELSE 1 END
                 WHEN all1 > 0 THEN CAST(v1 AS DOUBLE) / CAST(all1 AS DOUBLE) ELSE 1 END AS ratio FROM picked""",
    )


for _axis, _line in (("to_state", "row"), ("from_state", "column")):

    @query(
        f"heaviest_{_line}_by_window",
        window5_sql(
            f"""SELECT performance_id, {iso_sql('window_start')}, {_axis}, CAST(weight AS BIGINT) AS weight, CAST(s AS BIGINT) AS n FROM
            (SELECT performance_id, window_start, {_axis}, sum(n * n) AS weight, sum(n) AS s FROM counts WHERE n > 0 GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY performance_id, window_start ORDER BY weight DESC, {_axis}) = 1"""
        ),
    )
    def heaviest_line_by_window(spark, d, axis=_axis):
        return tr.heaviest_line(window5(spark, d), W_KEYS, axis).select(PERF, iso("window_start"), axis, "weight", "n")


STATE_ROWS = f"SELECT performance_id, {iso_sql('window_start')}, state, {rounded_sql('spread')}, {rounded_sql('ratio')} FROM states"


@query("ensemble_state_by_window", state_sql(STATE_ROWS, 5, steps=STEPS5, counts=WINDOW5))
def ensemble_state_by_window(spark, d):
    return tr.ensemble_state(window5(spark, d), W_KEYS).select(
        PERF, iso("window_start"), "state", rounded("spread"), rounded("ratio")
    )


@query("ensemble_state_by_window_nine_states", state_sql(STATE_ROWS, 9, steps=STEPS9, counts=WINDOW5))
def ensemble_state_by_window_nine_states(spark, d):
    counts = tr.window_counts(steps(spark, d, "full"), WIDTH)
    return tr.ensemble_state(counts, W_KEYS, 9).select(
        PERF, iso("window_start"), "state", rounded("spread"), rounded("ratio")
    )


@query(
    "ensemble_state_codes",
    state_sql(
        """SELECT CASE state WHEN 'stasis' THEN 0 WHEN 'convergence' THEN 1 WHEN 'divergence' THEN 2 ELSE 3 END AS state_code,
        count(*) AS windows FROM states GROUP BY 1""",
        5,
        steps=STEPS5,
        counts=WINDOW5,
    ),
)
def ensemble_state_codes(spark, d):
    states = tr.ensemble_state(window5(spark, d), W_KEYS).withColumnRenamed("state", "transition_type")
    return ms.coded_transitions(states).groupBy("state_code").agg(F.count(F.lit(1)).alias("windows"))


def changey_sql(zero: str) -> str:
    return window5_sql(
        f"""SELECT performance_id, {iso_sql('window_start')}, {rounded_sql(f'm / CASE WHEN dd = 0 THEN {zero} ELSE dd END', 'changeyness')} FROM norms""",
        norms="""SELECT performance_id, window_start, sqrt(CAST(sum(n * n) AS DOUBLE)) AS m,
            sqrt(CAST(coalesce(sum(n * n) FILTER (to_state = from_state), 0) AS DOUBLE)) AS dd FROM counts GROUP BY ALL""",
    )


@query("changeyness_by_window", changey_sql("CAST(1 AS DOUBLE)"))
def changeyness_by_window(spark, d):
    return tr.changeyness(window5(spark, d), W_KEYS).select(PERF, iso("window_start"), rounded("changeyness"))


@query("changeyness_by_window_half", changey_sql("CAST(0.5 AS DOUBLE)"))
def changeyness_by_window_half(spark, d):
    return tr.changeyness(window5(spark, d), W_KEYS, 0.5).select(PERF, iso("window_start"), rounded("changeyness"))


@query(
    "changeyness_column_sum",
    window5_sql(
        f"""SELECT performance_id, {iso_sql('window_start')}, CAST(coalesce(max(s), 0) - coalesce(max(dd), 0) AS BIGINT) AS changeyness FROM
        (SELECT performance_id, window_start, sum(n) OVER (PARTITION BY performance_id, window_start, from_state) AS s,
         sum(CASE WHEN to_state = from_state THEN n ELSE 0 END) OVER (PARTITION BY performance_id, window_start) AS dd FROM counts) GROUP BY 1, 2""",
    ),
)
def changeyness_column_sum(spark, d):
    return tr.column_changeyness(window5(spark, d), W_KEYS).select(PERF, iso("window_start"), "changeyness")


WIDTHS = [6 * HOUR, 12 * HOUR, 18 * HOUR, 24 * HOUR, 30 * HOUR, 36 * HOUR, 42 * HOUR, 48 * HOUR]


@query(
    "changeyness_for_many_widths",
    with_sql(
        f"""SELECT performance_id, width, {iso_sql('window_start')}, {rounded_sql('m / CASE WHEN dd = 0 THEN CAST(1 AS DOUBLE) ELSE dd END', 'changeyness')} FROM
        (SELECT performance_id, width, window_start, sqrt(CAST(sum(n * n) AS DOUBLE)) AS m,
         sqrt(CAST(coalesce(sum(n * n) FILTER (to_state = from_state), 0) AS DOUBLE)) AS dd FROM counts GROUP BY ALL)""",
        "gestures",
        steps=STEPS5,
        widths=f"SELECT unnest([{', '.join(map(str, WIDTHS))}]) AS width",
        counts="""SELECT performance_id, width, make_timestamp(epoch_us(time) - epoch_us(time) % (CAST(width AS BIGINT) * 1000000)) AS window_start,
            to_state, from_state, count(to_state) AS n FROM steps, widths WHERE prev_time IS NOT NULL GROUP BY ALL""",
    ),
)
def changeyness_for_many_widths(spark, d):
    counts = tr.multi_width_counts(steps(spark, d), WIDTHS)
    return tr.changeyness(counts, [PERF, "width", "window_start"]).select(
        PERF, "width", iso("window_start"), rounded("changeyness")
    )


@query(
    "matrix_equality",
    with_sql(
        f"""SELECT a.performance_id, a.to_state, a.from_state, CAST(coalesce(a.n, 0) AS BIGINT) AS n_a, CAST(coalesce(b.n, 0) AS BIGINT) AS n_b
        FROM g a FULL JOIN r b USING (performance_id, to_state, from_state) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
        "gestures",
        steps=STEPS5,
        g=WHOLE,
        nine=STEPS9,
        r=f"""SELECT performance_id, {tv.GROUP_OF.format(g='to_state')} AS to_state, {tv.GROUP_OF.format(g='from_state')} AS from_state,
            count(*) AS n FROM nine WHERE to_state IS NOT NULL GROUP BY 1, 2, 3""",
    ),
)
def matrix_equality(spark, d):
    """The five-group matrices against the reduced nine-state ones: they differ by the unsure state."""
    groups = tr.cells(tr.whole_counts(steps(spark, d)))
    reduced = tr.reduce_to_groups(whole9(spark, d), [PERF])
    return tr.matrix_differences(groups, reduced, [PERF])


@query(
    "matrix_dense_cells",
    window5_sql(
        f"""SELECT performance_id, {iso_sql('window_start')}, to_state, from_state, CAST(n AS BIGINT) AS n,
        round(CASE WHEN total > 0 THEN CAST(n AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0 END, 6) + CAST(0 AS DOUBLE) AS p FROM
        (SELECT k.performance_id, k.window_start, k.total, i.i // 5 AS to_state, i.i % 5 AS from_state, coalesce(c.n, 0) AS n
         FROM (SELECT performance_id, window_start, sum(n) AS total FROM counts GROUP BY ALL) k
         CROSS JOIN (SELECT CAST(unnest(range(25)) AS INT) AS i) i
         LEFT JOIN counts c ON c.performance_id = k.performance_id AND c.window_start = k.window_start
             AND c.to_state = i.i // 5 AND c.from_state = i.i % 5)""",
    ),
)
def matrix_dense_cells(spark, d):
    return tr.dense_cells(window5(spark, d), W_KEYS).select(
        PERF, iso("window_start"), "to_state", "from_state", "n", rounded("p")
    )


@query(
    "flux_series",
    series_sql(f"SELECT performance_id, {iso_sql('window_start')}, {rounded_sql('flux')} FROM series"),
)
def flux_series(spark, d):
    return series(spark, d).select(PERF, iso("window_start"), rounded("flux"))


RISES = "SELECT *, flux - lag(flux) OVER (PARTITION BY performance_id ORDER BY window_start) AS rise FROM series"


@query(
    "new_ideas",
    series_sql(
        f"SELECT performance_id, {iso_sql('window_start')}, {rounded_sql('flux')}, {rounded_sql('rise')} FROM rises "
        "WHERE rise > CAST(0.3 AS DOUBLE)",
        rises=RISES,
    ),
)
def new_ideas(spark, d):
    return se.new_ideas(series(spark, d)).select(PERF, iso("window_start"), rounded("flux"), rounded("rise"))


@query(
    "new_idea_markers",
    series_sql(
        f"SELECT performance_id, {iso_sql('window_start + INTERVAL 3 HOUR', 'marker_time')} FROM rises WHERE rise > CAST(0.15 AS DOUBLE)",
        rises=RISES,
    ),
)
def new_idea_markers(spark, d):
    return se.marker_shift(se.new_ideas(series(spark, d), 0.15), WIDTH).select(PERF, iso("marker_time"))


@query(
    "latest_new_idea",
    series_sql(
        f"""SELECT performance_id, {iso_sql('window_start')}, {rounded_sql('flux')}, coalesce(rise > CAST(0.1 AS DOUBLE), false) AS is_new_idea FROM rises
        QUALIFY row_number() OVER (PARTITION BY performance_id ORDER BY window_start DESC) = 1""",
        rises=RISES,
    ),
)
def latest_new_idea(spark, d):
    return se.latest_new_idea(series(spark, d), 0.1).select(PERF, iso("window_start"), rounded("flux"), "is_new_idea")


@query(
    "rolling_flux_fifteen_rows",
    with_sql(
        f"""SELECT performance_id, {iso_sql('time')}, round(CASE WHEN pairs > 0 THEN CAST(moved AS DOUBLE) / CAST(pairs AS DOUBLE) ELSE 0 END, 6) + CAST(0 AS DOUBLE) AS flux
        FROM (SELECT performance_id, time, rn, sum(pairs) OVER w AS pairs, sum(moved) OVER w AS moved FROM
          (SELECT *, row_number() OVER (PARTITION BY performance_id ORDER BY time) AS rn FROM
            (SELECT performance_id, time, count(to_state) AS pairs, count(*) FILTER (to_state <> from_state) AS moved FROM steps GROUP BY ALL))
          WINDOW w AS (PARTITION BY performance_id ORDER BY time ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)) WHERE rn > 15""",
        "gestures",
        steps=STEPS5,
    ),
)
def rolling_flux_fifteen_rows(spark, d):
    rolled = se.rolling_flux(steps(spark, d), chunk_seconds=CHUNK)
    return rolled.select(PERF, iso("time"), rounded("flux"))


def trailing_sql(body: str) -> str:
    us, tr_us = WIDTH * 1_000_000, TRAIL * 1_000_000
    return with_sql(
        body,
        "gestures",
        steps=STEPS5,
        s="SELECT performance_id, epoch_us(time) AS t, epoch_us(prev_time) AS p, to_state, from_state FROM steps",
        a="SELECT DISTINCT performance_id, t FROM s",
        frame=f"""SELECT a.performance_id, a.t AS t0, s.t - s.t % {us} AS bin,
            count(*) FILTER (s.p >= a.t - {tr_us} AND to_state IS NOT NULL) AS pairs,
            count(*) FILTER (s.p >= a.t - {tr_us} AND to_state <> from_state) AS moved
            FROM a JOIN s ON s.performance_id = a.performance_id AND s.t BETWEEN a.t - {tr_us} AND a.t GROUP BY 1, 2, 3""",
        bins="""SELECT *, CASE WHEN pairs > 0 THEN CAST(moved AS DOUBLE) / CAST(pairs AS DOUBLE) ELSE 0 END AS flux,
            row_number() OVER (PARTITION BY performance_id, t0 ORDER BY bin DESC) AS back FROM frame""",
        pairs="""SELECT l.performance_id, make_timestamp(l.t0) AS time, l.flux AS flux, coalesce(l.flux - b.flux, 0) AS flux_rise
            FROM (SELECT * FROM bins WHERE back = 1) l
            LEFT JOIN (SELECT * FROM bins WHERE back = 2) b USING (performance_id, t0)""",
    )


@query("trailing_flux", trailing_sql(f"SELECT performance_id, {iso_sql('time')}, {rounded_sql('flux')} FROM pairs"))
def trailing_flux(spark, d):
    return se.trailing_flux(steps(spark, d), TRAIL, WIDTH).select(PERF, iso("time"), rounded("flux"))


@query("trailing_flux_rise", trailing_sql(f"SELECT performance_id, {iso_sql('time')}, {rounded_sql('flux_rise')} FROM pairs"))
def trailing_flux_rise(spark, d):
    return se.trailing_flux(steps(spark, d), TRAIL, WIDTH).select(PERF, iso("time"), rounded("flux_rise"))


@query(
    "flux_forward_filled",
    series_sql(
        f"SELECT performance_id, {iso_sql('g', 'time')}, {rounded_sql('flux')} FROM "
        "(SELECT performance_id, flux, unnest(generate_series(window_start, coalesce(nxt - INTERVAL 1 HOUR, window_start), INTERVAL 1 HOUR)) AS g FROM "
        "(SELECT *, lead(window_start) OVER (PARTITION BY performance_id ORDER BY window_start) AS nxt FROM series))",
    ),
)
def flux_forward_filled(spark, d):
    filled = se.forward_fill(series(spark, d), [PERF], "window_start", ["flux"], HOUR, CHUNK)
    return filled.select(PERF, iso("window_start", "time"), rounded("flux"))


@query(
    "gesture_line_segments",
    with_sql(
        f"""SELECT performance_id, device_id, {iso_sql('time')}, gesture, {iso_sql('prev_time')}, prev_gesture FROM
        (SELECT *, lag(time) OVER w AS prev_time, lag(gesture) OVER w AS prev_gesture FROM gestures
         WINDOW w AS (PARTITION BY performance_id, device_id ORDER BY time)) WHERE prev_time IS NOT NULL""",
        "gestures",
    ),
)
def gesture_line_segments(spark, d):
    return se.line_segments(tv.gestures(spark, d), CHUNK).filter("prev_time IS NOT NULL").select(
        PERF, DEV, iso("time"), "gesture", iso("prev_time"), "prev_gesture"
    )


DEBOUNCE = f"""SELECT performance_id, min(time) AS time FROM ideas GROUP BY 1
    UNION ALL
    SELECT k.performance_id, (SELECT min(i.time) FROM ideas i WHERE i.performance_id = k.performance_id
                              AND i.time > k.time + INTERVAL {GAP} SECOND) AS time
    FROM kept k WHERE k.time IS NOT NULL"""


@query(
    "debounced_new_ideas",
    with_sql(
        f"SELECT performance_id, {iso_sql('time')} FROM kept WHERE time IS NOT NULL",
        "idea_events",
        ideas="SELECT performance_id, time FROM idea_events WHERE event_type = 'new_idea'",
        kept=DEBOUNCE,
    ),
)
def debounced_new_ideas(spark, d):
    ideas = ms.new_idea_events(tv.idea_events(spark, d))
    return se.debounced(ideas, GAP, chunk_gaps=8).select(PERF, iso("time"))


@query(
    "debounced_new_ideas_flagged",
    with_sql(
        "SELECT i.performance_id, count(*) AS ideas, count(k.time) AS screen_changes FROM ideas i "
        "LEFT JOIN kept k USING (performance_id, time) GROUP BY 1",
        "idea_events",
        ideas="SELECT performance_id, time FROM idea_events WHERE event_type = 'new_idea'",
        kept=DEBOUNCE,
    ),
)
def debounced_new_ideas_flagged(spark, d):
    ideas = ms.new_idea_events(tv.idea_events(spark, d))
    return (
        se.with_debounce(ideas, GAP)
        .groupBy(PERF)
        .agg(F.count(F.lit(1)).alias("ideas"), F.count_if("screen_changed").alias("screen_changes"))
    )


@query(
    "weighted_choice",
    with_sql(
        """SELECT performance_id, to_state, CAST(min(from_state) AS INT) AS pick FROM
        (SELECT *, sum(n) OVER (PARTITION BY performance_id, to_state ORDER BY from_state) AS cum,
         sum(n) OVER (PARTITION BY performance_id, to_state) AS total FROM whole)
        WHERE cum > ((performance_id * 7 + to_state * 3) % 10 + CAST(0.5 AS DOUBLE)) / 10 * total GROUP BY 1, 2""",
        "gestures",
        steps=STEPS9,
        whole=WHOLE,
    ),
)
def weighted_choice(spark, d):
    matrix = tr.dense_matrix(whole9(spark, d), [PERF], 9).select(PERF, F.posexplode("matrix").alias("to_state", "weights"))
    u = ((F.col(PERF) * 7 + F.col("to_state") * 3) % 10 + F.lit(0.5)) / 10
    return matrix.select(PERF, "to_state", sc.weighted_choice("weights", u).alias("pick")).filter("pick IS NOT NULL")


SUPPLY5 = steps_sql("supply_states")


@query(
    "supply_flux_series",
    with_sql(
        f"SELECT performance_id, {iso_sql('window_start')}, {rounded_sql('flux')} FROM series",
        "supply_states",
        steps=SUPPLY5,
        counts=f"SELECT performance_id, {bin_sql('time', MONTH)} AS window_start, to_state, from_state, count(to_state) AS n FROM steps GROUP BY ALL",
        series=SERIES,
    ),
)
def supply_flux_series(spark, d):
    """Flux series over the longer line-item state sequence."""
    st = tr.state_steps(tv.supply_states(spark, d), chunk_seconds=365 * DAY)
    return se.flux_series(tr.window_counts(st, MONTH)).select(PERF, iso("window_start"), rounded("flux"))
