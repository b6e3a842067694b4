"""Published matrix of a four-player session, and values that follow from it."""

import pytest
from pyspark.sql import functions as F

from fluxweave.operators import stats
from fluxweave.operators import transitions as tr
from tests.conftest import cell_frame

# fixed values: counts of a recorded session, rows are the later state
COUNTS = [
    [260, 2, 38, 1, 2, 0, 0, 2, 0],
    [2, 206, 35, 0, 1, 1, 0, 1, 0],
    [35, 32, 994, 16, 7, 0, 0, 1, 0],
    [0, 5, 11, 77, 24, 1, 0, 2, 1],
    [5, 1, 2, 22, 342, 0, 18, 9, 8],
    [1, 0, 1, 1, 0, 31, 1, 2, 3],
    [1, 0, 0, 1, 17, 1, 139, 6, 1],
    [1, 0, 3, 1, 7, 4, 6, 66, 1],
    [1, 0, 0, 2, 7, 2, 2, 0, 103],
]
GROUPS = {
    (0, 0): 260, (0, 1): 40, (0, 2): 3, (0, 3): 2, (1, 0): 37, (1, 1): 1267, (1, 2): 24, (1, 3): 3,
    (2, 0): 5, (2, 1): 19, (2, 2): 465, (2, 3): 30, (2, 4): 9, (3, 0): 3, (3, 1): 4, (3, 2): 27,
    (3, 3): 256, (3, 4): 5, (4, 0): 1, (4, 2): 9, (4, 3): 4, (4, 4): 103,
}


@pytest.fixture(scope="module")
def nine(spark):
    rows = [(t, f, n) for t, row in enumerate(COUNTS) for f, n in enumerate(row) if n]
    return cell_frame(spark, rows)


def test_reduced_to_groups(nine):
    got = {(r.to_state, r.from_state): r.n for r in tr.reduce_to_groups(nine, ["k"]).collect()}
    assert got == GROUPS


def test_flux_of_groups(nine):
    flux = tr.flux(tr.reduce_to_groups(nine, ["k"]), ["k"]).first().flux
    assert flux == 225 / 2576


def test_row_stochastic(nine):
    p = {(r.to_state, r.from_state): r.p for r in tr.stochastic(nine, ["k"]).collect()}
    assert round(p[0, 0], 8) == 0.85245902
    assert round(p[3, 4], 8) == 0.19834711
    assert round(p[8, 8], 8) == 0.88034188


def test_ensemble_measures(nine):
    row = tr.ensemble_measures(nine, ["k"]).first()
    assert row.flux == pytest.approx(0.18701008767, abs=1e-11)
    assert row.entropy == pytest.approx(4.18292613829, abs=1e-11)


def test_dense_matrix(nine):
    m = tr.dense_matrix(nine, ["k"], 9).first().matrix
    assert [[int(x) for x in row] for row in m] == COUNTS
    s = tr.dense_matrix(nine, ["k"], 9, row_stochastic=True).first().matrix
    assert all(sum(row) == pytest.approx(1) for row in s)


def test_regression_of_published_timings(spark):
    # fixed values: milliseconds of one analysis by number of performers
    rows = list(enumerate([3.33281, 51.9283, 86.6098, 126.357, 157.818]))
    fit = stats.regression(spark.createDataFrame(rows, "performers int, ms double"), "performers", "ms").first()
    assert fit.slope == pytest.approx(38.339908)
    assert fit.intercept == pytest.approx(8.529366)
    assert fit.r2 == pytest.approx(0.99465324)


def test_anova_and_t_agree_for_two_samples(spark):
    rows = [("a", float(x)) for x in (1, 2, 4, 5, 9)] + [("b", float(x)) for x in (3, 8, 8, 11)]
    df = spark.createDataFrame(rows, "s string, v double")
    f = stats.anova(df, "s", "v").first()
    t = stats.pooled_t(df, "s", "v", [("a", "b")]).first()
    assert (f.df_between, f.df_within, t.dof) == (1, 7, 7)
    assert f.f == pytest.approx(t.t**2)
    assert t.t == pytest.approx(-3.3 / (71.8 / 7 * 0.45) ** 0.5)


def test_accuracy_interval(spark):
    df = spark.createDataFrame([(0.8,), (0.9,), (1.0,)], "v double")
    row = stats.accuracy_interval(df, "v").first()
    assert row.mean == pytest.approx(0.9)
    assert row.two_sd == pytest.approx(2 * (0.02 / 3) ** 0.5)


def test_column_form_sums_to_one(nine):
    sums = tr.stochastic(nine, ["k"], by="from_state").groupBy("from_state").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)
