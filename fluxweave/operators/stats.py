"""Statistics from grouped aggregates: analysis of variance, t, regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """Size, mean and squared deviations of each sample: one row per sample."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("sample")).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("ss"),
    )


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: F and its degrees of freedom."""
    m = _moments(df, group, value)
    n, mean = F.col("n"), F.col("mean")
    sums = m.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("all_n"),
        F.sum(n * mean).alias("sx"),
        F.sum(n * mean * mean).alias("sxx"),
        F.sum("ss").alias("within"),
    )
    between = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("all_n")
    return sums.select(
        (F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("all_n") - F.col("k")))).alias("f"),
        (F.col("k") - 1).alias("df_between"),
        (F.col("all_n") - F.col("k")).alias("df_within"),
    )


def pooled_t(df: DataFrame, group: str, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Two-sample t with pooled variance for each named pair of samples."""
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    member = (F.col("pair.a") == F.col("sample")) | (F.col("pair.b") == F.col("sample"))
    sides = _moments(df, group, value).withColumn("pair", F.explode(listed)).filter(member)

    def side(c: str, which: str) -> Column:
        return F.max(F.when(F.col(f"pair.{which}") == F.col("sample"), F.col(c))).alias(f"{c}_{which}")

    both = sides.groupBy("pair").agg(*[side(c, w) for c in ("n", "mean", "ss") for w in ("a", "b")])
    dof = F.col("n_a") + F.col("n_b") - 2
    pooled = (F.col("ss_a") + F.col("ss_b")) / dof
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b"))))
    return both.select(F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), t.alias("t"), dof.alias("dof"))


def regression(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def accuracy_interval(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean score and twice its population standard deviation."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (2 * F.stddev_pop(value)).alias("two_sd"))
