"""Measures of a transition matrix held as sparse ``(to, from, n)`` cells.

Each function returns an aggregate Column for ``groupBy(matrix key)``. A row
with NULL states and ``n = 0`` marks a window without any pair; it adds nothing
to a measure but keeps the window in the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TO, FROM, N = "to_state", "from_state", "n"


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def total() -> Column:
    return _zero(F.sum(N))


def diagonal() -> Column:
    return _zero(F.sum(F.when(F.col(TO) == F.col(FROM), F.col(N))))


def ratio_or(num: Column, den: Column, empty: float) -> Column:
    """``num / den`` as one division, ``empty`` when there is nothing to divide by."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(float(empty)))


def flux() -> Column:
    """Share of pairs that change state; 0 for an empty matrix."""
    return ratio_or(total() - diagonal(), total(), 0.0)


def norm2() -> Column:
    return F.sqrt(_zero(F.sum(F.col(N) * F.col(N))).cast("double"))


def diagonal_norm2() -> Column:
    return F.sqrt(_zero(F.sum(F.when(F.col(TO) == F.col(FROM), F.col(N) * F.col(N)))).cast("double"))


def changeyness(empty_diagonal: float = 1.0) -> Column:
    """Euclidean norm of the matrix over that of its diagonal."""
    d = diagonal_norm2()
    return norm2() / F.when(d == 0, F.lit(float(empty_diagonal))).otherwise(d)


def entropy() -> Column:
    """Shannon entropy in bits over all cells, renormalised to sum 1.

    Uses -sum(p log p) = log(S) - sum(n log n) / S, so one pass is enough.
    """
    n = F.col(N).cast("double")
    s = F.sum(n)
    weighted = F.sum(F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0)))
    return F.when(s > 0, F.log2(s) - weighted / s)


def vector_spread(sum1: Column, sum2: Column, length: int) -> Column:
    """Evenness of a vector from its 1-norm and its squared 2-norm."""
    root = float(length) ** 0.5
    share = F.when(sum1 > 0, F.sqrt(sum2.cast("double")) / sum1).otherwise(F.lit(1.0))
    return F.abs(F.lit(root) * (F.lit(1.0) - share) / F.lit(1.0 - root))


def vector_ratio(sum1: Column, all_sum: Column) -> Column:
    """Share of the matrix that lies in a vector; 1 for an empty matrix."""
    return ratio_or(sum1, all_sum, 1.0)
