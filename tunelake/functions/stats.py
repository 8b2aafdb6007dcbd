"""p-value functions, applied to aggregated rows only (one per comparison).

Own implementations (no SciPy): the regularized incomplete beta by Lentz's
continued fraction, the exact null distribution of the signed-rank
statistic by dynamic programming, and the normal approximation with tie
correction.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest sample for the exact signed-rank distribution (no zeros, no ties).
EXACT_SIGNED_RANK_MAX_N = 50


def _beta_fraction(a: float, b: float, x: float, limit: int = 1 << 14) -> float:
    """1 / (1 + e1 / (1 + e2 / ...)) of the incomplete beta function (DLMF 8.17.22).

    The first n terms are folded from the last one up, with n doubled until
    the value stays; NaN if it doesn't within ``limit`` terms.
    """
    def term(k: int) -> float:
        m, odd = divmod(k, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    n, before = 16, math.nan
    while n <= limit:
        value = 1.0
        for k in range(n, 0, -1):
            value = 1.0 + term(k) / value
        if abs(value - before) <= 1e-15 * abs(value):
            return 1.0 / value
        n, before = 2 * n, value
    return math.nan


def betainc_reg(a: float, b: float, x: float) -> float:
    """I_x(a, b), the regularized incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lfront = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
              + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lfront) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(lfront) * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided_p(t: float | None, df: float | None) -> float | None:
    """Two-sided p of Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or (isinstance(t, float) and math.isnan(t)) or df <= 0:
        return None if t is None or df is None else float("nan")
    if math.isinf(t):
        return 0.0
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


@lru_cache(maxsize=None)
def _signed_rank_sums(n: int) -> tuple[int, ...]:
    """How many sign patterns of the ranks 1..n give at most each rank sum."""
    counts = [1]
    for rank in range(1, n + 1):
        counts = [(counts[s] if s < len(counts) else 0) + (counts[s - rank] if s >= rank else 0)
                  for s in range(len(counts) + rank)]
    return tuple(accumulate(counts))


def signed_rank_cdf(w: float, n: int) -> float:
    """P(T <= w) for the signed-rank statistic of n untied, non-zero values (one table for each n)."""
    table = _signed_rank_sums(n)
    at = min(math.floor(w + 1e-9), len(table) - 1)
    return table[at] / 2 ** n if at >= 0 else 0.0


def tied_rank_cdf(w: float, ties: tuple[int, ...]) -> float:
    """P(T <= w) for the signed-rank statistic of non-zero values with these ties.

    ``ties``: numbers of equal values, by increasing value.  Doubled mid-ranks
    are whole, so each value adds one convolution with {0, doubled rank} to the
    numbers of sign patterns by doubled rank sum; sums beyond 2 * w aren't needed.
    """
    n, below = sum(ties), 0
    at = min(math.floor(2 * w + 1e-9), n * (n + 1))
    if at < 0:
        return 0.0
    counts = np.zeros(at + 1, np.int64 if n < 63 else object)  # 2 ** n patterns in all
    counts[0] = 1
    for t in ties:
        doubled = 2 * below + t + 1
        below += t
        for _ in range(t if doubled <= at else 0):
            counts[doubled:] += counts[:-doubled].copy()
    return int(counts.sum()) / 2 ** n


def wilcoxon_p(w: float | None, n: int | None, tie_term: float | None, n_zero: int | None,
               has_ties: bool | None, method: str = "auto",
               ties: tuple[int, ...] | None = None) -> tuple[float | None, str]:
    """Two-sided p of W = min(R+, R-) over ``n`` non-zero differences.

    auto: exact when n (with zeros) <= 50 and there are neither zeros nor
    ties, else the normal approximation with tie correction and no
    continuity correction.  exact: exact for up to 50 non-zero differences,
    over their mid-ranks (zeros are dropped; ``ties`` are the numbers of equal
    absolute values), else that approximation.
    """
    if method == "exact":
        if n and ties and sum(ties) == n <= EXACT_SIGNED_RANK_MAX_N and w is not None:
            return min(1.0, 2.0 * tied_rank_cdf(w, tuple(ties))), "exact"
        method = "exact" if n and n <= EXACT_SIGNED_RANK_MAX_N and not has_ties else "approx"
    if w is None or n is None:
        return None, "none"
    if n == 0:
        return 1.0, "none"
    exact = method == "exact" or (method == "auto" and (n + (n_zero or 0)) <= EXACT_SIGNED_RANK_MAX_N
                                  and not n_zero and not has_ties)
    if exact:
        return min(1.0, 2.0 * signed_rank_cdf(w, n)), "exact"
    mn = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - (tie_term or 0.0) / 48.0
    if var <= 0:
        return float("nan"), "approx"
    z = (w - mn) / math.sqrt(var)
    return math.erfc(abs(z) / math.sqrt(2.0)), "approx"


@F.pandas_udf(T.DoubleType())
def _t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([float("nan") if pd.isna(a) or pd.isna(b) else t_two_sided_p(float(a), float(b))
                      for a, b in zip(t, df)], dtype="float64")


def t_pvalue(t: Column, df: Column) -> Column:
    return _t_p_udf(t, df)


_W_SCHEMA = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("method", T.StringType())])


def wilcoxon_pvalue(w: Column, n: Column, tie_term: Column, n_zero: Column, has_ties: Column,
                    ties: Column | None = None, method: str = "auto") -> Column:
    """struct<p double, method string>."""
    @F.pandas_udf(_W_SCHEMA)
    def p_value(w: pd.Series, n: pd.Series, tie: pd.Series, nz: pd.Series, tied: pd.Series, ties: pd.Series) -> pd.DataFrame:
        out = [wilcoxon_p(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b),
                          None if pd.isna(c) else float(c), None if pd.isna(d) else int(d),
                          None if pd.isna(e) else bool(e), method, None if t is None else tuple(int(x) for x in t))
               for a, b, c, d, e, t in zip(w, n, tie, nz, tied, ties)]
        return pd.DataFrame({"p": [o[0] for o in out], "method": [o[1] for o in out]})
    ties = F.lit(None).cast("array<bigint>") if ties is None else ties
    return p_value(w, n, tie_term, n_zero, has_ties, ties)
