"""Tail probabilities of the t, F and chi-square distributions.

Applied to result rows only (one per test), as Arrow UDFs. Continued fractions after DLMF 8.17.22 and 8.9.2.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(1.0 - x, b, a)
    terms = 200 + int(6 * math.sqrt(max(a, b)))
    tail = 1.0
    for k in range(terms, 0, -1):
        m = k // 2
        if k % 2 == 0:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = 1.0 + d / tail
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) / (a * tail)


def upper_gamma(a: float, x: float) -> float:
    """Regularised Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total
    tail = 0.0
    for k in range(200 + int(10 * math.sqrt(a)), 0, -1):
        tail = k * (k - a) / (x + 2 * k + 1 - a - tail)
    return front / (x + 1 - a - tail)


#: From here on the beta function is replaced by its limit, whose error falls with the square of the degrees of freedom.
LARGE = 1e6


def beta_limit(a: float, b: float, minus_log_x: float) -> float:
    """I_x(a, b) for large ``a`` (DLMF 8.18.9, first term), from ``-ln x``, which keeps its digits where x is close to 1."""
    return upper_gamma(b, (a + (b - 1) / 2) * minus_log_x)


def t_two_sided(t: float, df: float) -> float:
    if df > LARGE:
        return beta_limit(df / 2, 0.5, math.log1p(t * t / df))
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    if f > 0 and d2 > LARGE and d1 < 1000:
        return beta_limit(d2 / 2, d1 / 2, math.log1p(d1 * f / d2))
    return 1.0 if f <= 0 else incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_upper(x: float, k: float) -> float:
    return upper_gamma(k / 2, x / 2)


def _over(fn, *series: pd.Series) -> pd.Series:
    rows = zip(*series)
    return pd.Series([fn(*r) if all(v is not None and not np.isnan(v) for v in r) else None for r in rows], dtype="float64")


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _over(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _over(f_upper, f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return _over(chi2_upper, x, k)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided."""
    return _over(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)
