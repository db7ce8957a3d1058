"""Two-sided p-value of a correlation, for the handful of rows of a stability table."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def correlation_pvalue(rho: float, n: int) -> float:
    """P(|T| >= |t|) for t = rho sqrt((n-2)/(1-rho^2)) on n-2 degrees of freedom."""
    if n < 3 or math.isnan(rho):
        return math.nan
    df = n - 2
    return regularized_beta(df / 2.0, 0.5, 1.0 - rho * rho)


@F.pandas_udf(T.DoubleType())
def correlation_pvalue_udf(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([
        correlation_pvalue(float(r), int(k)) if pd.notna(r) else float("nan") for r, k in zip(rho, n)
    ])
