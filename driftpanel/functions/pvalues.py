"""Two-sided p-value of a correlation from Student's t, for use on single result rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            result *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return result


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p_value(rho: float | None, n: float | None) -> float | None:
    if rho is None or n is None or math.isnan(rho) or n < 3:
        return None
    if abs(rho) >= 1.0:
        return 0.0
    df = n - 2.0
    return incomplete_beta(df / 2.0, 0.5, 1.0 - rho * rho)


@F.pandas_udf(DoubleType())
def _p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p_value(r, k) for r, k in zip(rho, n)], dtype="float64")


def p_value(rho: str, n: str) -> Column:
    """Column form for summary tables of a few rows."""
    return _p_value(F.col(rho), F.col(n).cast("double"))
