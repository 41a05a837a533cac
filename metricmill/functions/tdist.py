"""Two-sided Student t probability, applied to rows that are already aggregated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Terms of the continued fraction; it needs about the square root of the degrees of freedom.
TERMS = 1_000_000


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    def safe(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < 1e-300, 1e-300, v)

    c = np.ones_like(x)
    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    total = d
    active = np.isfinite(x)
    for m in range(1, TERMS):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / safe(1.0 + term * d)
            c = safe(1.0 + term / c)
            total = total * c * d
        if np.all(np.abs(c * d - 1.0)[active] < 1e-15):
            return total
    return np.where(np.abs(c * d - 1.0) < 1e-12, total, np.nan)  # not converged: no value


def _half_step(a: np.ndarray) -> np.ndarray:
    """lgamma(a + 1/2) - lgamma(a), by the asymptotic series at a + 12 and the recurrence down to a.

    Subtracting two large logarithms would lose the digits that large arguments have in common.
    """
    z = a + 12.0
    series = 0.5 * np.log(z) - 1 / (8 * z) + 1 / (192 * z**3) - 1 / (640 * z**5) + 17 / (14336 * z**7) - 31 / (18432 * z**9)
    for k in range(12):
        series = series - np.log((a + k + 0.5) / (a + k))
    return series


def two_sided(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) = I_x(freedom/2, 1/2) at x = freedom / (freedom + t^2)."""
    square = np.minimum(t * t, 1e300)
    a, b = freedom / 2.0, np.full_like(freedom, 0.5)
    x, y = freedom / (freedom + square), square / (freedom + square)
    gamma = _half_step(a) - math.lgamma(0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma + a * np.log(x) + 0.5 * np.log(y))
    low_side = x < (a + 1.0) / (a + 2.5)
    p = np.where(
        low_side,
        front * _fraction(a, b, np.where(low_side, x, 0.0)) / a,
        1.0 - front * _fraction(b, a, np.where(low_side, 0.0, y)) / b,
    )
    return np.where(square == 0.0, 1.0, np.clip(p, 0.0, 1.0))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Null where t is null; 1 where there are no degrees of freedom."""
    known = (t.notna() & df.notna()).to_numpy()
    values = t.fillna(0.0).to_numpy(dtype=float)
    freedom = df.fillna(0.0).to_numpy(dtype=float)
    p = two_sided(values, np.maximum(freedom, 1.0))
    p = np.where(freedom < 1, 1.0, np.where(np.isinf(values), 0.0, p))
    return pd.Series(np.where(known, p, np.nan)).astype(object).where(known, None).astype("float64")
