"""Damped additive-trend exponential smoothing, one series per group.

The recursion runs along time, so a series is fitted in one place. Its length is
bounded by the calendar slots of the roll-up, never by the number of facts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmill.operators.series import KEY

OUTPUT = (
    "series_key string, step int, ts timestamp, forecast double, lower_bound double, upper_bound double, "
    "method string, mae double, rmse double"
)
ROUNDS = 4


def _run(y: np.ndarray, alpha: np.ndarray, beta: np.ndarray, phi: np.ndarray, start_points: int):
    """One-step errors of all parameter sets at once; the loop is over time only."""
    head = y[: min(start_points, len(y))]
    slope, start = np.polyfit(np.arange(len(head)), head, 1)
    level = np.full_like(alpha, start - slope)
    growth = np.full_like(alpha, slope)
    errors = np.empty((len(y), len(alpha)))
    for i, value in enumerate(y):
        ahead = level + phi * growth
        errors[i] = value - ahead
        new_level = ahead + alpha * errors[i]
        growth = phi * growth + alpha * beta * errors[i]
        level = new_level
    return errors, level, growth


def fit_given(y: np.ndarray, parameters: tuple[float, float, float], start_points: int = 10):
    """The same for given (alpha, beta, phi)."""
    errors, level, growth = _run(y, *[np.array([p]) for p in parameters], start_points)
    return (errors**2).sum(), np.array(parameters), errors[:, 0], level[0], growth[0]


def fit(y: np.ndarray, start_points: int = 10):
    """Smallest squared error over a grid that is narrowed around the best point."""
    low, high = np.array([0.01, 0.01, 0.80]), np.array([0.99, 0.99, 0.995])
    box_low, box_high = low, high
    best = None
    for _ in range(ROUNDS):
        axes = [np.linspace(a, b, 7) for a, b in zip(box_low, box_high)]
        alpha, beta, phi = (g.ravel() for g in np.meshgrid(*axes))
        errors, level, growth = _run(y, alpha, beta, phi, start_points)
        sse = (errors**2).sum(axis=0)
        i = int(sse.argmin())
        if best is None or sse[i] < best[0]:
            best = (sse[i], np.array([alpha[i], beta[i], phi[i]]), errors[:, i], level[i], growth[i])
        reach = (box_high - box_low) / 6
        box_low, box_high = np.maximum(low, best[1] - reach), np.minimum(high, best[1] + reach)
    return best


def smoothing_forecast(
    series: DataFrame, periods: int = 7, start_points: int = 10, parameters: tuple[float, float, float] | None = None
) -> DataFrame:
    """Damped-trend forecasts. The line through the first ``start_points`` values gives the level and the
    growth that the recursion starts from; all values take part in fitting (alpha, beta, phi), unless
    these are given as ``parameters``."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        y = rows["value"].to_numpy(dtype=float)
        _, (_, _, phi), errors, level, growth = fit_given(y, parameters, start_points) if parameters else fit(y, start_points)
        steps = np.arange(1, periods + 1)
        ahead = level + growth * np.cumsum(phi**steps)
        reach = 1.96 * errors.std()
        last = rows["ts"].iloc[-1]
        interval = last - rows["ts"].iloc[-2] if len(rows) > 1 else pd.Timedelta(days=1)
        return pd.DataFrame(
            {
                KEY: rows[KEY].iloc[0],
                "step": steps.astype("int32"),
                "ts": [last + interval * int(i) for i in steps],
                "forecast": ahead,
                "lower_bound": ahead - reach,
                "upper_bound": ahead + reach,
                "method": "exponential_smoothing",
                "mae": np.abs(errors).mean(),
                "rmse": np.sqrt((errors**2).mean()),
            }
        )

    return series.select(KEY, "ts", F.col("value").cast("double")).groupBy(KEY).applyInPandas(one, OUTPUT)
