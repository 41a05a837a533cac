"""Seasonal regression: a line with knots and waves of the week, fitted by normal equations.

Every point gives a row of terms: one, its place, how far it is beyond each knot, and sines and cosines of its
place in the week. The products of all terms, summed per series in one aggregate, are the normal equations;
they have a fixed size whatever the series' length, and are solved one small system per series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmill.operators.forecast import MIN_POINTS, Z95, _steps
from metricmill.operators.series import KEY, indexed

WAVES, KNOTS, WEEK_DAYS = 3, 2, 7
# Added to the diagonal for the slope beyond a knot, as a share of the number of points: keeps short series steady.
RIDGE = 1e-3


def terms(place: Column, n: Column, ts: Column) -> list[Column]:
    """The terms of a point: ``place`` runs from 0 to ``n`` - 1 over the series and goes on into the future."""
    share = place / n
    days = F.unix_micros(ts) / F.lit(86_400_000_000)
    waves = [
        wave(days * (2 * math.pi * k / WEEK_DAYS)) for k in range(1, WAVES + 1) for wave in (F.sin, F.cos)
    ]
    knots = [F.greatest(share - F.lit(k / (KNOTS + 1)), F.lit(0.0)) for k in range(1, KNOTS + 1)]
    return [F.lit(1.0), share, *knots, *waves]


def sums(series: DataFrame) -> DataFrame:
    """(series_key, n, last_ts, prev_ts, yy, xy, xx): the normal equations of every series of ten or more points.

    ``xx`` holds the products of terms i <= j row by row, ``xy`` those with the value.
    """
    rows = indexed(series).filter(F.col("n") >= MIN_POINTS)
    x = terms(F.col("idx").cast("double"), F.col("n").cast("double"), F.col("ts"))
    names = [f"x{i}" for i in range(len(x))]
    rows = rows.withColumns(dict(zip(names, x)))
    y = F.col("value").cast("double")
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(KEY).agg(
        F.max("n").alias("n"), F.max("ts").alias("last_ts"),
        F.max(F.when(F.col("idx") == F.col("n") - 2, F.col("ts"))).alias("prev_ts"),
        F.sum(y * y).alias("yy"), F.array(*[F.sum(F.col(a) * y) for a in names]).alias("xy"), F.array(*products).alias("xx"),
    )


def solve(n: float, yy: float, xy: np.ndarray, xx: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of one series, and the root mean squared residual."""
    size = len(xy)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = xx
    full += np.triu(full, 1).T
    damped = full.copy()
    knots = np.arange(2, 2 + KNOTS)
    damped[knots, knots] += RIDGE * n
    beta = np.linalg.lstsq(damped, xy, rcond=None)[0]
    return beta, math.sqrt(max(yy - 2 * beta @ xy + beta @ full @ beta, 0.0) / n)


def seasonal_regression(series: DataFrame, periods: int = 7) -> DataFrame:
    """Forecast rows (series_key, step, ts, forecast, lower_bound, upper_bound, method, rmse); too short series have none."""
    size = 2 + KNOTS + 2 * WAVES

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [solve(r.n, r.yy, np.asarray(r.xy, float), np.asarray(r.xx, float)) for r in batch.itertuples()]
            yield pd.DataFrame({
                KEY: batch[KEY], "n": batch["n"], "last_ts": batch["last_ts"], "prev_ts": batch["prev_ts"],
                "beta": [b.tolist() for b, _ in made], "rmse": [r for _, r in made],
            })

    fits = sums(series).mapInPandas(fitted, f"{KEY} string, n long, last_ts timestamp, prev_ts timestamp, beta array<double>, rmse double")
    steps = _steps(fits, periods)
    place = (F.col("n") - 1 + F.col("step")).cast("double")
    x = terms(place, F.col("n").cast("double"), F.col("ts"))
    value = sum((F.col("beta")[i] * x[i] for i in range(size)), F.lit(0.0))
    return steps.withColumn("forecast", value).select(
        KEY, "step", "ts", "forecast",
        (F.col("forecast") - Z95 * F.col("rmse")).alias("lower_bound"), (F.col("forecast") + Z95 * F.col("rmse")).alias("upper_bound"),
        F.lit("seasonal_regression").alias("method"), "rmse",
    )
