"""Forecasts tested on what came after them: every point of a series is an origin once.

From each origin the methods see the points up to it and nothing else; running sums give the line through
these, and one pass over the ordered series gives all origins with the values that followed. Series
are rolled up, so a series is bounded by its calendar slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmill.operators.forecast import MIN_POINTS
from metricmill.operators.series import KEY, in_order, indexed

SEASON = 7
METHODS = ("linear", "moving_average", "seasonal_naive", "last_value")


def _line(step: Column) -> Column:
    """The line through all points so far, ``step`` slots ahead, from running sums over idx and value."""
    n, sx, sy, sxx, sxy = (F.col(c) for c in ("n_so_far", "sx", "sy", "sxx", "sxy"))
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    return (sy - slope * sx) / n + slope * (F.col("idx") + step)


def origins(series: DataFrame, horizon: int = 7, methods: Sequence[str] = METHODS, least: int = MIN_POINTS) -> DataFrame:
    """(series_key, idx, ts, step, method, actual, forecast): all forecasts up to ``horizon`` steps from every origin.

    An origin has at least ``least`` points up to it; steps beyond the series' end have no row. ``moving_average``
    is the mean of the last seven points, ``seasonal_naive`` the value of the same place a season of seven
    before, ``last_value`` the origin's own.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    so_far = in_order().rowsBetween(Window.unboundedPreceding, 0)
    x, y = F.col("idx").cast("double"), F.col("value")
    rows = indexed(series).withColumns({
        "n_so_far": F.count("*").over(so_far), "sx": F.sum(x).over(so_far), "sy": F.sum(y).over(so_far),
        "sxx": F.sum(x * x).over(so_far), "sxy": F.sum(x * y).over(so_far),
        "recent": F.avg(y).over(in_order().rowsBetween(1 - SEASON, 0)),
        **{f"after_{h}": F.lead(y, h).over(in_order()) for h in range(1, horizon + 1)},
        **{f"before_{k}": F.lag(y, k).over(in_order()) for k in range(SEASON)},
    })

    def value(method: str, h: int) -> Column:
        if method == "linear":
            return _line(F.lit(h))
        if method == "moving_average":
            return F.col("recent")
        if method == "last_value":
            return F.col("value")
        return F.col(f"before_{(SEASON - h % SEASON) % SEASON}")  # the same place in the season, the last one seen

    made = F.array(*[
        F.struct(F.lit(h).alias("step"), F.lit(m).alias("method"), F.col(f"after_{h}").alias("actual"), value(m, h).alias("forecast"))
        for h in range(1, horizon + 1) for m in methods
    ])
    kept = rows.filter((F.col("n_so_far") >= least) & (F.col("idx") < F.col("n") - 1))
    return kept.select(KEY, "idx", "ts", F.inline(made)).filter(F.col("actual").isNotNull() & F.col("forecast").isNotNull())


def errors_by_step(pairs: DataFrame) -> DataFrame:
    """(series_key, method, step, origins, mae, rmse, bias, mape) over all origins; mape leaves out zero actuals."""
    gap = F.col("actual") - F.col("forecast")
    return pairs.groupBy(KEY, "method", "step").agg(
        F.count("*").alias("origins"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(gap).alias("bias"),
        (F.avg(F.abs(F.try_divide(gap, F.nullif("actual", F.lit(0.0))))) * 100).alias("mape"),
    )


def best_methods(pairs: DataFrame) -> DataFrame:
    """(series_key, method, rmse): the method with the smallest error over all origins and steps; ties by name."""
    gap = F.col("actual") - F.col("forecast")
    scored = pairs.groupBy(KEY, "method").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))
    return scored.groupBy(KEY).agg(F.min(F.struct("rmse", "method")).alias("best")).select(KEY, "best.method", "best.rmse")
