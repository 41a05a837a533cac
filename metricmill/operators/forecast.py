"""Forecasts for many series at once: method choice, rows per step, fit metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmill.functions.timeparts import in_period
from metricmill.operators.metrics import rollup_series
from metricmill.operators.series import KEY, in_order, indexed, whole, with_line
from metricmill.operators.smoothing import smoothing_forecast
from metricmill.session import stage

MIN_POINTS = 10
LONG_SERIES = 50
Z95 = 1.96


def _has_trend() -> Column:
    """The fitted rise over the whole length exceeds a tenth of the range."""
    return (F.col("data_range") > 0) & (F.abs(F.col("slope") * F.col("n")) > 0.1 * F.col("data_range"))


def _auto_method() -> Column:
    """Long series take the straight line, as do shorter ones with a trend; the others are smoothed."""
    return F.when((F.col("n") >= LONG_SERIES) | _has_trend(), "linear").otherwise("exponential_smoothing")


def select_method(series: DataFrame) -> DataFrame:
    """Per series: its length, whether it has a trend, and the automatic method."""
    fits = indexed(series).groupBy(KEY).agg(
        F.count("*").alias("n"),
        F.regr_slope("value", "idx").alias("slope"),
        (F.max("value") - F.min("value")).alias("data_range"),
    )
    return fits.select(KEY, "n", _has_trend().alias("has_trend"), _auto_method().alias("method"))


def _fit_metrics() -> list[Column]:
    """Aggregates over rows with idx, n, ts and residual ``gap``."""
    return [
        F.max("n").alias("n"),
        F.max("ts").alias("last_ts"),
        F.max(F.when(F.col("idx") == F.col("n") - 2, F.col("ts"))).alias("prev_ts"),
        F.stddev_pop("gap").alias("residual_std"),
        F.avg(F.abs("gap")).alias("mae"),
        F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("rmse"),
    ]


def _steps(fits: DataFrame, periods: int) -> DataFrame:
    """Future steps at the last interval of the series (a day when it has one point)."""
    micros = F.unix_micros("last_ts")
    interval = F.coalesce(micros - F.unix_micros("prev_ts"), F.lit(86_400_000_000))
    return fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).withColumn(
        "ts", F.timestamp_micros(micros + interval * F.col("step"))
    )


def _rows(steps: DataFrame, value: Column, method: Column, *extra: str) -> DataFrame:
    return steps.withColumn("forecast", value).select(
        KEY, "step", "ts", "forecast",
        (F.col("forecast") - Z95 * F.col("residual_std")).alias("lower_bound"),
        (F.col("forecast") + Z95 * F.col("residual_std")).alias("upper_bound"),
        method.alias("method"), "mae", "rmse", *extra,
    )


def _line_ahead() -> Column:
    return F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))


def _line_columns() -> list[Column]:
    return [F.first("slope").alias("slope"), F.first("intercept").alias("intercept")]


def linear_forecast(series: DataFrame, periods: int = 7) -> DataFrame:
    return _line_rows(with_line(series), periods)


def _line_rows(rows: DataFrame, periods: int) -> DataFrame:
    """Forecasts from rows that carry their series' line."""
    fits = rows.groupBy(KEY).agg(*_fit_metrics(), *_line_columns())
    return _rows(_steps(fits, periods), _line_ahead(), F.lit("linear_regression"))


def moving_average_forecast(series: DataFrame, periods: int = 7) -> DataFrame:
    """Flat forecast at the last average of min(7, n/2) points.

    Only series of ten or more points reach this, so the window is 5, 6 or 7.
    """
    rows = indexed(series).withColumn("w", F.least(F.lit(7), F.floor(F.col("n") / 2)).cast("int"))
    average = F.coalesce(
        *[F.when(F.col("w") == w, F.avg("value").over(in_order().rowsBetween(1 - w, 0))) for w in (5, 6, 7)]
    )
    full = rows.withColumn("ma", average).filter("idx >= w - 1").withColumn("gap", F.col("value") - F.col("ma"))
    fits = full.groupBy(KEY).agg(
        *_fit_metrics(), F.max("w").alias("w"), F.max_by("ma", "idx").alias("last_ma")
    )
    method = F.concat(F.lit("moving_average_"), F.col("w").cast("string"))
    return _rows(_steps(fits, periods), F.col("last_ma"), method)


def seasonal_linear_forecast(series: DataFrame, periods: int = 7) -> DataFrame:
    """Straight line scaled by the weekly seasonal index; adds the percentage error ``mape``.

    The seven weekday factors travel as a map on the series' row; a weekday never seen counts 1.
    """
    average = F.avg("value").over(whole())
    weekday_average = F.avg("value").over(whole().partitionBy(KEY, "weekday"))
    rows = (
        with_line(series)
        .withColumn("weekday", F.weekday("ts"))
        .withColumn("factor", F.coalesce(F.try_divide(weekday_average, F.nullif(average, F.lit(0.0))), F.lit(1.0)))
        .withColumn(
            "gap", F.col("value") - (F.col("intercept") + F.col("slope") * F.col("idx")) * F.col("factor")
        )
    )
    fits = rows.groupBy(KEY).agg(
        *_fit_metrics(),
        *_line_columns(),
        F.map_from_entries(F.collect_set(F.struct("weekday", "factor"))).alias("factors"),
        (F.avg(F.abs(F.try_divide("gap", F.nullif("value", F.lit(0.0))))) * 100).alias("mape"),
    )
    factor = F.coalesce(F.col("factors")[F.weekday("ts")], F.lit(1.0))
    return _rows(_steps(fits, periods), _line_ahead() * factor, F.lit("seasonal_linear"), "mape")


def forecast(
    series: DataFrame, periods: int = 7, method: str = "auto", strict: bool = False,
    smoothing: tuple[float, float, float] | None = None,
) -> DataFrame:
    """Forecast rows for every series of at least ten points.

    A shorter series has its steps with method ``too_short`` and no values; ``strict`` fails the
    job on it instead. An unknown method means linear. In auto mode each series goes to its own method. The
    reduced series are staged with their line and their method, so the facts are read once, and only methods that
    some series has are planned. ``smoothing`` gives the parameters of the smoothing instead of fitting them.
    """
    counted = with_line(series)
    if strict:
        short = F.raise_error(F.lit(f"need at least {MIN_POINTS} data points for forecasting"))
        counted = counted.withColumn("n", F.when(F.col("n") >= MIN_POINTS, F.col("n")).otherwise(short.cast("long")))
    reach = F.max("value").over(whole()) - F.min("value").over(whole())
    chosen = _auto_method() if method == "auto" else F.lit(method)
    chosen = F.when(F.col("n") < MIN_POINTS, "too_short").otherwise(chosen)
    tagged = stage(counted.withColumn("data_range", reach).withColumn("method", chosen).drop("data_range"))
    found = None
    for name in sorted(r[0] for r in tagged.select("method").distinct().collect()):
        rows = tagged.filter(F.col("method") == name)
        if name == "too_short":
            part = _too_short(rows, periods)
        elif name in ("moving_average", "exponential_smoothing", "seasonal_linear"):
            part = forecast_by(rows.select(KEY, "ts", "value"), periods, name, smoothing)
        else:
            part = _line_rows(rows, periods)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else _too_short(tagged, periods)


def _too_short(rows: DataFrame, periods: int) -> DataFrame:
    """The steps ahead of series that are too short to be forecast, without values."""
    fits = rows.withColumn("gap", F.lit(None).cast("double")).groupBy(KEY).agg(*_fit_metrics())
    return _rows(_steps(fits, periods), F.lit(None).cast("double"), F.lit("too_short"))


def forecast_by(
    series: DataFrame, periods: int, method: str, smoothing: tuple[float, float, float] | None = None
) -> DataFrame:
    if method == "moving_average":
        return moving_average_forecast(series, periods)
    if method == "exponential_smoothing":
        return smoothing_forecast(series, periods, parameters=smoothing)
    if method == "seasonal_linear":
        return seasonal_linear_forecast(series, periods).drop("mape")
    return linear_forecast(series, periods)


def forecast_errors(pairs: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Steps whose absolute error exceeds ``threshold`` deviations of the absolute errors.

    ``pairs`` holds (series_key, step, actual, forecast).
    """
    error = F.abs(F.col("actual") - F.col("forecast"))
    percent = F.coalesce(
        F.abs(F.try_divide(F.col("actual") - F.col("forecast"), F.nullif("forecast", F.lit(0.0)))) * 100, F.lit(0.0)
    )
    rows = pairs.withColumn("spread", F.stddev_pop(error).over(whole())).filter(
        error > threshold * F.col("spread")
    )
    p = F.col("percent_error")
    return rows.withColumn("percent_error", percent).select(
        KEY, "step", "actual", "forecast",
        (F.col("actual") - F.col("forecast")).alias("deviation"),
        "percent_error",
        F.when(p < 10, "low").when(p < 25, "medium").when(p < 50, "high").otherwise("critical").alias("severity"),
    )


def pair_by_step(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Match (series_key, step) rows of both sides; a step missing on either side fails the job."""
    both = actual.select(KEY, "step", "actual").join(predicted.select(KEY, "step", "forecast"), [KEY, "step"], "full")
    broken = F.raise_error(F.lit("actual and forecast must have the same length")).cast("double")
    return both.select(
        KEY, "step",
        *[F.when(F.col("actual").isNull() | F.col("forecast").isNull(), broken).otherwise(F.col(c)).alias(c)
          for c in ("actual", "forecast")],
    )


def forecast_revenue(
    events: DataFrame, value: str, as_of, periods: int = 7, keys: list[str] | None = None, days: float = 90,
    method: str = "auto", how: str = "avg",
) -> DataFrame:
    """Forecast of the daily averages of the last 90 days, per key."""
    recent = events.filter(in_period("event_timestamp", as_of, days))
    return forecast(rollup_series(recent, keys or [], value, "daily", how), periods, method)


def projected_totals(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy(KEY).agg(
        F.sum("forecast").alias("projected_total"),
        F.sum("lower_bound").alias("projected_lower"),
        F.sum("upper_bound").alias("projected_upper"),
        F.count("*").alias("periods"),
    )
