"""Statistics of many time series at once.

Input is (series_key, ts, value) as made by ``rollup_series``: at most one row per
calendar slot, so a series is bounded by its history however hot its key was in the
facts. Windows are partitioned by series; parallelism comes from the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmill.functions.quantiles import exact_quantiles, mode_of, with_quantiles
from metricmill.functions.tdist import t_two_sided
from metricmill.functions.timeparts import seasonal_slot

KEY = "series_key"


def whole() -> Window:
    return Window.partitionBy(KEY)


def in_order() -> Window:
    return Window.partitionBy(KEY).orderBy("ts")


def indexed(series: DataFrame) -> DataFrame:
    """Adds the 0-based position ``idx`` and the length ``n`` of the series."""
    return series.withColumn("idx", F.row_number().over(in_order()) - 1).withColumn(
        "n", F.count("*").over(whole())
    )


def moving_average(series: DataFrame, window: int = 7) -> DataFrame:
    """Averages of full windows; a series shorter than the window gives one overall mean."""
    frame = in_order().rowsBetween(-(window - 1), 0)
    rows = indexed(series).withColumn("moving_average", F.avg("value").over(frame))
    full = (F.col("idx") >= window - 1) | ((F.col("n") < window) & (F.col("idx") == F.col("n") - 1))
    return rows.filter(full).select(KEY, "ts", "moving_average")


def growth_rate(series: DataFrame, periods: int = 1) -> DataFrame:
    """Percent change on ``periods`` back, else first to last, else 0 for a single point."""
    def at(position: Column) -> Column:
        return F.max(F.when(F.col("idx") == position, F.col("value")))

    ends = indexed(series).groupBy(KEY).agg(
        F.max("n").alias("n"),
        at(F.col("n") - 1).alias("last"),
        at(F.col("n") - 1 - periods).alias("before"),
        at(F.lit(0)).alias("first"),
    )
    base = F.when(F.col("n") >= periods + 1, F.col("before")).otherwise(F.col("first"))
    change = F.try_divide(F.col("last") - base, F.nullif(base, F.lit(0.0))) * 100
    return ends.select(
        KEY,
        F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(change, F.lit(0.0))).alias("growth_rate"),
        F.when(F.col("n") < 2, "insufficient_data")
        .when(F.col("n") >= periods + 1, "period_over_period")
        .otherwise("full_period")
        .alias("method"),
    )


def trend(series: DataFrame) -> DataFrame:
    """Least-squares direction and strength; fewer than 3 points are unknown."""
    fits = indexed(series).groupBy(KEY).agg(
        F.count("*").alias("n"),
        F.regr_slope("value", "idx").alias("slope"),
        F.when(F.var_pop("value") > 0, F.regr_r2("value", "idx")).otherwise(0.0).alias("r_squared"),
        F.avg(F.abs("value")).alias("size"),
    )
    enough = F.col("n") >= 3
    direction = (
        F.when(~enough, "unknown")
        .when(F.abs("slope") < 0.01 * F.col("size"), "stable")
        .when(F.col("slope") > 0, "increasing")
        .otherwise("decreasing")
    )
    return fits.select(
        KEY,
        direction.alias("trend"),
        F.when(enough, F.col("slope")).alias("slope"),
        F.when(enough, F.col("r_squared")).alias("r_squared"),
        F.when(enough, F.least(F.abs("r_squared") * 100, F.lit(100.0))).otherwise(0.0).alias("strength"),
        F.when(enough, F.least(F.abs("r_squared") + 0.5, F.lit(1.0))).otherwise(0.0).alias("confidence"),
    )


def mark_outliers(series: DataFrame, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Adds a flag ``outlier``; fewer than 4 points, or no spread for z-scores, flag nothing."""
    rows = indexed(series)
    if method == "iqr":
        rows = with_quantiles(rows, [KEY], "value", {"q1": 0.25, "q3": 0.75})
        low, high = F.col("q1"), F.col("q3")
        reach = threshold * (high - low)
        flag = (F.col("value") < low - reach) | (F.col("value") > high + reach)
    elif method == "zscore":
        mean, spread = F.avg("value").over(whole()), F.stddev_pop("value").over(whole())
        rows = rows.withColumn("q", F.abs(F.try_divide(F.col("value") - mean, F.nullif(spread, F.lit(0.0)))))
        flag = F.coalesce(F.col("q") > threshold, F.lit(False))
    else:
        raise ValueError(f"unknown outlier method: {method}")
    return rows.withColumn("outlier", (F.col("n") >= 4) & flag).drop("q", "q1", "q3")


def outlier_summary(series: DataFrame, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    marked = mark_outliers(series, method, threshold)
    return marked.groupBy(KEY).agg(
        F.count_if("outlier").alias("count"),
        (F.count_if("outlier") / F.count("*") * 100).alias("percentage"),
        F.min(F.when(F.col("outlier"), F.col("idx"))).alias("first_index"),
        F.max(F.when(F.col("outlier"), F.col("idx"))).alias("last_index"),
    )


def compare_to_baseline(series: DataFrame, current: Column) -> DataFrame:
    """Equal-variance two-sample t-test of the rows marked current against the others.

    One aggregate per series; the tail probability is taken on the aggregated rows.
    """
    now, then = F.when(current, F.col("value")), F.when(~current, F.col("value"))
    sides = series.groupBy(KEY).agg(
        F.avg(now).alias("current_average"),
        F.avg(then).alias("baseline_average"),
        F.count(now).alias("n1"),
        F.count(then).alias("n2"),
        F.coalesce(F.var_samp(now), F.lit(0.0)).alias("v1"),
        F.coalesce(F.var_samp(then), F.lit(0.0)).alias("v2"),
    ).filter("n1 > 0 AND n2 > 0")
    change = F.col("current_average") - F.col("baseline_average")
    freedom = F.col("n1") + F.col("n2") - 2
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), freedom)
    error = F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    t = (
        F.when(error > 0, change / error)
        .when(change > 0, float("inf"))
        .when(change < 0, float("-inf"))
    )
    size = F.abs("percent_change")
    text = F.concat_ws(
        " ",
        F.when(size < 5, "minimal").when(size < 15, "moderate").when(size < 30, "significant")
        .otherwise("substantial"),
        F.when(F.col("percent_change") > 0, "increase").otherwise("decrease"),
    )
    return (
        sides.withColumn("absolute_change", change)
        .withColumn(
            "percent_change",
            F.coalesce(F.try_divide(change, F.nullif("baseline_average", F.lit(0.0))) * 100, F.lit(0.0)),
        )
        .withColumn("t_statistic", F.when(freedom > 0, t))
        .withColumn("p_value", t_two_sided(F.col("t_statistic"), freedom.cast("double")))
        .withColumn("is_significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
        .withColumn(
            "interpretation", F.when(F.col("p_value") >= 0.05, "not statistically significant").otherwise(text)
        )
        .drop("n1", "n2", "v1", "v2")
    )


def seasonal_index(series: DataFrame, pattern: str = "weekly") -> DataFrame:
    """Mean per calendar slot against the overall mean, in percent; needs 14 points."""
    rows = (
        series.withColumn("n", F.count("*").over(whole()))
        .withColumn("overall_average", F.avg("value").over(whole()))
        .filter("n >= 14")
        .withColumn("period", seasonal_slot(F.col("ts"), pattern))
    )
    slots = rows.groupBy(KEY, "period").agg(
        F.avg("value").alias("average_value"),
        F.count("*").alias("sample_count"),
        F.first("overall_average").alias("overall_average"),
    )
    ratio = F.try_divide("average_value", F.nullif("overall_average", F.lit(0.0)))
    return slots.withColumn("seasonal_index", (ratio - 1) * 100)


def correlation(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Pearson r per series with its two-sided p, strength and direction; needs 2 pairs."""
    sums = (
        pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(KEY)
        .agg(F.count("*").alias("n"), F.corr(x, y).alias("correlation_coefficient"))
        .filter("n >= 2")
    )
    r, freedom = F.col("correlation_coefficient"), F.col("n") - 2
    rest = 1 - r * r
    t = F.when(rest > 0, r * F.sqrt(F.greatest(freedom, F.lit(0)) / rest)).when(r.isNotNull(), float("inf"))
    size = F.abs(r)
    return (
        sums.withColumn("p_value", t_two_sided(t, freedom.cast("double")))
        .withColumn("is_significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
        .withColumn(
            "strength",
            F.when(size < 0.1, "negligible").when(size < 0.3, "weak").when(size < 0.5, "moderate")
            .when(size < 0.7, "strong").otherwise("very strong"),
        )
        .withColumn("direction", F.when(r > 0, "positive").otherwise("negative"))
    )


def summary_stats(series: DataFrame, integers: bool = False) -> DataFrame:
    """Moments, quartiles and shape of each series; the mode is given for integers only."""
    stats = series.groupBy(KEY).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.var_pop("value").alias("variance"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.skewness("value").alias("skewness"),
    )
    parts = [exact_quantiles(series, [KEY], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})]
    if integers:
        parts.append(mode_of(series, [KEY], F.col("value").cast("bigint"), "mode"))
    for part in parts:
        named = part.withColumnRenamed(KEY, "of_key")
        stats = stats.join(named, F.col(KEY).eqNullSafe(F.col("of_key")), "left").drop("of_key")
    mode = F.col("mode") if integers else F.lit(None)
    return stats.select(
        KEY, "count", "mean", "median", mode.cast("double").alias("mode"), "std", "variance", "min", "max",
        (F.col("max") - F.col("min")).alias("range"),
        "q1",
        "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        "skewness",
        F.coalesce(F.try_divide("std", F.nullif("mean", F.lit(0.0))), F.lit(0.0)).alias("coefficient_of_variation"),
    )


def with_line(series: DataFrame) -> DataFrame:
    """Indexed rows carrying their series' least-squares line and the residual ``gap``.

    All of it is windowed by series, so one shuffle serves the index, the fit and what follows.
    """
    return (
        indexed(series)
        .withColumn("slope", F.regr_slope("value", "idx").over(whole()))
        .withColumn("intercept", F.regr_intercept("value", "idx").over(whole()))
        .withColumn("gap", F.col("value") - (F.col("intercept") + F.col("slope") * F.col("idx")))
    )


def simple_forecast(series: DataFrame, periods: int = 7) -> DataFrame:
    """Straight-line forecast with bounds of 1.96 population residual deviations; needs 2 points."""
    fits = with_line(series).filter("n >= 2").groupBy(KEY).agg(
        F.max("n").alias("n"),
        F.first("slope").alias("slope"),
        F.first("intercept").alias("intercept"),
        F.stddev_pop("gap").alias("residual_std"),
    )
    steps = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    value = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    return steps.select(
        KEY,
        "step",
        value.alias("forecast"),
        (value - 1.96 * F.col("residual_std")).alias("lower_bound"),
        (value + 1.96 * F.col("residual_std")).alias("upper_bound"),
        F.col("slope").alias("trend_slope"),
    )
