"""Anomaly detection on series (series_key, ts, value); one output shape for all methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmill.functions.quantiles import with_quantiles
from metricmill.functions.timeparts import pattern_slot
from metricmill.operators.series import KEY, in_order, indexed, whole

THRESHOLD = 2.5
WINDOW = 7


def severity(score: Column) -> Column:
    return F.when(score < 2, "low").when(score < 3, "medium").when(score < 4, "high").otherwise("critical")


def _context(**values: Column) -> Column:
    pairs = [c for k, v in values.items() for c in (F.lit(k), v.cast("double"))]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")


def anomaly_rows(
    rows: DataFrame, method: str, expected: Column, deviation: Column, score: Column,
    level: Column | None = None, **context: Column,
) -> DataFrame:
    return rows.select(
        KEY, "idx", "ts", "value",
        expected.cast("double").alias("expected_value"),
        deviation.cast("double").alias("deviation"),
        score.cast("double").alias("score"),
        (severity(score) if level is None else level).alias("severity"),
        F.lit(method).alias("method"),
        _context(**context).alias("context"),
    )


def _z(mean: str, spread: str) -> Column:
    return F.abs(F.try_divide(F.col("value") - F.col(mean), F.nullif(spread, F.lit(0.0))))


def z_score(series: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    rows = (
        indexed(series)
        .withColumn("mean", F.avg("value").over(whole()))
        .withColumn("spread", F.stddev_pop("value").over(whole()))
        .withColumn("z", _z("mean", "spread"))
        .filter((F.col("n") >= 4) & (F.col("z") > threshold))
    )
    return anomaly_rows(rows, "z_score", F.col("mean"), F.col("value") - F.col("mean"), F.col("z"))


def iqr(series: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    rows = with_quantiles(indexed(series), [KEY], "value", {"q1": 0.25, "q3": 0.75})
    low, high = F.col("q1"), F.col("q3")
    width = high - low
    rows = (
        rows.withColumn("lower", low - threshold * width)
        .withColumn("upper", high + threshold * width)
        .withColumn("nearest", F.when(F.col("value") < F.col("lower"), low).otherwise(high))
        .withColumn("width", width)
        .filter("n >= 4 AND width <> 0 AND (value < lower OR value > upper)")
    )
    gap = F.col("value") - F.col("nearest")
    return anomaly_rows(
        rows, "iqr", F.col("nearest"), gap, F.abs(gap) / F.col("width"),
        lower_bound=F.col("lower"), upper_bound=F.col("upper"),
    )


def moving_window(series: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """Each point against the ``window`` points before it."""
    before = in_order().rowsBetween(-window, -1)
    rows = (
        indexed(series)
        .withColumn("mean", F.avg("value").over(before))
        .withColumn("spread", F.stddev_pop("value").over(before))
        .withColumn("z", _z("mean", "spread"))
        .filter((F.col("n") >= 4) & (F.col("idx") >= window) & (F.col("z") > threshold))
    )
    return anomaly_rows(
        rows, "moving_window", F.col("mean"), F.col("value") - F.col("mean"), F.col("z"),
        window_size=F.lit(window), window_mean=F.col("mean"),
    )


def pattern(series: DataFrame, expected_pattern: str = "daily", threshold: float = THRESHOLD) -> DataFrame:
    """Points unusual for their hour, weekday or day of month; slots need 3 points, series 14."""
    slot = whole().partitionBy(KEY, "slot")
    rows = (
        indexed(series)
        .filter("n >= 14")
        .withColumn("slot", pattern_slot(F.col("ts"), expected_pattern))
        .withColumn("slot_size", F.count("*").over(slot))
        .withColumn("mean", F.avg("value").over(slot))
        .withColumn("spread", F.stddev_pop("value").over(slot))
        .withColumn("z", _z("mean", "spread"))
        .filter((F.col("slot_size") >= 3) & (F.col("z") > threshold))
    )
    return anomaly_rows(
        rows, f"pattern_{expected_pattern}", F.col("mean"), F.col("value") - F.col("mean"), F.col("z"),
        pattern_key=F.col("slot"),
    )


def density_noise(series: DataFrame, eps: float = 0.5, min_samples: int = 3) -> DataFrame:
    """Noise points of one-dimensional density clustering.

    In one dimension the neighbours of a value are a RANGE frame: a point with enough
    neighbours is a core, and noise is what has no core in reach.
    """
    near = f"OVER (PARTITION BY {KEY} ORDER BY value RANGE BETWEEN {eps}D PRECEDING AND {eps}D FOLLOWING)"
    rows = (
        indexed(series)
        .withColumn("core", F.expr(f"CAST(count(*) {near} >= {min_samples} AS INT)"))
        .withColumn("reached", F.expr(f"max(core) {near}"))
        .filter("n >= 4 AND reached = 0")
    )
    return anomaly_rows(rows, "dbscan", F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit("medium"))


def change_points(series: DataFrame, window: int = 10, threshold: float = THRESHOLD) -> DataFrame:
    """Positions where the mean of the next ``window`` points leaves that of the ``window`` before."""
    before, after = in_order().rowsBetween(-window, -1), in_order().rowsBetween(0, window - 1)
    rows = (
        indexed(series)
        .withColumn("before_mean", F.avg("value").over(before))
        .withColumn("before_std", F.stddev_pop("value").over(before))
        .withColumn("after_mean", F.avg("value").over(after))
        .withColumn("after_std", F.stddev_pop("value").over(after))
        .filter((F.col("idx") >= window) & (F.col("idx") < F.col("n") - window))
        .filter("before_std > 0 AND after_std > 0")
        .withColumn("change_magnitude", F.col("after_mean") - F.col("before_mean"))
        .withColumn("score", F.abs("change_magnitude") / F.greatest("before_std", "after_std"))
        .filter(F.col("score") > threshold)
    )
    return rows.select(
        KEY, "idx", "ts", "before_mean", "after_mean", "change_magnitude", "score",
        severity(F.col("score")).alias("severity"),
    )


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Total, by severity and by method in one pass, with average and highest score."""
    level = (
        F.when(F.grouping("severity") == 0, "severity")
        .when(F.grouping("method") == 0, "method")
        .otherwise("total")
    )
    return anomalies.groupingSets([["severity"], ["method"], []], "severity", "method").agg(
        level.alias("breakdown"),
        F.coalesce("severity", "method", F.lit("all")).alias("label"),
        F.count("*").alias("anomalies"),
        F.avg("score").alias("average_score"),
        F.max("score").alias("max_score"),
    ).drop("severity", "method")
