"""Metrics, trends, period comparisons and KPI shapes over event frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmill.functions.quantiles import BIN, COUNT, HIGH, LOW, exact_quantiles, histogram
from metricmill.functions.timeparts import bucket_start, days_before, in_period, instant

TS = "event_timestamp"
AGGREGATES = {
    "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
    "stddev": F.stddev_samp,
}


def aggregate(name: str, column: str | Column) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {name}")
    return AGGREGATES[name](column)


def recent_events(events: DataFrame, as_of, limit: int, hours: float = 24, tie: Sequence[str] = ()) -> DataFrame:
    """Newest events of the last hours. The limit is the size of the feed."""
    window = events.filter(in_period(TS, as_of, hours / 24))
    return window.orderBy(F.desc(TS), *tie).limit(limit)


def daily_metrics(
    events: DataFrame,
    metrics: Mapping[str, tuple[str, str]],
    as_of,
    period: str | float = "last 30 days",
    group_by: Sequence[str] = (),
) -> DataFrame:
    """One row per day (and group). ``metrics`` maps an output name to (column, aggregate)."""
    return (
        events.filter(in_period(TS, as_of, period))
        .groupBy(F.to_date(TS).alias("date"), *group_by)
        .agg(*[aggregate(how, column).alias(name) for name, (column, how) in metrics.items()])
        .orderBy(F.desc("date"), *group_by)
    )


def trends(events: DataFrame, metric: str, as_of, period: str = "daily", days: float = 30) -> DataFrame:
    return (
        events.filter(in_period(TS, as_of, days))
        .groupBy(bucket_start(F.col(TS), period).alias("period"))
        .agg(
            F.avg(metric).alias("avg_value"),
            F.min(metric).alias("min_value"),
            F.max(metric).alias("max_value"),
            F.count("*").alias("count"),
            F.stddev_samp(metric).alias("std_dev"),
        )
        .orderBy(F.desc("period"))
    )


def metric_anomalies(
    daily: DataFrame,
    value: str,
    as_of,
    threshold: float = 2.5,
    days: float = 7,
    baseline_days: float = 90,
    date: str = "date",
) -> DataFrame:
    """z-score of recent days against the mean and sample deviation of the baseline period.

    ``daily`` is a metric table: one row a day, so the baseline is a few dozen rows and
    one ungrouped window over them is cheaper than reading the facts twice. A missing or
    zero deviation gives no rows.
    """
    stamp = F.col(date).cast("timestamp")
    everything = Window.partitionBy()
    scored = (
        daily.filter(in_period(stamp, as_of, baseline_days))
        .withColumn("mean", F.avg(value).over(everything))
        .withColumn("stddev", F.stddev_samp(value).over(everything))
        .withColumn("z_score", F.try_divide(F.col(value) - F.col("mean"), F.nullif("stddev", F.lit(0.0))))
    )
    return (
        scored.filter(in_period(stamp, as_of, days) & (F.abs("z_score") > threshold))
        .withColumn("abs_z_score", F.abs("z_score"))
        .orderBy(F.desc("abs_z_score"), date)
    )


def compare_periods(
    events: DataFrame, metrics: Sequence[str], as_of, current_days: float = 7, previous_days: float = 7,
    how: str = "avg",
) -> DataFrame:
    """Two adjacent periods in one scan; each period has a row even when it has no events."""
    cut = days_before(as_of, current_days)
    label = F.when(F.col(TS) >= cut, "current").otherwise("previous")
    both = events.filter(in_period(TS, as_of, current_days + previous_days))
    wide = both.agg(
        *[
            aggregate(how, F.when(label == p, F.col(m))).alias(f"{p}_{m}")
            for p in ("current", "previous")
            for m in metrics
        ]
    )
    rows = F.array(
        *[
            F.struct(*[F.col(f"{p}_{m}").alias(m) for m in metrics], F.lit(p).alias("period"))
            for p in ("current", "previous")
        ]
    )
    return wide.select(F.inline(rows))


def kpi_delta(
    events: DataFrame, metrics: Mapping[str, tuple[str, str]], as_of, current_days: float = 7,
    previous_days: float = 7,
) -> DataFrame:
    """Per metric: current and previous value, absolute and percent change, trend."""
    cut = days_before(as_of, current_days)
    both = events.filter(in_period(TS, as_of, current_days + previous_days))
    current = F.col(TS) >= cut
    wide = both.agg(
        *[aggregate(h, F.when(current, F.col(c))).alias(f"{m}_now") for m, (c, h) in metrics.items()],
        *[aggregate(h, F.when(~current, F.col(c))).alias(f"{m}_then") for m, (c, h) in metrics.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"{m}_now").cast("double").alias("current_value"),
                F.col(f"{m}_then").cast("double").alias("previous_value"),
            )
            for m in metrics
        ]
    )
    change = F.col("current_value") - F.col("previous_value")
    percent = F.try_divide(change, F.nullif("previous_value", F.lit(0.0))) * 100
    return (
        wide.select(F.inline(rows))
        .withColumn("absolute_change", change)
        .withColumn("percent_change", percent)
        .withColumn("trend", F.when(F.col("percent_change") > 0, "up").otherwise("down"))
    )


def metric_card(series: DataFrame) -> DataFrame:
    """Latest, average, minimum and maximum of each series."""
    return series.groupBy("series_key").agg(
        F.max_by("value", "ts").alias("latest"),
        F.avg("value").alias("average"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def column_summary(df: DataFrame) -> DataFrame:
    """Row count, and min / max / mean / median / deviation of every numeric column.

    One pass counts every column's values in bins with their moments, from which all but the medians follow;
    a second one reads the few values around each median.
    """
    names = numeric_columns(df)
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names]))
    )
    held = histogram(long, ["column"], "v", moments=True)
    full = F.col(BIN).isNotNull()
    sums = held.groupBy("column").agg(
        F.sum(COUNT).alias("row_count"), F.coalesce(F.sum(F.when(full, F.col(COUNT))), F.lit(0)).alias("non_null"),
        F.min(LOW).alias("min"), F.max(HIGH).alias("max"), F.sum("total").alias("total"),
    ).withColumn("mean", F.try_divide("total", "non_null"))
    off = F.col("total") / F.col(COUNT) - F.col("mean")
    square = held.join(sums.select("column", "mean"), "column").groupBy("column").agg(
        F.sum(F.when(full, F.col("square") + F.col(COUNT) * off * off)).alias("square")
    )
    deviation = F.when(F.col("non_null") > 1, F.sqrt(F.col("square") / (F.col("non_null") - 1))).when(F.col("non_null") == 1, 0.0)
    moments = sums.join(square, "column").select("column", "row_count", "non_null", "min", "max", "mean", deviation.alias("std"))
    medians = exact_quantiles(long, ["column"], "v", {"median": 0.5}, held)
    empty = df.sparkSession.createDataFrame([(c,) for c in names], "column string")  # a frame without rows has its columns too
    found = empty.join(moments, "column", "left").join(medians, "column", "left")
    return found.fillna(0, ["row_count", "non_null"])


def analytics_query(
    events: DataFrame,
    metric: str,
    as_of,
    period: str | float = "last 30 days",
    group_by: Sequence[str] = (),
    filters: Mapping[str, object] | None = None,
    aggregations: Sequence[str] = ("avg", "min", "max", "count"),
    limit: int | None = None,
) -> DataFrame:
    """Generic request: filter, group, aggregate; all groups, or the first ``limit`` in key order."""
    selected = events.filter(in_period(TS, as_of, period))
    for name, wanted in (filters or {}).items():
        column = F.col(name)
        selected = selected.filter(
            column.isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else column == F.lit(wanted)
        )
    result = selected.groupBy(*group_by).agg(*[aggregate(a, metric).alias(a) for a in aggregations])
    return result.orderBy(*group_by).limit(limit) if group_by and limit is not None else result


def ingestion_stats(events: DataFrame, as_of, kind: str = "event_type", valid: Column | None = None) -> DataFrame:
    """Totals per event type with the share of valid rows; the caller adds no second scan."""
    ok = valid if valid is not None else F.lit(True)
    today = F.to_date(TS) == F.to_date(instant(as_of))
    return events.groupBy(kind).agg(
        F.count("*").alias("total_events"),
        F.count_if(today).alias("events_today"),
        (F.count_if(ok) / F.count("*") * 100).alias("valid_rate"),
        F.max(TS).alias("last_event"),
    )


def rollup_series(events: DataFrame, keys: Sequence[str | Column], value: str | Column, grain: str, how: str = "sum",
                  label: str = "all") -> DataFrame:
    """Reduce facts to series (series_key, ts, value) at an hourly .. monthly grain.

    Every series operator works on this form. The reduction combines map-side, so a hot
    key arrives as at most one row per calendar slot, and a series is bounded by time.
    """
    key = F.concat_ws("|", *keys) if keys else F.lit(label)
    return (
        events.groupBy(key.alias("series_key"), bucket_start(F.col(TS), grain).alias("ts"))
        .agg(aggregate(how, value).cast("double").alias("value"))
        .filter(F.col("value").isNotNull())
    )
