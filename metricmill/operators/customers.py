"""Customer questions: value, behaviour and lifecycle segments, sentiment."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmill.functions.quantiles import values_from_top
from metricmill.functions.texts import (
    BEHAVIOR_SEGMENTS,
    LIFECYCLE_SEGMENTS,
    SENTIMENT_ACTIONS,
    VALUE_SEGMENTS,
)
from metricmill.functions.timeparts import elapsed_days, in_period, instant
from metricmill.session import stage

TS = "event_timestamp"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _segment_rows(assigned: DataFrame, texts: Mapping[str, tuple[str, list[str]]], *extra: tuple[str, str]) -> DataFrame:
    """One row per declared segment, empty ones included, from one partial aggregate.

    ``extra`` names (output, column) pairs that are summed within the segment.
    """
    def member(segment: str) -> Column:
        return F.col("segment") == segment

    rows = []
    for segment, (about, actions) in texts.items():
        sums = [
            F.coalesce(F.sum(F.when(member(segment), F.col(column))), F.lit(0.0)).alias(name)
            for name, column in extra
        ]
        rows.append(
            F.struct(
                F.lit(segment).alias("segment"),
                F.count_if(member(segment)).alias("count"),
                *sums,
                F.lit(about).alias("characteristics"),
                _strings(actions).alias("recommended_actions"),
            )
        )
    return assigned.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def customer_value(customers: DataFrame, sales: DataFrame, as_of, days: float = 90) -> DataFrame:
    """Customers active in the period with their sales in it; sales are reduced before the join."""
    active = (
        customers.filter(in_period(TS, as_of[0], days)).groupBy("customer_id").agg(F.max(TS).alias("last_activity"))
    )
    bought = (
        sales.filter(in_period(TS, as_of[1], days))
        .groupBy("customer_id")
        .agg(
            F.sum("revenue").alias("total_revenue"),
            F.count("*").alias("purchase_count"),
            F.avg("revenue").alias("avg_order_value"),
        )
    )
    return active.join(bought, "customer_id", "left").na.fill(
        0, ["total_revenue", "purchase_count", "avg_order_value"]
    )


def assign_value_segments(valued: DataFrame) -> DataFrame:
    """Segment by the revenue found 20 % and 60 % down the descending order: two numbers."""
    cut = values_from_top(valued, "total_revenue", {"high": 0.2, "low": 0.6})
    return valued.withColumn(
        "segment",
        F.when(F.col("total_revenue") >= F.lit(cut.get("high")), "high_value")
        .when(F.col("total_revenue") >= F.lit(cut.get("low")), "medium_value")
        .otherwise("low_value"),
    )


def value_segments(
    customers: DataFrame, sales: DataFrame, as_of, days: float = 90
) -> DataFrame:
    """``as_of`` is a pair (customer events, sales), since the two feeds may end on different days."""
    valued = stage(customer_value(customers, sales, as_of, days))
    summary = _segment_rows(
        assign_value_segments(valued), VALUE_SEGMENTS, ("total_revenue", "total_revenue")
    )
    average = F.coalesce(F.try_divide("total_revenue", "count"), F.lit(0.0))
    return summary.withColumn("avg_revenue", average)


def behavior_segments(customers: DataFrame, as_of, days: float = 90) -> DataFrame:
    kind = F.col("event_type")
    profile = (
        customers.filter(in_period(TS, as_of, days))
        .groupBy("customer_id")
        .agg(
            F.count_if(kind == "login").alias("logins"),
            F.count_if(kind == "purchase").alias("purchases"),
            F.count_if(kind == "support").alias("tickets"),
            F.count("*").alias("total_events"),
            F.coalesce(F.avg("satisfaction_score"), F.lit(0.0)).alias("satisfaction"),
        )
        .filter("total_events >= 5")
    )
    segment = (
        F.when((F.col("purchases") >= 5) & (F.col("logins") >= 20), "power_users")
        .when((F.col("purchases") >= 1) & (F.col("logins") >= 5), "regular_users")
        .when((F.col("tickets") > 3) | (F.col("satisfaction") < 3), "at_risk")
        .otherwise("dormant")
    )
    return _segment_rows(profile.withColumn("segment", segment), BEHAVIOR_SEGMENTS)


def lifecycle_segments(activity: DataFrame, as_of, days: float = 180) -> DataFrame:
    seen = (
        activity.filter(in_period(TS, as_of, days))
        .groupBy("customer_id")
        .agg(F.min(TS).alias("first_seen"), F.max(TS).alias("last_seen"))
    )
    age = elapsed_days(F.col("first_seen"), instant(as_of))
    idle = elapsed_days(F.col("last_seen"), instant(as_of))
    segment = F.when(age <= 30, "new").when(idle > 30, "churned").when(age <= 90, "active").otherwise("mature")
    return _segment_rows(seen.withColumn("segment", segment), LIFECYCLE_SEGMENTS)


def daily_sentiment(customers: DataFrame, as_of, period: str | float = "last 30 days") -> DataFrame:
    return (
        customers.filter(in_period(TS, as_of, period) & F.col("satisfaction_score").isNotNull())
        .groupBy(F.to_date(TS).alias("date"))
        .agg(
            F.avg("satisfaction_score").alias("satisfaction"),
            F.avg("nps_score").alias("nps"),
            F.count("*").alias("response_count"),
        )
    )


def sentiment_summary(customers: DataFrame, as_of, period: str | float = "last 30 days") -> DataFrame:
    """Mean of the daily means, newest week against the week before, level and actions.

    The newest-first list holds one entry per day of the period, nothing more.
    """
    daily = daily_sentiment(customers, as_of, period)
    folded = daily.agg(
        F.avg("satisfaction").alias("overall_satisfaction"),
        F.avg("nps").alias("overall_nps"),
        F.sum("response_count").alias("total_responses"),
        F.reverse(F.array_sort(F.collect_list(F.struct("date", "satisfaction")))).alias("days"),
    ).filter("total_responses > 0")

    def mean_of(start: int) -> Column:
        part = F.slice("days", start, 7)
        total = F.aggregate(part, F.lit(0.0), lambda acc, d: acc + d["satisfaction"])
        return F.try_divide(total, F.size(part))

    recent, previous = F.col("recent_avg"), F.col("previous_avg")
    trend = (
        F.when((F.size("days") < 7) | previous.isNull(), "insufficient_data")
        .when(recent > previous + 0.2, "improving")
        .when(recent < previous - 0.2, "declining")
        .otherwise("stable")
    )
    overall = F.col("overall_satisfaction")
    level = (
        F.when(overall >= 4.5, "excellent")
        .when(overall >= 4.0, "good")
        .when(overall >= 3.5, "satisfactory")
        .when(overall >= 3.0, "poor")
        .otherwise("critical")
    )
    actions = (
        F.when(
            F.col("sentiment_level").isin("poor", "critical") | (F.col("trend") == "declining"),
            _strings(SENTIMENT_ACTIONS["recover"]),
        )
        .when(F.col("sentiment_level") == "satisfactory", _strings(SENTIMENT_ACTIONS["improve"]))
        .when(F.col("trend") == "improving", _strings(SENTIMENT_ACTIONS["reinforce"]))
        .otherwise(_strings(SENTIMENT_ACTIONS["maintain"]))
    )
    return (
        folded.withColumn("recent_avg", mean_of(1))
        .withColumn("previous_avg", mean_of(8))
        .withColumn("trend", trend)
        .withColumn("sentiment_level", level)
        .withColumn("recommended_actions", actions)
        .select(
            "overall_satisfaction", "overall_nps", "sentiment_level", "trend", "total_responses",
            "recommended_actions",
        )
    )
