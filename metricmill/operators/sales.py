"""Sales questions: churn risk, upsell candidates, channel performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmill.functions.texts import UPSELL_ACTION
from metricmill.functions.timeparts import days_before, elapsed_days, in_period, instant

TS = "event_timestamp"


def churn_risk(
    sales: DataFrame, as_of, customer_id=None, days: float = 90, low_value: float = 100.0,
    keep_from: float = 0.5, *, top: int,
) -> DataFrame:
    """Customers whose purchase gap outgrows their usual interval; the ``top`` riskiest."""
    recent = sales.filter(in_period(TS, as_of, days))
    if customer_id is not None:
        recent = recent.filter(F.col("customer_id") == F.lit(customer_id))
    customers = (
        recent.groupBy("customer_id")
        .agg(
            F.count("*").alias("purchase_count"),
            F.max(TS).alias("last_purchase"),
            F.min(TS).alias("first_purchase"),
            F.avg("revenue").alias("avg_order_value"),
            F.sum("revenue").alias("total_revenue"),
        )
        .filter("purchase_count >= 2")
        .withColumn("days_since_purchase", elapsed_days(F.col("last_purchase"), instant(as_of)))
        .withColumn(
            "avg_interval_days",
            elapsed_days(F.col("first_purchase"), F.col("last_purchase")) / (F.col("purchase_count") - 1),
        )
    )
    gap, usual = F.col("days_since_purchase"), F.col("avg_interval_days")
    risk = (
        F.when(gap > usual * 2, 0.4).when(gap > usual * 1.5, 0.2).otherwise(0.0)
        + F.when(F.col("purchase_count") < 3, 0.2).otherwise(0.0)
        + F.when(F.col("avg_order_value") < low_value, 0.1).otherwise(0.0)
    )
    return (
        customers.withColumn("risk_score", risk)
        .filter(F.col("risk_score") >= keep_from)
        .select(
            "customer_id", "risk_score", "days_since_purchase", "avg_interval_days",
            "total_revenue", "purchase_count", "last_purchase",
        )
        .orderBy(F.desc("risk_score"), "customer_id")
        .limit(top)
    )


def upsell_opportunities(sales: DataFrame, as_of, limit: int, aov_cap: float = 500.0, days: float = 90) -> DataFrame:
    """Frequent buyers of small baskets; every one is scored, the ``limit`` best are returned.

    Reduced to (customer, product) first: that spreads a hot customer over all tasks
    and turns the distinct product count into a plain count.
    """
    pairs = (
        sales.filter(in_period(TS, as_of, days))
        .groupBy("customer_id", "product_id")
        .agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"))
    )
    customers = (
        pairs.groupBy("customer_id")
        .agg(
            F.sum("n").alias("purchase_count"),
            F.sum("revenue").alias("total_revenue"),
            F.count("product_id").alias("products_purchased"),
        )
        .withColumn("avg_order_value", F.col("total_revenue") / F.col("purchase_count"))
        .filter((F.col("purchase_count") >= 3) & (F.col("avg_order_value") < aov_cap))
    )
    frequency = F.least(F.col("purchase_count") / 10, F.lit(1.0))
    headroom = 1 - F.least(F.col("avg_order_value") / aov_cap, F.lit(1.0))
    return (
        customers.withColumn("opportunity_score", (frequency + headroom) / 2)
        .withColumn("suggested_action", F.lit(UPSELL_ACTION))
        .orderBy(F.desc("opportunity_score"), "customer_id")
        .limit(limit)
    )


def channel_performance(sales: DataFrame, as_of, days: float = 30) -> DataFrame:
    """Orders, revenue and order value by channel, with growth on the period before. One scan.

    Reduced to (channel, order) first, so a hot channel spreads and distinct orders are counted exactly.
    """
    now = F.col(TS) >= days_before(as_of, days)
    orders = (
        sales.filter(in_period(TS, as_of, 2 * days))
        .groupBy("channel", "purchase_id")
        .agg(
            F.sum(F.when(now, F.col("revenue"))).alias("now_revenue"),
            F.sum(F.when(~now, F.col("revenue"))).alias("then_revenue"),
        )
    )
    growth = F.try_divide(F.col("revenue") - F.col("previous_revenue"), F.nullif("previous_revenue", F.lit(0.0)))
    return (
        orders.groupBy("channel")
        .agg(
            F.count("now_revenue").alias("orders"),
            F.coalesce(F.sum("now_revenue"), F.lit(0.0)).alias("revenue"),
            F.coalesce(F.sum("then_revenue"), F.lit(0.0)).alias("previous_revenue"),
        )
        .withColumn("avg_order_value", F.try_divide("revenue", "orders"))
        .withColumn("growth_percent", growth * 100)
    )
