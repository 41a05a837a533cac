"""Revenue questions: streams and concentration, pricing headroom, net retention, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmill.functions.texts import PRICING_REASON, RETENTION_ACTIONS
from metricmill.functions.timeparts import in_period, instant
from metricmill.operators.metrics import metric_anomalies

TS = "event_timestamp"


def revenue_streams(revenue: DataFrame, as_of, period: str | float = "last 30 days") -> DataFrame:
    """Figures and share per revenue type. The share window runs over one row per type."""
    total = F.sum("total_revenue").over(Window.partitionBy())
    share = F.when(total > 0, F.col("total_revenue") / total * 100).otherwise(0.0)
    return (
        revenue.filter(in_period(TS, as_of, period))
        .groupBy("revenue_type")
        .agg(
            F.sum("amount").alias("total_revenue"),
            F.count("*").alias("transaction_count"),
            F.avg("amount").alias("avg_transaction_value"),
            F.min("amount").alias("min_transaction"),
            F.max("amount").alias("max_transaction"),
            F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("stddev_transaction"),
        )
        .withColumn("percentage", share)
        .withColumn(
            "concentration_risk",
            F.when(F.col("percentage") > 40, "high").when(F.col("percentage") > 20, "medium").otherwise("low"),
        )
    )


def revenue_concentration(streams: DataFrame) -> DataFrame:
    """Herfindahl index over unrounded shares, its level and the diversification score."""
    hhi = F.col("hhi")
    return (
        streams.agg(
            F.sum("total_revenue").alias("total_revenue"),
            F.count("*").alias("stream_count"),
            F.sum(F.col("percentage") * F.col("percentage")).alias("hhi"),
        )
        .filter("stream_count > 0")
        .withColumn("concentration_level", F.when(hhi > 2500, "high").when(hhi > 1500, "medium").otherwise("low"))
        .withColumn("diversification_score", F.greatest(F.lit(0.0), 100 - hhi / 30))
    )


def price_points(sales: DataFrame, as_of, product_id=None, days: float = 90) -> DataFrame:
    """Quantity, revenue and distinct customers per product and effective price.

    Reduced to (product, price, customer) first, which keeps a hot product spread out.
    """
    recent = sales.filter(in_period(TS, as_of, days) & (F.col("quantity") > 0))
    if product_id is not None:
        recent = recent.filter(F.col("product_id") == F.lit(product_id))
    by_customer = (
        recent.withColumn("effective_price", F.col("revenue") / F.col("quantity"))
        .groupBy("product_id", "effective_price", "customer_id")
        .agg(F.sum("quantity").alias("q"), F.sum("revenue").alias("r"))
    )
    return by_customer.groupBy("product_id", "effective_price").agg(
        F.sum("q").alias("total_quantity"),
        F.sum("r").alias("total_revenue"),
        F.count("customer_id").alias("unique_customers"),
    )


def pricing_opportunities(sales: DataFrame, as_of, product_id=None, days: float = 90) -> DataFrame:
    """Products whose sold quantity varies less than half as much as their price."""
    recent = sales.filter(in_period(TS, as_of, days) & (F.col("quantity") > 0))
    if product_id is not None:
        recent = recent.filter(F.col("product_id") == F.lit(product_id))
    points = recent.groupBy("product_id", (F.col("revenue") / F.col("quantity")).alias("price")).agg(
        F.sum("quantity").alias("quantity")
    )
    mean_quantity = F.when(F.avg("quantity") > 0, F.avg("quantity")).otherwise(1.0)
    return (
        points.groupBy("product_id")
        .agg(
            F.count("*").alias("price_points"),
            F.avg("price").alias("current_avg_price"),
            (F.max("price") - F.min("price")).alias("price_range"),
            (F.stddev_pop("quantity") / mean_quantity).alias("quantity_cv"),
        )
        .filter("price_points >= 2 AND price_range > 0")
        .filter("quantity_cv < 0.5 * (price_range / current_avg_price)")
        .select(
            "product_id",
            F.lit("pricing_increase").alias("opportunity"),
            "current_avg_price",
            F.lit(10).alias("potential_increase_percent"),
            F.lit(PRICING_REASON).alias("reason"),
            (1 - F.col("quantity_cv")).alias("confidence"),
        )
    )


def net_revenue_retention(revenue: DataFrame, as_of, cohort_months: int = 12) -> DataFrame:
    """Retention of customers that have recurring revenue, with level and actions."""
    kind, amount = F.col("revenue_type"), F.col("amount")

    def of(name: str, value: Column) -> Column:
        return F.sum(F.when(kind == name, value).otherwise(0.0))

    start = F.add_months(F.to_date(instant(as_of)), -cohort_months).cast("timestamp")
    customers = (
        revenue.filter((F.col(TS) >= start) & (F.col(TS) < instant(as_of)))
        .groupBy("customer_id")
        .agg(
            of("recurring", amount).alias("recurring"),
            of("expansion", amount).alias("expansion"),
            of("churn", F.abs(amount)).alias("churn"),
        )
        .filter("recurring > 0")
    )
    nrr = F.col("net_revenue_retention")
    level = (
        F.when(nrr >= 125, "excellent")
        .when(nrr >= 110, "good")
        .when(nrr >= 100, "healthy")
        .when(nrr >= 90, "concerning")
        .otherwise("critical")
    )
    actions = F.create_map(
        *[c for k, v in RETENTION_ACTIONS.items() for c in (F.lit(k), F.array(*[F.lit(a) for a in v]))]
    )
    return (
        customers.agg(
            F.sum("recurring").alias("starting_revenue"),
            F.sum("expansion").alias("expansion_revenue"),
            F.sum("churn").alias("churn_revenue"),
            F.count("*").alias("customer_count"),
        )
        .filter("starting_revenue > 0")
        .withColumn("ending_revenue", F.expr("starting_revenue + expansion_revenue - churn_revenue"))
        .withColumn("net_revenue_retention", F.col("ending_revenue") / F.col("starting_revenue") * 100)
        .withColumn("nrr_level", level)
        .withColumn("recommended_actions", actions[F.col("nrr_level")])
    )


def revenue_anomalies(daily: DataFrame, value: str, as_of, threshold: float = 2.5, days: float = 30) -> DataFrame:
    size = F.col("abs_z_score")
    return metric_anomalies(daily, value, as_of, threshold, days).select(
        "date",
        F.col(value).alias("value"),
        "mean",
        "z_score",
        (F.col(value) - F.col("mean")).alias("deviation"),
        F.when(size > 4, "critical").when(size > 3, "high").when(size > 2, "medium").otherwise("low").alias("severity"),
    )
