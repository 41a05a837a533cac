"""Order analytics and the conversion of orders to ingestion events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_items(orders: DataFrame) -> DataFrame:
    """One row per ordered item; the nested array is flattened, never built."""
    return orders.select("order_id", F.inline("items"))


def order_totals(orders: DataFrame) -> DataFrame:
    """Completed revenue, order count and completed revenue per order of any status."""
    done = F.when(F.col("order_status") == "completed", F.col("total_idr"))
    return orders.agg(
        F.coalesce(F.sum(done), F.lit(0)).alias("total_revenue_idr"),
        F.count("*").alias("total_orders"),
    ).withColumn(
        "average_order_value", F.coalesce(F.try_divide("total_revenue_idr", "total_orders"), F.lit(0.0))
    )


def channel_distribution(orders: DataFrame) -> DataFrame:
    return orders.groupBy("channel").agg(F.count("*").alias("orders"))


def peak_hours(orders: DataFrame, top: int) -> DataFrame:
    by_hour = orders.groupBy(F.hour("order_timestamp").alias("hour")).agg(F.count("*").alias("orders"))
    return by_hour.orderBy(F.desc("orders"), "hour").limit(top)


def popular_items(items: DataFrame, top: int) -> DataFrame:
    counts = items.groupBy("name").agg(F.sum("quantity").alias("quantity"))
    return counts.orderBy(F.desc("quantity"), "name").limit(top)


def orders_to_events(orders: DataFrame) -> DataFrame:
    """One sale event per order, plus a customer event for a hash-chosen 3 in 10 of them.

    ``items`` travels as it is nested in the source; a source without it omits the field.
    """
    payload = [
        c
        for c in ("order_id", "customer_id", "store_id", "channel", "order_type", "total_idr", "items", "payment_method")
        if c in orders.columns
    ]
    sale = orders.select(
        F.concat(F.lit("evt_order_"), "order_id").alias("event_id"),
        F.lit("sale").alias("event_type"),
        F.lit("sales").alias("domain"),
        F.col("order_timestamp").alias("event_timestamp"),
        F.to_json(F.struct(*payload)).alias("data"),
    )
    digest = F.md5("order_id")
    chosen = F.conv(F.substring(digest, 1, 7), 16, 10).cast("int") % 10 < 3
    draw = F.conv(F.substring(digest, 8, 7), 16, 10).cast("int") % 50
    # Of the sampled orders a fifth gives no score; the others are 60 : 40 for 4 and 5.
    score = F.when(draw < 10, F.lit(None)).when(draw < 34, 4).otherwise(5)
    kind = F.when(F.col("order_status") == "completed", "purchase").otherwise("support")
    visit = orders.filter(chosen).select(
        F.concat(F.lit("evt_cust_"), "order_id").alias("event_id"),
        F.lit("customer").alias("event_type"),
        F.lit("customer").alias("domain"),
        F.col("order_timestamp").alias("event_timestamp"),
        F.to_json(
            F.struct("customer_id", kind.alias("event_type"), score.cast("int").alias("satisfaction_score"))
        ).alias("data"),
    )
    return sale.unionByName(visit)
