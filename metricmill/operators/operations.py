"""Operations questions: stockouts, inventory levels, disruptions, bottlenecks."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricmill.functions.quantiles import BIN, COUNT, exact_quantiles, histogram
from metricmill.functions.texts import BOTTLENECK_ACTION, DISRUPTION_ACTION, REORDER
from metricmill.functions.timeparts import in_period, instant

TS = "event_timestamp"


def stockout_risk(
    operations: DataFrame, sales: DataFrame, as_of, product_id=None, days_ahead: float = 7,
) -> DataFrame:
    """Days of stock left at the 30-day sales rate; both sides are reduced per product before the join."""
    stock = operations.filter(in_period(TS, as_of, 7))
    sold = sales.filter(in_period(TS, as_of, 30))
    if product_id is not None:
        stock = stock.filter(F.col("product_id") == F.lit(product_id))
        sold = sold.filter(F.col("product_id") == F.lit(product_id))
    stock = stock.groupBy("product_id").agg(F.avg("inventory_level").alias("current_stock"))
    sold = sold.groupBy("product_id").agg((F.sum("quantity") / 30).alias("daily_sales_rate"))
    left = F.col("days_until_stockout")
    return (
        stock.join(sold, "product_id")
        .filter("daily_sales_rate > 0")
        .withColumn("days_until_stockout", F.col("current_stock") / F.col("daily_sales_rate"))
        .filter(left <= days_ahead)
        .withColumn("risk_score", F.greatest(F.lit(0.0), 1 - left / days_ahead))
        .withColumn("urgency", F.when(left < 3, "high").otherwise("medium"))
        .withColumn(
            "suggested_action", F.format_string(REORDER, left.cast("int"))
        )
        .orderBy(F.desc("risk_score"), "product_id")
    )


def inventory_levels(
    sales: DataFrame, as_of, service_level: float = 0.95, lead_time_days: float = 7,
    order_cost: float = 50.0, holding_cost: float = 2.0, days: float = 90,
) -> DataFrame:
    """Safety stock Z*sd*sqrt(lead), reorder point and economic order quantity sqrt(2DS/H) per product.

    Demand moments are over the days on which the product sold; D is a year of average demand.
    """
    z = NormalDist().inv_cdf(service_level)
    daily = (
        sales.filter(in_period(TS, as_of, days))
        .groupBy("product_id", F.to_date(TS).alias("date"))
        .agg(F.sum("quantity").alias("daily_demand"))
    )
    return (
        daily.groupBy("product_id")
        .agg(
            F.avg("daily_demand").alias("avg_daily_demand"),
            F.coalesce(F.stddev_samp("daily_demand"), F.lit(0.0)).alias("demand_stddev"),
        )
        .withColumn("safety_stock", F.lit(z) * F.col("demand_stddev") * F.sqrt(F.lit(float(lead_time_days))))
        .withColumn("reorder_point", F.col("avg_daily_demand") * lead_time_days + F.col("safety_stock"))
        .withColumn(
            "economic_order_quantity",
            F.sqrt(2 * F.col("avg_daily_demand") * 365 * order_cost / F.lit(float(holding_cost))),
        )
        .withColumn("service_level", F.lit(float(service_level)))
    )


def supply_disruptions(operations: DataFrame, as_of, threshold_hours: float = 48) -> DataFrame:
    """Recent warehouse-days slower than the warehouse's own baseline (days -30 to -7).

    After the daily reduction a warehouse has at most 31 rows, so its baseline is a
    window over them: one scan and no self-join.
    """
    today = F.to_date(instant(as_of))
    daily = (
        operations.filter(in_period(TS, as_of, 30))
        .groupBy("warehouse_id", F.to_date(TS).alias("date"))
        .agg(F.avg("fulfillment_time_hours").alias("current_fulfillment_time"))
    )
    per_warehouse = Window.partitionBy("warehouse_id")
    base = F.when(
        (F.col("date") >= F.date_sub(today, 30)) & (F.col("date") < F.date_sub(today, 7)),
        F.col("current_fulfillment_time"),
    )
    z = F.col("z_score")
    return (
        daily.withColumn("baseline_fulfillment_time", F.avg(base).over(per_warehouse))
        .withColumn("time_stddev", F.stddev_samp(base).over(per_warehouse))
        .withColumn("increase_hours", F.col("current_fulfillment_time") - F.col("baseline_fulfillment_time"))
        .filter((F.col("date") >= F.date_sub(today, 7)) & (F.col("increase_hours") > threshold_hours))
        .withColumn("z_score", F.try_divide("increase_hours", F.nullif("time_stddev", F.lit(0.0))))
        .withColumn(
            "severity", F.when(z > 3, "critical").when(z > 2, "high").when(z > 1, "medium").otherwise("low")
        )
        .withColumn("suggested_action", F.lit(DISRUPTION_ACTION))
        .drop("time_stddev")
        .orderBy(F.desc_nulls_last("z_score"), "warehouse_id", "date")
    )


def bottlenecks(
    operations: DataFrame, as_of, days: float = 30, min_orders: int = 10,
) -> DataFrame:
    """Warehouses whose average exceeds the mean of averages by a population deviation.

    Averages and quantiles come from one count of the period by warehouse and bin; the period is read again
    only for bins that hold a wanted rank among different values.
    """
    recent = operations.filter(in_period(TS, as_of, days))
    held = histogram(recent, ["warehouse_id"], "fulfillment_time_hours", moments=True)
    given = F.sum(F.when(F.col(BIN).isNotNull(), F.col(COUNT)))
    averages = (
        held.groupBy("warehouse_id")
        .agg(F.try_divide(F.sum("total"), given).alias("avg_fulfillment_time"), F.sum(COUNT).alias("order_count"))
        .filter(F.col("order_count") >= min_orders)
    )
    spread = averages.select(
        F.struct(
            (F.avg("avg_fulfillment_time") + F.stddev_pop("avg_fulfillment_time")).alias("limit"),
            F.max("avg_fulfillment_time").alias("slowest"),
        )
    ).scalar()
    flagged = averages.filter(F.col("avg_fulfillment_time") > spread["limit"]).withColumn(
        "percent_of_slowest", F.col("avg_fulfillment_time") / spread["slowest"] * 100
    )
    # Only flagged warehouses need their quantiles; the one without an id may be among them.
    slow = flagged.select(F.col("warehouse_id").alias("slow_id"))
    quantiles = exact_quantiles(
        recent, ["warehouse_id"], "fulfillment_time_hours", {"median_time": 0.5, "p95_time": 0.95},
        held.join(slow, F.col("warehouse_id").eqNullSafe(F.col("slow_id")), "left_semi"),
    ).withColumnRenamed("warehouse_id", "slow_id")
    return (
        flagged.join(quantiles, F.col("warehouse_id").eqNullSafe(F.col("slow_id"))).drop("slow_id")
        .withColumn("suggested_action", F.lit(BOTTLENECK_ACTION))
        .orderBy(F.desc("avg_fulfillment_time"), "warehouse_id")
    )
