"""What-if scenarios over base figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmill.functions.texts import SCENARIO_NOTES


def _note(column: str, high: float, low: float, up: str, down: str) -> Column:
    value = F.col(column)
    return F.when(value > high, SCENARIO_NOTES[up]).when(value < low, SCENARIO_NOTES[down])


def what_if(scenarios: DataFrame, base: DataFrame) -> DataFrame:
    """Projected revenue, orders and customers per scenario.

    ``base`` is a one-row aggregate (revenue, orders, customers); it enters as a scalar.
    """
    figures = base.select(
        F.struct(*[F.col(c).cast("double").alias(c) for c in ("revenue", "orders", "customers")])
    ).scalar()
    marketing = F.col("marketing_spend_change") * 0.8
    volume = marketing - F.col("price_adjustment") * 0.5 + F.col("staffing_change") * 0.3
    notes = F.filter(
        F.array(
            _note("marketing_spend_change", 0.2, -0.1, "marketing_up", "marketing_down"),
            _note("price_adjustment", 0.1, -0.1, "price_up", "price_down"),
            _note("staffing_change", 0.2, -0.1, "staffing_up", "staffing_down"),
        ),
        lambda n: n.isNotNull(),
    )
    return (
        scenarios.withColumn("base", figures)
        .withColumn("marketing", marketing)
        .withColumn("volume", volume)
        .withColumn("notes", notes)
        .select(
            "scenario_id",
            (F.col("base.revenue") * (1 + F.col("volume"))).alias("projected_revenue"),
            (F.col("base.orders") * (1 + F.col("volume") * 0.9)).alias("projected_orders"),
            (F.col("base.customers") * (1 + F.col("marketing") * 0.6)).alias("projected_customers"),
            (F.col("volume") * 100).alias("revenue_percent"),
            (F.col("volume") * 90).alias("orders_percent"),
            (F.col("marketing") * 60).alias("customers_percent"),
            F.when(F.size("notes") > 0, F.col("notes"))
            .otherwise(F.array(F.lit(SCENARIO_NOTES["none"])))
            .alias("recommendations"),
        )
    )
