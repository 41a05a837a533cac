"""Order lines laid out by event date: written once, read by period without a shuffle.

Orders and lines are written as two tables that are partitioned by the period in which the order was
placed and bucketed by order key, equally many buckets each. A read for a period names its partitions on
both sides, so no other file is listed, and joins bucket with bucket, so nothing is exchanged. The join that
gives every line its order's date happens once, when the tables are written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmill.functions.timeparts import days_before, in_period, instant, period_days

PERIOD = "order_period"
GRAINS = {"day": "day", "month": "month"}


# Lines that a task sorts and a bucket holds over all periods.
PER_BUCKET = 2_000_000


def buckets_for(lines: DataFrame, least: int = 8) -> int:
    """How many buckets keep the tasks that write and join them of one size, whatever the table's."""
    return max(least, math.ceil(lines.count() / PER_BUCKET))


def _placed(grain: str) -> Column:
    return F.to_date(F.date_trunc(GRAINS[grain], "o_orderdate")).alias(PERIOD)


def write_order_lines(
    orders: DataFrame, lines: DataFrame, name: str, path: str, buckets: int = 256, grain: str = "day"
) -> None:
    """Write the tables ``<name>_orders`` and ``<name>_lines`` below ``path``, in place of what they held.

    A bucket of a period should fill a file, so ``buckets`` and ``grain`` (``day`` or ``month``) follow the volume, as
    ``buckets_for`` does: a task sorts the lines of a bucket.
    Lines without an order and orders without lines are left out, as in the join; orders without a date
    have a partition of their own, which no period reads.
    """
    dated = orders.select("*", _placed(grain))
    keyed = {
        "orders": (dated, "o_orderkey"),
        "lines": (lines.join(dated.select("o_orderkey", PERIOD), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"), "l_orderkey"),
    }
    for kind, (rows, key) in keyed.items():
        # Dealt by the buckets' own hash, a task writes one file for each period.
        writer = rows.repartition(buckets, key).write.mode("overwrite").partitionBy(PERIOD).bucketBy(buckets, key).sortBy(key)
        writer.option("path", f"{path}/{kind}").saveAsTable(f"{name}_{kind}")


def order_lines(spark: SparkSession, name: str, as_of, period: str | float, grain: str = "day") -> DataFrame:
    """Lines joined with their orders, of orders placed in the period; columns as in ``star.order_lines``."""
    first = F.to_date(F.date_trunc(GRAINS[grain], days_before(as_of, period_days(period))))
    days = F.col(PERIOD).between(first, F.to_date(instant(as_of)))
    orders = spark.table(f"{name}_orders").filter(days & in_period("o_orderdate", as_of, period)).drop(PERIOD)
    lines = spark.table(f"{name}_lines").filter(days).drop(PERIOD)
    return lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
