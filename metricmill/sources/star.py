"""Event views over the star-schema tables.

Facts are read with an explicit schema, so timestamps are zoned to UTC and filters
on them are pushed to parquet. The views only project and join: Catalyst prunes
the columns and moves a caller's period and key filters below the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmill.session import pin_utc

TABLES = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
    "l_linestatus STRING, l_shipdate TIMESTAMP",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}.parquet")


def _net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def order_lines(spark: SparkSession, root: str) -> DataFrame:
    lines, orders = table(spark, root, "lineitem"), table(spark, root, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def sales_events(spark: SparkSession, root: str) -> DataFrame:
    return sales_of(order_lines(spark, root))


def sales_of(lines: DataFrame) -> DataFrame:
    """Sale events of order lines joined with their orders."""
    return lines.select(
        F.col("o_orderdate").alias("event_timestamp"),
        F.col("o_orderkey").alias("purchase_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        _net().alias("revenue"),
        F.col("l_quantity").alias("quantity"),
        F.col("o_orderpriority").alias("channel"),
    )


def operations_events(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part")
    joined = order_lines(spark, root).join(part, F.col("l_partkey") == part.p_partkey)
    return joined.select(
        F.col("l_shipdate").alias("event_timestamp"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("warehouse_id"),
        F.col("p_size").alias("inventory_level"),
        (24.0 * F.abs(F.datediff("l_shipdate", "o_orderdate"))).alias("fulfillment_time_hours"),
    )


def customer_events(spark: SparkSession, root: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "view", "login")
        .when(F.col("event_type") == "purchase", "purchase")
        .when(F.col("event_type") == "error", "support")
        .otherwise("review")
    )
    return table(spark, root, "events").select(
        F.col("ts").alias("event_timestamp"),
        F.col("user_id").alias("customer_id"),
        kind.alias("event_type"),
        F.when(k % 10 >= 3, 1 + k % 5).alias("satisfaction_score"),
        F.when(k % 2 != 0, k % 11).alias("nps_score"),
    )


def revenue_events(spark: SparkSession, root: str) -> DataFrame:
    return revenue_of(order_lines(spark, root))


def revenue_of(lines: DataFrame) -> DataFrame:
    """Revenue events of order lines joined with their orders."""
    kind = (
        F.when(F.col("l_returnflag") == "N", "recurring")
        .when(F.col("l_returnflag") == "A", "expansion")
        .when(F.col("l_linestatus") == "O", "one_time")
        .otherwise("churn")
    )
    churn = F.col("revenue_type") == "churn"
    return (
        lines
        .select(
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("event_timestamp"),
            kind.alias("revenue_type"),
            _net().alias("net"),
        )
        .select(
            "customer_id",
            "event_timestamp",
            "revenue_type",
            F.when(churn, -F.col("net")).otherwise(F.col("net")).alias("amount"),
            F.when(~churn, 12 * F.col("net")).alias("arr"),
        )
    )


VIEWS = {
    "sales_events": sales_events,
    "operations_events": operations_events,
    "customer_events": customer_events,
    "revenue_events": revenue_events,
}
