"""Registry of runnable queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmill.session import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The feeds derived from orders end on 1 August 2001, the event feed on 30 January 2024.
SALES_AS_OF = "2001-08-02"
EVENTS_AS_OF = "2024-01-31"


def portable(df: DataFrame) -> DataFrame:
    """Dates, times and text lists as strings, so both engines print results alike."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, "; ")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, oracle: str | None = None):
    """Register a query; without SQL the result is checked by row count and by unit tests."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, root: portable(run(prepared(spark), root))
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


# SQL form of the event views.
VIEWS_SQL = {
    "sales_events": """
        SELECT o_orderdate AS event_timestamp, o_orderkey AS purchase_id, o_custkey AS customer_id,
               l_partkey AS product_id, l_extendedprice * (1 - l_discount) AS revenue,
               l_quantity AS quantity, o_orderpriority AS channel
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "operations_events": """
        SELECT l_shipdate AS event_timestamp, l_partkey AS product_id, l_suppkey AS warehouse_id,
               p_size AS inventory_level,
               24.0::DOUBLE * abs(date_diff('day', o_orderdate, l_shipdate)) AS fulfillment_time_hours
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "customer_events": """
        SELECT ts AS event_timestamp, user_id AS customer_id,
               CASE event_type WHEN 'view' THEN 'login' WHEN 'purchase' THEN 'purchase'
                    WHEN 'error' THEN 'support' ELSE 'review' END AS event_type,
               CASE WHEN k % 10 >= 3 THEN 1 + k % 5 END AS satisfaction_score,
               CASE WHEN k % 2 <> 0 THEN k % 11 END AS nps_score
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "revenue_events": """
        SELECT customer_id, event_timestamp, revenue_type,
               CASE WHEN revenue_type = 'churn' THEN -net ELSE net END AS amount,
               CASE WHEN revenue_type <> 'churn' THEN 12 * net END AS arr
        FROM (SELECT o_custkey AS customer_id, o_orderdate AS event_timestamp,
                     CASE WHEN l_returnflag = 'N' THEN 'recurring' WHEN l_returnflag = 'A' THEN 'expansion'
                          WHEN l_linestatus = 'O' THEN 'one_time' ELSE 'churn' END AS revenue_type,
                     l_extendedprice * (1 - l_discount) AS net
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}


def over(body: str, *views: str, **ctes: str) -> str:
    """SQL with the named event views, then further CTEs in order, then the body."""
    parts = [f"{v} AS ({VIEWS_SQL[v]})" for v in views]
    parts += [f"{name} AS ({sql})" for name, sql in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def within(days: float, as_of: str = SALES_AS_OF, ts: str = "event_timestamp") -> str:
    seconds = round(days * 86400)
    return (
        f"{ts} >= TIMESTAMP '{as_of}' - INTERVAL {seconds} SECOND AND {ts} < TIMESTAMP '{as_of}'"
    )


def texts_case(column: str, texts: dict[str, list[str]]) -> str:
    """CASE that maps a label to its joined action texts."""
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    whens = " ".join(f"WHEN {quote(k)} THEN {quote('; '.join(v))}" for k, v in texts.items())
    return f"CASE {column} {whens} END"
