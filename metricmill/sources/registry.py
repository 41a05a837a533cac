"""Table registry and ad-hoc SQL over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metricmill.sources.results import cached

# ---- fixed values: names of the event, metric and result tables ----------------
RAW_EVENTS = "raw_events"
EVENT_TABLES = {
    "sales": "sales_events",
    "operations": "operations_events",
    "customer": "customer_events",
    "revenue": "revenue_events",
}
METRIC_TABLES = {
    "sales": "metrics_sales",
    "operations": "metrics_operations",
    "customer": "metrics_customers",
    "revenue": "metrics_revenue",
}
RECOMMENDATIONS = "recommendations"
# ---- end of fixed values -------------------------------------------------------

SPELLINGS = {"sale": "sales", "operation": "operations", "customers": "customer"}


def domain_name(domain: str) -> str:
    return SPELLINGS.get(domain, domain)


def event_table(domain: str) -> str:
    """Event table of a domain; an unknown domain falls back to the raw events."""
    return EVENT_TABLES.get(domain_name(domain), RAW_EVENTS)


def metric_table(domain: str) -> str:
    """Metric table of a domain, else its event table, else the raw events."""
    return METRIC_TABLES.get(domain_name(domain), event_table(domain))


def register(frames: dict[str, DataFrame]) -> None:
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def domain_events(spark: SparkSession, domain: str) -> DataFrame:
    return spark.table(event_table(domain))


def query(
    spark: SparkSession, sql: str, args: dict | None = None, keep: bool = False, results_root: str | None = None
) -> DataFrame:
    """Run SQL with bound parameters. ``keep`` persists the result; the caller unpersists it.

    With ``results_root`` the result is kept there for the same question over the same files (``results.cached``).
    """
    result = spark.sql(sql, args=args or {})
    if results_root:
        return cached(result, results_root)
    return result.persist() if keep else result
