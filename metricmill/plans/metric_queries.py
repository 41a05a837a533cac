"""Metrics, trends, comparisons and request shapes over the event views."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricmill.functions.timeparts import in_period
from metricmill.operators import metrics as m
from metricmill.plans.catalog import EVENTS_AS_OF, SALES_AS_OF, over, query, within
from metricmill.sources import star
from metricmill.sources.registry import domain_events, register

TREND_BODY = """
SELECT strftime({bucket}, '%Y-%m-%d %H:%M:%S') AS period, avg({metric}) AS avg_value,
       min({metric}) AS min_value, max({metric}) AS max_value, count(*) AS count,
       stddev_samp({metric}) AS std_dev
FROM {view} WHERE {where} GROUP BY 1"""


def trend_sql(view: str, metric: str, bucket: str, days: float, as_of: str) -> str:
    return over(TREND_BODY.format(bucket=bucket, metric=metric, view=view, where=within(days, as_of)), view)


@query(
    "sales_daily_revenue_trend",
    trend_sql("sales_events", "revenue", "date_trunc('day', event_timestamp)", 90, SALES_AS_OF),
)
def sales_daily_revenue_trend(spark, root):
    return m.trends(star.sales_events(spark, root), "revenue", SALES_AS_OF, "daily", 90)


@query(
    "customer_hourly_satisfaction_trend",
    trend_sql("customer_events", "satisfaction_score", "date_trunc('hour', event_timestamp)", 30, EVENTS_AS_OF),
)
def customer_hourly_satisfaction_trend(spark, root):
    return m.trends(star.customer_events(spark, root), "satisfaction_score", EVENTS_AS_OF, "hourly", 30)


@query(
    "operations_weekly_fulfillment_trend",
    trend_sql(
        "operations_events", "fulfillment_time_hours",
        "date_trunc('week', event_timestamp + INTERVAL 1 DAY) - INTERVAL 1 DAY", 180, SALES_AS_OF,
    ),
)
def operations_weekly_fulfillment_trend(spark, root):
    return m.trends(star.operations_events(spark, root), "fulfillment_time_hours", SALES_AS_OF, "weekly", 180)


@query(
    "revenue_monthly_amount_trend",
    trend_sql("revenue_events", "amount", "date_trunc('month', event_timestamp)", 365, SALES_AS_OF),
)
def revenue_monthly_amount_trend(spark, root):
    return m.trends(star.revenue_events(spark, root), "amount", SALES_AS_OF, "monthly", 365)


@query(
    "recent_customer_events",
    over(
        f"""SELECT strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') AS event_timestamp, customer_id, event_type,
                   satisfaction_score, nps_score
            FROM customer_events WHERE {within(1, EVENTS_AS_OF)}
            ORDER BY customer_events.event_timestamp DESC, customer_id LIMIT 1000""",
        "customer_events",
    ),
)
def recent_customer_events(spark, root):
    register({"customer_events": star.customer_events(spark, root)})
    return m.recent_events(domain_events(spark, "customer"), EVENTS_AS_OF, 1000, 24, ["customer_id"])


@query(
    "sales_metrics_by_channel",
    over(
        f"""SELECT strftime(event_timestamp, '%Y-%m-%d') AS date, channel, sum(revenue) AS total_revenue,
                   avg(revenue) AS avg_revenue, count(*) AS line_count
            FROM sales_events WHERE {within(30)} GROUP BY 1, 2""",
        "sales_events",
    ),
)
def sales_metrics_by_channel(spark, root):
    wanted = {
        "total_revenue": ("revenue", "sum"), "avg_revenue": ("revenue", "avg"), "line_count": ("revenue", "count"),
    }
    return m.daily_metrics(star.sales_events(spark, root), wanted, SALES_AS_OF, "last 30 days", ["channel"])


@query(
    "product_daily_units",
    over(
        f"""SELECT strftime(event_timestamp, '%Y-%m-%d') AS date, product_id, sum(quantity) AS units
            FROM sales_events WHERE {within(365)} AND quantity > 0 GROUP BY 1, 2""",
        "sales_events",
    ),
)
def product_daily_units(spark, root):
    positive = star.sales_events(spark, root).filter("quantity > 0")
    return m.daily_metrics(positive, {"units": ("quantity", "sum")}, SALES_AS_OF, 365, ["product_id"])


DAILY_REVENUE = f"""SELECT CAST(event_timestamp AS DATE) AS date, sum(amount) AS total
                    FROM revenue_events WHERE {within(90)} GROUP BY 1"""
DAILY_STATS = """SELECT *, avg(total) OVER () AS mean, stddev_samp(total) OVER () AS sd FROM daily"""


def daily_revenue(spark, root):
    return m.daily_metrics(star.revenue_events(spark, root), {"total": ("amount", "sum")}, SALES_AS_OF, 90)


@query(
    "daily_metric_anomalies",
    over(
        f"""SELECT strftime(date, '%Y-%m-%d') AS date, total, mean, sd AS stddev, (total - mean) / sd AS z_score,
                   abs((total - mean) / sd) AS abs_z_score
            FROM scored WHERE {within(90, ts='date')} AND abs((total - mean) / sd) > 2.0""",
        "revenue_events", daily=DAILY_REVENUE, scored=DAILY_STATS,
    ),
)
def daily_metric_anomalies(spark, root):
    return m.metric_anomalies(daily_revenue(spark, root), "total", SALES_AS_OF, threshold=2.0, days=90)


@query(
    "compare_sales_periods",
    over(
        f"""SELECT avg(revenue) AS revenue, avg(quantity) AS quantity, 'current' AS period
            FROM sales_events WHERE {within(7)}
            UNION ALL
            SELECT avg(revenue), avg(quantity), 'previous' FROM sales_events
            WHERE event_timestamp >= TIMESTAMP '2001-07-19' AND event_timestamp < TIMESTAMP '2001-07-26'""",
        "sales_events",
    ),
)
def compare_sales_periods(spark, root):
    return m.compare_periods(star.sales_events(spark, root), ["revenue", "quantity"], SALES_AS_OF, 7, 7)


@query(
    "sales_kpi_delta",
    over(
        """SELECT metric, current_value, previous_value, current_value - previous_value AS absolute_change,
                  (current_value - previous_value) / previous_value * 100 AS percent_change,
                  CASE WHEN (current_value - previous_value) / previous_value > 0 THEN 'up' ELSE 'down' END AS trend
           FROM (
             SELECT 'total_revenue' AS metric, sum(revenue) FILTER (now) AS current_value,
                    sum(revenue) FILTER (NOT now) AS previous_value FROM p
             UNION ALL
             SELECT 'avg_quantity', avg(quantity) FILTER (now), avg(quantity) FILTER (NOT now) FROM p
             UNION ALL
             SELECT 'lines', (count(*) FILTER (now))::DOUBLE, (count(*) FILTER (NOT now))::DOUBLE FROM p)""",
        "sales_events",
        p=f"SELECT *, event_timestamp >= TIMESTAMP '2001-07-03' AS now FROM sales_events WHERE {within(60)}",
    ),
)
def sales_kpi_delta(spark, root):
    wanted = {
        "total_revenue": ("revenue", "sum"), "avg_quantity": ("quantity", "avg"), "lines": ("revenue", "count"),
    }
    return m.kpi_delta(star.sales_events(spark, root), wanted, SALES_AS_OF, 30, 30)


DAILY_CHANNEL = f"""SELECT channel AS series_key, event_timestamp AS ts, sum(revenue) AS value
                    FROM sales_events WHERE {within(365)} GROUP BY 1, 2"""


def channel_series(spark, root, days=365):
    sales = star.sales_events(spark, root)
    if days is not None:
        sales = sales.filter(in_period("event_timestamp", SALES_AS_OF, days))
    return m.rollup_series(sales, ["channel"], "revenue", "daily", "sum")


@query(
    "channel_metric_cards",
    over(
        """SELECT series_key, arg_max(value, ts) AS latest, avg(value) AS average, min(value) AS minimum,
                  max(value) AS maximum FROM s GROUP BY 1""",
        "sales_events", s=DAILY_CHANNEL,
    ),
)
def channel_metric_cards(spark, root):
    return m.metric_card(channel_series(spark, root))


@query(
    "sales_column_summary",
    over(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) AS row_count, count({c}) AS non_null, min({c})::DOUBLE AS min,
                       max({c})::DOUBLE AS max, avg({c}) AS mean, stddev_samp({c}) AS std,
                       quantile_cont({c}::DOUBLE, 0.5) AS median FROM sales_events"""
            for c in ("purchase_id", "customer_id", "product_id", "revenue", "quantity")
        ),
        "sales_events",
    ),
)
def sales_column_summary(spark, root):
    return m.column_summary(star.sales_events(spark, root))


@query(
    "analytics_request",
    over(
        f"""SELECT channel, avg(revenue) AS avg, min(revenue) AS min, max(revenue) AS max, count(revenue) AS count
            FROM sales_events WHERE {within(90)} AND channel IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1
            """,
        "sales_events",
    ),
)
def analytics_request(spark, root):
    return m.analytics_query(
        star.sales_events(spark, root), "revenue", SALES_AS_OF, "last 90 days", ["channel"],
        {"channel": ["1-URGENT", "2-HIGH", "5-LOW"]},
    )


@query(
    "event_ingestion_stats",
    over(
        """SELECT event_type, count(*) AS total_events,
                  count(*) FILTER (CAST(event_timestamp AS DATE) = DATE '2024-01-30') AS events_today,
                  count(*) FILTER (valid) / count(*) * 100 AS valid_rate,
                  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event
           FROM (SELECT CASE WHEN broken THEN 'system' WHEN unknown THEN 'signal' ELSE 'customer' END AS event_type,
                        NOT broken AND NOT unknown AND (s IS NULL OR s BETWEEN 1 AND 5) AND (p IS NULL OR p <= 10) AS valid,
                        CASE WHEN broken OR unknown THEN TIMESTAMP '2024-01-31' ELSE ts END AS ts
                 FROM (SELECT ts, k, k = 99 AS broken, k % 17 = 0 AS unknown,
                              CASE WHEN k % 10 >= 3 THEN k % 7 END AS s, CASE WHEN k % 2 <> 0 THEN k % 13 END AS p
                       FROM (SELECT ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))
           GROUP BY 1""".replace("CAST(event_timestamp AS DATE)", "CAST(ts AS DATE)"),
    ),
)
def event_ingestion_stats(spark, root):
    """Totals by type with the share that validation accepts."""
    from metricmill.plans.ingest_queries import checked_customers

    return m.ingestion_stats(checked_customers(spark, root), "2024-01-30", valid=F.size("errors") == 0)

