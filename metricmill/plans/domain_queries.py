"""Domain questions over the event views."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricmill.functions import texts
from metricmill.functions.scalars import rupiah
from metricmill.operators import customers, operations, orders, revenue, sales
from metricmill.plans.catalog import EVENTS_AS_OF, SALES_AS_OF, over, query, texts_case, within
from metricmill.plans.metric_queries import DAILY_REVENUE, DAILY_STATS, daily_revenue
from metricmill.sources import star

Q = {
    name: value.replace("'", "''")
    for name, value in vars(texts).items()
    if name.isupper() and isinstance(value, str)
}


@query(
    "churn_risk",
    over(
        """SELECT customer_id, risk_score, days_since_purchase, avg_interval_days, total_revenue, purchase_count,
                  strftime(last_purchase, '%Y-%m-%d %H:%M:%S') AS last_purchase
           FROM (SELECT *, CASE WHEN days_since_purchase > avg_interval_days * 2 THEN 0.4::DOUBLE
                                WHEN days_since_purchase > avg_interval_days * 1.5 THEN 0.2::DOUBLE
                                ELSE 0.0::DOUBLE END
                         + CASE WHEN purchase_count < 3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
                         + CASE WHEN avg_order_value < 100 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS risk_score
                 FROM c)
           WHERE risk_score >= 0.5 ORDER BY risk_score DESC, customer_id LIMIT 10""",
        "sales_events",
        c=f"""SELECT customer_id, count(*) AS purchase_count, max(event_timestamp) AS last_purchase,
                     avg(revenue) AS avg_order_value, sum(revenue) AS total_revenue,
                     CAST(floor(epoch(TIMESTAMP '{SALES_AS_OF}' - max(event_timestamp)) / 86400) AS INTEGER)
                       AS days_since_purchase,
                     CAST(floor(epoch(max(event_timestamp) - min(event_timestamp)) / 86400) AS INTEGER)
                       / (count(*) - 1) AS avg_interval_days
              FROM sales_events WHERE {within(90)} GROUP BY 1 HAVING count(*) >= 2""",
    ),
)
def churn_risk(spark, root):
    return sales.churn_risk(star.sales_events(spark, root), SALES_AS_OF, top=10)


@query(
    "upsell_opportunities",
    over(
        f"""SELECT customer_id, purchase_count, total_revenue, products_purchased, avg_order_value,
                  (least(purchase_count / 10, 1.0) + (1 - least(avg_order_value / 60000, 1.0))) / 2
                    AS opportunity_score,
                  '{Q["UPSELL_ACTION"]}' AS suggested_action
           FROM c ORDER BY opportunity_score DESC, customer_id LIMIT 20""",
        "sales_events",
        c=f"""SELECT customer_id, count(*) AS purchase_count, sum(revenue) AS total_revenue,
                     count(DISTINCT product_id) AS products_purchased, sum(revenue) / count(*) AS avg_order_value
              FROM sales_events WHERE {within(90)} GROUP BY 1
              HAVING count(*) >= 3 AND sum(revenue) / count(*) < 60000""",
    ),
)
def upsell_opportunities(spark, root):
    return sales.upsell_opportunities(star.sales_events(spark, root), SALES_AS_OF, 20, aov_cap=60000.0)


@query(
    "channel_performance",
    over(
        """SELECT channel, count(now_revenue) AS orders, coalesce(sum(now_revenue), 0) AS revenue,
                  coalesce(sum(then_revenue), 0) AS previous_revenue,
                  sum(now_revenue) / count(now_revenue) AS avg_order_value,
                  (sum(now_revenue) - sum(then_revenue)) / sum(then_revenue) * 100 AS growth_percent
           FROM o GROUP BY 1""",
        "sales_events",
        o=f"""SELECT channel, purchase_id,
                     sum(revenue) FILTER (event_timestamp >= TIMESTAMP '2001-07-03') AS now_revenue,
                     sum(revenue) FILTER (event_timestamp < TIMESTAMP '2001-07-03') AS then_revenue
              FROM sales_events WHERE {within(60)} GROUP BY 1, 2""",
    ),
)
def channel_performance(spark, root):
    return sales.channel_performance(star.sales_events(spark, root), SALES_AS_OF, 30)


@query(
    "stockout_risk",
    over(
        """SELECT product_id, current_stock, daily_sales_rate, d AS days_until_stockout,
                  greatest(0.0, 1 - d / 7) AS risk_score, CASE WHEN d < 3 THEN 'high' ELSE 'medium' END AS urgency,
                  'Reorder within ' || CAST(trunc(d) AS INTEGER)::VARCHAR || ' days' AS suggested_action
           FROM (SELECT product_id, current_stock, daily_sales_rate, current_stock / daily_sales_rate AS d
                 FROM stock JOIN sold USING (product_id) WHERE daily_sales_rate > 0) WHERE d <= 7""",
        "sales_events", "operations_events",
        stock=f"""SELECT product_id, avg(inventory_level) AS current_stock FROM operations_events
                  WHERE {within(7)} GROUP BY 1""",
        sold=f"""SELECT product_id, sum(quantity) / 30 AS daily_sales_rate FROM sales_events
                 WHERE {within(30)} GROUP BY 1""",
    ),
)
def stockout_risk(spark, root):
    return operations.stockout_risk(
        star.operations_events(spark, root), star.sales_events(spark, root), SALES_AS_OF
    )


@query(
    "inventory_levels",
    over(
        """SELECT *, avg_daily_demand * 7 + safety_stock AS reorder_point,
                  sqrt(2 * avg_daily_demand * 365 * 50 / 2) AS economic_order_quantity,
                  0.95::DOUBLE AS service_level
           FROM (SELECT product_id, avg(d) AS avg_daily_demand, coalesce(stddev_samp(d), 0) AS demand_stddev,
                        1.6448536269514715::DOUBLE * coalesce(stddev_samp(d), 0) * sqrt(7) AS safety_stock
                 FROM daily GROUP BY 1)""",
        "sales_events",
        daily=f"""SELECT product_id, CAST(event_timestamp AS DATE) AS day, sum(quantity) AS d
                  FROM sales_events WHERE {within(90)} GROUP BY 1, 2""",
    ),
)
def inventory_levels(spark, root):
    return operations.inventory_levels(star.sales_events(spark, root), SALES_AS_OF)


@query(
    "supply_disruptions",
    over(
        f"""SELECT warehouse_id, strftime(date, '%Y-%m-%d') AS date, a AS current_fulfillment_time,
                  base AS baseline_fulfillment_time, a - base AS increase_hours, z AS z_score,
                  CASE WHEN z > 3 THEN 'critical' WHEN z > 2 THEN 'high' WHEN z > 1 THEN 'medium' ELSE 'low' END
                    AS severity,
                  '{Q["DISRUPTION_ACTION"]}' AS suggested_action
           FROM (SELECT f.*, base, (a - base) / nullif(sd, 0) AS z FROM f JOIN b USING (warehouse_id)
                 WHERE date >= DATE '2001-07-26' AND a - base > 48)""",
        "operations_events",
        f=f"""SELECT warehouse_id, CAST(event_timestamp AS DATE) AS date, avg(fulfillment_time_hours) AS a
              FROM operations_events WHERE {within(30)} GROUP BY 1, 2""",
        b="""SELECT warehouse_id, avg(a) AS base, stddev_samp(a) AS sd FROM f
             WHERE date >= DATE '2001-07-03' AND date < DATE '2001-07-26' GROUP BY 1""",
    ),
)
def supply_disruptions(spark, root):
    return operations.supply_disruptions(star.operations_events(spark, root), SALES_AS_OF)


@query(
    "bottlenecks",
    over(
        f"""SELECT warehouse_id, a AS avg_fulfillment_time, n AS order_count, a / mx * 100 AS percent_of_slowest,
                  p50 AS median_time, p95 AS p95_time, '{Q["BOTTLENECK_ACTION"]}' AS suggested_action
           FROM (SELECT *, avg(a) OVER () + stddev_pop(a) OVER () AS lim, max(a) OVER () AS mx FROM w)
           WHERE a > lim""",
        "operations_events",
        w=f"""SELECT warehouse_id, avg(fulfillment_time_hours) AS a, count(*) AS n,
                     quantile_cont(fulfillment_time_hours, 0.5) AS p50,
                     quantile_cont(fulfillment_time_hours, 0.95) AS p95
              FROM operations_events WHERE {within(30)} GROUP BY 1 HAVING count(*) >= 10""",
    ),
)
def bottlenecks(spark, root):
    return operations.bottlenecks(star.operations_events(spark, root), SALES_AS_OF)


def segment_sql(table: dict, assigned: str, extra: str = "", outer: str = "") -> str:
    def quote(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    names = ", ".join(f"({quote(k)}, {quote(v[0])}, {quote('; '.join(v[1]))})" for k, v in table.items())
    return f"""SELECT t.segment, count(a.segment) AS count, {extra} t.characteristics, t.recommended_actions {outer}
               FROM (VALUES {names}) t(segment, characteristics, recommended_actions)
               LEFT JOIN {assigned} a ON a.segment = t.segment GROUP BY 1, t.characteristics, t.recommended_actions"""


def value_sql(days: int) -> str:
    return over(
        segment_sql(
            texts.VALUE_SEGMENTS, "assigned", "coalesce(sum(total_revenue), 0) AS total_revenue,",
            ", coalesce(sum(total_revenue) / count(a.segment), 0) AS avg_revenue",
        ),
        "sales_events", "customer_events",
        active=f"""SELECT DISTINCT customer_id FROM customer_events WHERE {within(days, EVENTS_AS_OF)}""",
        bought=f"SELECT customer_id, sum(revenue) AS r FROM sales_events WHERE {within(days)} GROUP BY 1",
        valued="""SELECT customer_id, coalesce(r, 0) AS total_revenue FROM active LEFT JOIN bought
                  USING (customer_id)""",
        ranked="SELECT total_revenue AS v, row_number() OVER (ORDER BY total_revenue DESC) - 1 AS i FROM valued",
        cut="""SELECT max(v) FILTER (i = floor(n * 0.2)) AS high, max(v) FILTER (i = floor(n * 0.6)) AS low
               FROM ranked, (SELECT count(*) AS n FROM valued)""",
        assigned="""SELECT total_revenue, CASE WHEN total_revenue >= high THEN 'high_value'
                           WHEN total_revenue >= low THEN 'medium_value' ELSE 'low_value' END AS segment
                    FROM valued, cut""",
    )


@query("value_segments", value_sql(90))
def value_segments(spark, root):
    return customers.value_segments(
        star.customer_events(spark, root), star.sales_events(spark, root), (EVENTS_AS_OF, SALES_AS_OF)
    )


@query("value_segments_one_year", value_sql(365))
def value_segments_one_year(spark, root):
    return customers.value_segments(
        star.customer_events(spark, root), star.sales_events(spark, root), (EVENTS_AS_OF, SALES_AS_OF), days=365
    )


@query(
    "behavior_segments",
    over(
        segment_sql(texts.BEHAVIOR_SEGMENTS, "assigned"),
        "customer_events",
        profile=f"""SELECT customer_id, count(*) FILTER (event_type = 'login') AS l,
                           count(*) FILTER (event_type = 'purchase') AS p,
                           count(*) FILTER (event_type = 'support') AS t,
                           coalesce(avg(satisfaction_score), 0) AS s
                    FROM customer_events WHERE {within(90, EVENTS_AS_OF)} GROUP BY 1 HAVING count(*) >= 5""",
        assigned="""SELECT CASE WHEN p >= 5 AND l >= 20 THEN 'power_users' WHEN p >= 1 AND l >= 5
                           THEN 'regular_users' WHEN t > 3 OR s < 3 THEN 'at_risk' ELSE 'dormant' END AS segment
                    FROM profile""",
    ),
)
def behavior_segments(spark, root):
    return customers.behavior_segments(star.customer_events(spark, root), EVENTS_AS_OF)


@query(
    "lifecycle_segments",
    over(
        segment_sql(texts.LIFECYCLE_SEGMENTS, "assigned"),
        "sales_events",
        seen=f"""SELECT customer_id,
                        floor(epoch(TIMESTAMP '{SALES_AS_OF}' - min(event_timestamp)) / 86400) AS age,
                        floor(epoch(TIMESTAMP '{SALES_AS_OF}' - max(event_timestamp)) / 86400) AS idle
                 FROM sales_events WHERE {within(180)} GROUP BY 1""",
        assigned="""SELECT CASE WHEN age <= 30 THEN 'new' WHEN idle > 30 THEN 'churned'
                           WHEN age <= 90 THEN 'active' ELSE 'mature' END AS segment FROM seen""",
    ),
)
def lifecycle_segments(spark, root):
    return customers.lifecycle_segments(star.sales_events(spark, root), SALES_AS_OF)


SENTIMENT_DAILY = f"""SELECT CAST(event_timestamp AS DATE) AS date, avg(satisfaction_score) AS satisfaction,
                             avg(nps_score) AS nps, count(*) AS response_count
                      FROM customer_events
                      WHERE {within(30, EVENTS_AS_OF)} AND satisfaction_score IS NOT NULL GROUP BY 1"""


@query(
    "daily_sentiment",
    over(
        "SELECT strftime(date, '%Y-%m-%d') AS date, satisfaction, nps, response_count FROM d",
        "customer_events", d=SENTIMENT_DAILY,
    ),
)
def daily_sentiment(spark, root):
    return customers.daily_sentiment(star.customer_events(spark, root), EVENTS_AS_OF)


@query(
    "sentiment_summary",
    over(
        f"""SELECT overall_satisfaction, overall_nps, sentiment_level, trend, total_responses,
                   {texts_case("CASE WHEN sentiment_level IN ('poor', 'critical') OR trend = 'declining' THEN 'recover' WHEN sentiment_level = 'satisfactory' THEN 'improve' WHEN trend = 'improving' THEN 'reinforce' ELSE 'maintain' END", texts.SENTIMENT_ACTIONS)}
                     AS recommended_actions
            FROM (SELECT overall_satisfaction, overall_nps, total_responses,
                         CASE WHEN overall_satisfaction >= 4.5 THEN 'excellent'
                              WHEN overall_satisfaction >= 4.0 THEN 'good'
                              WHEN overall_satisfaction >= 3.5 THEN 'satisfactory'
                              WHEN overall_satisfaction >= 3.0 THEN 'poor' ELSE 'critical' END AS sentiment_level,
                         CASE WHEN n < 7 OR previous IS NULL THEN 'insufficient_data'
                              WHEN recent > previous + 0.2 THEN 'improving'
                              WHEN recent < previous - 0.2 THEN 'declining' ELSE 'stable' END AS trend
                  FROM folded)""",
        "customer_events",
        d=SENTIMENT_DAILY,
        r="SELECT *, row_number() OVER (ORDER BY date DESC) AS i FROM d",
        folded="""SELECT avg(satisfaction) AS overall_satisfaction, avg(nps) AS overall_nps,
                         CAST(sum(response_count) AS BIGINT) AS total_responses, count(*) AS n,
                         avg(satisfaction) FILTER (i <= 7) AS recent,
                         avg(satisfaction) FILTER (i BETWEEN 8 AND 14) AS previous FROM r""",
    ),
)
def sentiment_summary(spark, root):
    return customers.sentiment_summary(star.customer_events(spark, root), EVENTS_AS_OF)


STREAMS = f"""SELECT *, total_revenue / sum(total_revenue) OVER () * 100 AS percentage
              FROM (SELECT revenue_type, sum(amount) AS total_revenue, count(*) AS transaction_count,
                           avg(amount) AS avg_transaction_value, min(amount) AS min_transaction,
                           max(amount) AS max_transaction,
                           coalesce(stddev_samp(amount), 0) AS stddev_transaction
                    FROM revenue_events WHERE {within(30)} GROUP BY 1)"""


@query(
    "revenue_streams",
    over(
        """SELECT *, CASE WHEN percentage > 40 THEN 'high' WHEN percentage > 20 THEN 'medium' ELSE 'low' END
                    AS concentration_risk FROM s""",
        "revenue_events", s=STREAMS,
    ),
)
def revenue_streams(spark, root):
    return revenue.revenue_streams(star.revenue_events(spark, root), SALES_AS_OF)


@query(
    "revenue_concentration",
    over(
        """SELECT *, CASE WHEN hhi > 2500 THEN 'high' WHEN hhi > 1500 THEN 'medium' ELSE 'low' END
                    AS concentration_level, greatest(0.0, 100 - hhi / 30) AS diversification_score
           FROM (SELECT sum(total_revenue) AS total_revenue, count(*) AS stream_count,
                        sum(percentage * percentage) AS hhi FROM s)""",
        "revenue_events", s=STREAMS,
    ),
)
def revenue_concentration(spark, root):
    return revenue.revenue_concentration(revenue.revenue_streams(star.revenue_events(spark, root), SALES_AS_OF))


@query(
    "price_points",
    over(
        f"""SELECT product_id, revenue / quantity AS effective_price, sum(quantity) AS total_quantity,
                   sum(revenue) AS total_revenue, count(DISTINCT customer_id) AS unique_customers
            FROM sales_events WHERE {within(90)} AND quantity > 0 GROUP BY 1, 2""",
        "sales_events",
    ),
)
def price_points(spark, root):
    return revenue.price_points(star.sales_events(spark, root), SALES_AS_OF)


@query(
    "pricing_opportunities",
    over(
        f"""SELECT product_id, 'pricing_increase' AS opportunity, avg_price AS current_avg_price,
                  10 AS potential_increase_percent, '{Q["PRICING_REASON"]}' AS reason, 1 - cv AS confidence
           FROM (SELECT product_id, avg(price) AS avg_price, max(price) - min(price) AS price_range,
                        stddev_pop(q) / CASE WHEN avg(q) > 0 THEN avg(q) ELSE 1 END AS cv
                 FROM points GROUP BY 1 HAVING count(*) >= 2)
           WHERE price_range > 0 AND cv < 0.5 * (price_range / avg_price)""",
        "sales_events",
        points=f"""SELECT product_id, revenue / quantity AS price, sum(quantity) AS q
                   FROM sales_events WHERE {within(90)} AND quantity > 0 GROUP BY 1, 2""",
    ),
)
def pricing_opportunities(spark, root):
    return revenue.pricing_opportunities(star.sales_events(spark, root), SALES_AS_OF)


@query(
    "net_revenue_retention",
    over(
        f"""SELECT *, {texts_case("nrr_level", texts.RETENTION_ACTIONS)} AS recommended_actions
            FROM (SELECT *, CASE WHEN net_revenue_retention >= 125 THEN 'excellent'
                                 WHEN net_revenue_retention >= 110 THEN 'good'
                                 WHEN net_revenue_retention >= 100 THEN 'healthy'
                                 WHEN net_revenue_retention >= 90 THEN 'concerning' ELSE 'critical' END AS nrr_level
                  FROM (SELECT sum(r) AS starting_revenue, sum(e) AS expansion_revenue, sum(c) AS churn_revenue,
                               count(*) AS customer_count, sum(r) + sum(e) - sum(c) AS ending_revenue,
                               (sum(r) + sum(e) - sum(c)) / sum(r) * 100 AS net_revenue_retention
                        FROM cust WHERE r > 0))""",
        "revenue_events",
        cust=f"""SELECT customer_id, sum(CASE WHEN revenue_type = 'recurring' THEN amount ELSE 0 END) AS r,
                        sum(CASE WHEN revenue_type = 'expansion' THEN amount ELSE 0 END) AS e,
                        sum(CASE WHEN revenue_type = 'churn' THEN abs(amount) ELSE 0 END) AS c
                 FROM revenue_events WHERE event_timestamp >= TIMESTAMP '2000-08-02'
                   AND event_timestamp < TIMESTAMP '{SALES_AS_OF}' GROUP BY 1""",
    ),
)
def net_revenue_retention(spark, root):
    return revenue.net_revenue_retention(star.revenue_events(spark, root), SALES_AS_OF)


@query(
    "revenue_anomalies",
    over(
        f"""SELECT strftime(date, '%Y-%m-%d') AS date, total AS value, mean, z AS z_score, total - mean AS deviation,
                   CASE WHEN abs(z) > 4 THEN 'critical' WHEN abs(z) > 3 THEN 'high'
                        WHEN abs(z) > 2 THEN 'medium' ELSE 'low' END AS severity
            FROM (SELECT *, (total - mean) / sd AS z FROM scored)
            WHERE {within(30, ts='date')} AND abs(z) > 1.5""",
        "revenue_events", daily=DAILY_REVENUE, scored=DAILY_STATS,
    ),
)
def revenue_anomalies(spark, root):
    return revenue.revenue_anomalies(daily_revenue(spark, root), "total", SALES_AS_OF, threshold=1.5)


# Orders and their lines as the order feed: status F counts as completed.
def shop_orders(spark, root):
    return star.table(spark, root, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderpriority").alias("channel"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_idr"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("cancelled").alias("order_status"),
        F.col("o_orderdate").alias("order_timestamp"),
    )


SHOP_ORDERS = """SELECT o_orderpriority AS channel, CAST(round(o_totalprice * 100) AS BIGINT) AS total_idr,
                        o_orderstatus = 'F' AS done, o_orderdate AS ts FROM orders"""


@query(
    "order_totals",
    over(
        """SELECT CAST(sum(total_idr) FILTER (done) AS BIGINT) AS total_revenue_idr, count(*) AS total_orders,
                  CAST(sum(total_idr) FILTER (done) AS BIGINT) / count(*) AS average_order_value FROM o""",
        o=SHOP_ORDERS,
    ),
)
def order_totals(spark, root):
    return orders.order_totals(shop_orders(spark, root))


@query("order_channel_distribution", over("SELECT channel, count(*) AS orders FROM o GROUP BY 1", o=SHOP_ORDERS))
def order_channel_distribution(spark, root):
    return orders.channel_distribution(shop_orders(spark, root))


@query(
    "peak_event_hours",
    """SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS orders FROM events WHERE event_type = 'purchase'
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def peak_event_hours(spark, root):
    events = star.table(spark, root, "events").filter("event_type = 'purchase'")
    return orders.peak_hours(events.withColumnRenamed("ts", "order_timestamp"), 5)


@query(
    "popular_items",
    """SELECT p_name AS name, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def popular_items(spark, root):
    lines, part = star.table(spark, root, "lineitem"), star.table(spark, root, "part")
    items = lines.join(part, lines.l_partkey == part.p_partkey)
    return orders.popular_items(items.select(F.col("p_name").alias("name"), F.col("l_quantity").alias("quantity")), 10)


@query(
    "orders_to_events",
    over(
        """SELECT 'evt_order_' || id AS event_id, 'sale' AS event_type, 'sales' AS domain, t AS event_timestamp,
                  '{"order_id":"' || id || '","customer_id":"' || cust || '","channel":"' || channel
                    || '","total_idr":' || total_idr || '}' AS data FROM o
           UNION ALL
           SELECT 'evt_cust_' || id, 'customer', 'customer', t,
                  '{"customer_id":"' || cust || '","event_type":"' || CASE WHEN done THEN 'purchase' ELSE 'support' END
                    || '"' || CASE WHEN draw < 10 THEN '' WHEN draw < 34 THEN ',"satisfaction_score":4'
                    ELSE ',"satisfaction_score":5' END || '}'
           FROM (SELECT *, CAST('0x' || substr(md5(id), 8, 7) AS INTEGER) % 50 AS draw FROM o)
           WHERE CAST('0x' || substr(md5(id), 1, 7) AS INTEGER) % 10 < 3""",
        o="""SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS cust, o_orderpriority AS channel,
                    CAST(round(o_totalprice * 100) AS BIGINT) AS total_idr, o_orderstatus = 'F' AS done,
                    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t FROM orders""",
    ),
)
def orders_to_events(spark, root):
    return orders.orders_to_events(shop_orders(spark, root))


@query(
    "order_amount_texts",
    """SELECT o_orderkey AS order_id, 'Rp' || replace(format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT)), ',', '.')
              AS amount FROM orders""",
)
def order_amount_texts(spark, root):
    return shop_orders(spark, root).select(
        F.col("order_id").cast("bigint").alias("order_id"), rupiah(F.col("total_idr")).alias("amount")
    )
