"""Committed event tables, mergeable states, dated order lines and backtests, with the reach of small operators."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from metricmill.operators import backtest, ingest, metrics, orders, revenue, sales, states
from metricmill.operators import forecast as fc
from metricmill.operators import recommend as rec
from metricmill.operators import regression
from metricmill.operators import series as se
from metricmill.functions.timeparts import in_period
from metricmill.plans.catalog import EVENTS_AS_OF, ORACLES, SALES_AS_OF, over, query, within
from metricmill.plans.domain_queries import STREAMS, shop_orders
from metricmill.plans.ingest_queries import (
    ANY_SALE_ERROR, GOOD, MESSAGES, SALES_CHECKS, customer_messages, landed_sales, split_stream,
)
from metricmill.plans.metric_queries import channel_series
from metricmill.plans.recommendation_queries import SHORT, SHORT_SQL, recommendations, recs_sql, status_log
from metricmill.plans.series_queries import FIT, FORECAST_ROW, INDEXED, LINEAR, SMOOTH, channel_sql, event_series, flat, hourly_sql
from metricmill.session import scratch
from metricmill.sources import commits, dated, journal, results, star, tables
from metricmill.sources.files import export_with_summary, ingest_from
from metricmill.streaming import ingest as live
from metricmill.streaming import windows


# ---- event tables under a commit log -------------------------------------------------------------------

def replayed_table(spark, root):
    """Two batches of the customer feed; the first is then written again without the second half of its days."""
    path = f"{scratch(spark, 'replayed')}/events"
    events = star.customer_events(spark, root)
    even = F.col("customer_id") % 2 == 0
    tables.write_events(events.filter(even), path, 1)
    tables.write_events(events.filter(~even), path, 2)
    fewer = events.filter(even & (F.col("event_timestamp") < "2024-01-15"))
    return path, tables.write_events(fewer, path, 1)


REPLAYED = "SELECT * FROM customer_events WHERE customer_id % 2 = 1 OR event_timestamp < TIMESTAMP '2024-01-15'"
BY_DAY = """SELECT strftime(event_timestamp, '%Y-%m-%d') AS event_date, event_type, count(*) AS events,
                   CAST(sum(satisfaction_score) AS DOUBLE) AS satisfaction FROM kept GROUP BY 1, 2"""


@query("replayed_event_days", over(BY_DAY, "customer_events", kept=REPLAYED))
def replayed_event_days(spark, root):
    """A replay with fewer days leaves none of the old rows behind."""
    path, _ = replayed_table(spark, root)
    rows = commits.read(spark, path).groupBy("event_date", "event_type")
    return rows.agg(F.count("*").alias("events"), F.sum(F.col("satisfaction_score").cast("double")).alias("satisfaction"))


@query("replayed_metric_days", over(BY_DAY, "customer_events", kept=REPLAYED))
def replayed_metric_days(spark, root):
    """Daily metrics of the whole table, then of the days that the replay touched, emptied ones among them."""
    base = scratch(spark, "replayed-gold")
    path, events = f"{base}/events", star.customer_events(spark, root)
    even = F.col("customer_id") % 2 == 0
    measures = {"satisfaction": "satisfaction_score"}
    tables.write_events(events.filter(even), path, 1)
    tables.write_events(events.filter(~even), path, 2)
    tables.write_daily_metrics(spark, path, f"{base}/gold", ["event_type"], measures)
    days = tables.write_events(events.filter(even & (F.col("event_timestamp") < "2024-01-15")), path, 1)
    tables.write_daily_metrics(spark, path, f"{base}/gold", ["event_type"], measures, days)
    return tables.read_daily_metrics(spark, f"{base}/gold").select("event_date", "event_type", "events", "satisfaction")


@query("folded_event_days", over(BY_DAY, "customer_events", kept=REPLAYED))
def folded_event_days(spark, root):
    """Small batches folded into one commit; then one of the folded batches is written again."""
    path, events = f"{scratch(spark, 'folded')}/events", star.customer_events(spark, root)
    for batch in range(4):
        tables.write_events(events.filter(F.col("customer_id") % 4 == batch), path, batch)
    tables.fold(spark, path)
    for batch in (0, 2):
        fewer = events.filter((F.col("customer_id") % 4 == batch) & (F.col("event_timestamp") < "2024-01-15"))
        tables.write_events(fewer, path, batch)
    rows = commits.read(spark, path).groupBy("event_date", "event_type")
    return rows.agg(F.count("*").alias("events"), F.sum(F.col("satisfaction_score").cast("double")).alias("satisfaction"))


@query(
    "stream_event_days",
    over(
        f"""SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS events
            FROM m WHERE {GOOD} AND {within(7, EVENTS_AS_OF, 'ts')} GROUP BY 1""",
        m=MESSAGES,
    ),
)
def stream_event_days(spark, root):
    """A stream over several files into the day-partitioned table, of which a period of days is read."""
    base = scratch(spark, "stream-days")
    messages = customer_messages(split_stream(spark, root, base))
    live.start_ingest(messages, base, f"{base}/checkpoint", EVENTS_AS_OF, window_seconds=None).awaitTermination()
    rows = tables.read_events(spark, f"{base}/events", EVENTS_AS_OF, 7)
    return rows.groupBy(F.to_date("event_timestamp").alias("event_date")).agg(F.count("*").alias("events"))


@query(
    "stream_repeated_messages",
    over(f"SELECT activity AS event_type, count(*) AS events FROM (SELECT DISTINCT ts, user_id, activity, s, p FROM m WHERE {GOOD}) GROUP BY 1", m=MESSAGES),
)
def stream_repeated_messages(spark, root):
    """Every message comes twice, in different files and out of order; each event is in the table once."""
    base = scratch(spark, "stream-repeats")
    messages = customer_messages(star.table(spark, root, "events"))
    for part in (messages, messages.orderBy(F.rand(3))):
        part.repartition(3).write.mode("append").text(f"{base}/in")
    stream = live.read_message_files(spark, f"{base}/in", 2)
    live.start_ingest(stream, base, f"{base}/checkpoint", EVENTS_AS_OF, window_seconds=None, distinct=True).awaitTermination()
    rows = tables.read_events(spark, f"{base}/events")
    return rows.groupBy(F.col("record.event_type").alias("event_type")).agg(F.count("*").alias("events"))


@query("stream_late_window_counts", ORACLES["stream_window_counts"])
def stream_late_window_counts(spark, root):
    """Windows counted over files whose times overlap: no state, and no row is too late."""
    base = scratch(spark, "stream-late")
    events = split_stream(spark, root, base).withColumnRenamed("ts", "event_timestamp")
    live.start_window_counts(events, f"{base}/out", f"{base}/checkpoint", available_now=True).awaitTermination()
    return live.read_window_counts(spark, f"{base}/out")


@query("stream_moving_window", ORACLES["event_anomalies_moving_window"])
def stream_moving_window(spark, root):
    """The moving window over a stream of several files, with each key's last values as state."""
    base = scratch(spark, "stream-moving")
    rows = event_series(spark, root)
    edges = ["2024-01-01", "2024-01-09", "2024-01-17", "2024-01-25", "2024-02-01"]
    for first, last in zip(edges, edges[1:]):  # files in order of time
        rows.filter((F.col("ts") >= first) & (F.col("ts") < last)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    windows.prepare_state(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    found = windows.moving_window_alerts(stream)
    live.start_updates(found, f"{base}/out", f"{base}/checkpoint", True, "append").awaitTermination()
    return flat(spark.read.parquet(f"{base}/out").drop("batch_id"), window_mean="window_mean")


# ---- mergeable states --------------------------------------------------------------------------------

def feed(rows, batch, columns=("*",)):
    """``rows`` landed once by their batch, as a feed arrives; gives the rows of a batch. Joins behind them run once."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "feed")
    dealt = rows.select(*columns, batch.cast("int").alias("feed_batch"))
    dealt.write.partitionBy("feed_batch").parquet(path)
    return lambda number: spark.read.schema(dealt.schema).parquet(path).filter(F.col("feed_batch") == number).drop("feed_batch")


def state_table(spark, root, view, measures, keys=(), grain="daily"):
    """States of a feed in three batches, one of them written twice."""
    path = scratch(spark, "states")
    events = view(spark, root)
    key = F.col("customer_id" if "customer_id" in events.columns else "product_id")
    arrived = feed(events, key % 3, [states.TS, *dict.fromkeys([*measures.values(), *keys])])
    for batch in (0, 1, 2, 1):
        states.write_states(arrived(batch), path, batch, measures, keys, grain)
    return path


def state_trend(name, view, metric, as_of, period, days, sql, grain="daily"):
    def run(spark, root):
        path = state_table(spark, root, view, {metric: metric}, grain=grain)
        return states.trends(states.read_states(spark, path, as_of, days, grain), metric, period)

    run.__doc__ = f"{metric} by {period} slots, from {grain} states."
    query(name, sql)(run)


state_trend("state_sales_daily_trend", star.sales_events, "revenue", SALES_AS_OF, "daily", 90, ORACLES["sales_daily_revenue_trend"])
state_trend(
    "state_customer_hourly_trend", star.customer_events, "satisfaction_score", EVENTS_AS_OF, "hourly", 30,
    ORACLES["customer_hourly_satisfaction_trend"], "hourly",
)
state_trend(
    "state_operations_weekly_trend", star.operations_events, "fulfillment_time_hours", SALES_AS_OF, "weekly", 180,
    ORACLES["operations_weekly_fulfillment_trend"],
)
state_trend("state_revenue_monthly_trend", star.revenue_events, "amount", SALES_AS_OF, "monthly", 365, ORACLES["revenue_monthly_amount_trend"])


@query("state_metric_anomalies", ORACLES["daily_metric_anomalies"])
def state_metric_anomalies(spark, root):
    """Unusual days of a metric, from its states."""
    path = state_table(spark, root, star.revenue_events, {"amount": "amount"})
    daily = states.daily_metrics(states.read_states(spark, path, SALES_AS_OF, 90, "daily"), {"total": ("amount", "sum")})
    return metrics.metric_anomalies(daily, "total", SALES_AS_OF, threshold=2.0, days=90)


@query("state_kpi_delta", ORACLES["sales_kpi_delta"])
def state_kpi_delta(spark, root):
    """Two adjacent months compared, from their states."""
    path = state_table(spark, root, star.sales_events, {"revenue": "revenue", "quantity": "quantity"})
    wanted = {"total_revenue": ("revenue", "sum"), "avg_quantity": ("quantity", "avg"), "lines": ("revenue", "count")}
    rows = states.read_states(spark, path, SALES_AS_OF, 60, "daily")
    return states.compare_periods(rows, wanted, F.lit("2001-07-03").cast("timestamp"))


def channel_state_series(spark, root):
    path = state_table(spark, root, star.sales_events, {"revenue": "revenue"}, ["channel"])
    return states.series(states.read_states(spark, path, SALES_AS_OF, 365, "daily"), ["channel"], "revenue", "daily")


@query("state_channel_cards", ORACLES["channel_metric_cards"])
def state_channel_cards(spark, root):
    return metrics.metric_card(channel_state_series(spark, root))


@query("state_channel_seasonality", ORACLES["channel_seasonality_weekly"])
def state_channel_seasonality(spark, root):
    return se.seasonal_index(channel_state_series(spark, root), "weekly")


@query(
    "state_revenue_quantiles",
    over(
        """SELECT channel, n, max(CASE WHEN below <= floor(0.5 * (n - 1)) AND floor(0.5 * (n - 1)) < upto THEN value END) AS median,
                  max(CASE WHEN below <= floor(0.95 * (n - 1)) AND floor(0.95 * (n - 1)) < upto THEN value END) AS p95
           FROM (SELECT *, upto - k AS below, pow(1.02, bin - 1000000) * (2 / 2.02::DOUBLE) AS value FROM c) GROUP BY 1, 2""",
        "sales_events",
        b=f"""SELECT channel, CAST(ceil(ln(revenue) / ln(1.02)) AS BIGINT) + 1000000 AS bin, count(*) AS k
              FROM sales_events WHERE {within(365)} AND revenue > 0 GROUP BY 1, 2""",
        c="""SELECT *, CAST(sum(k) OVER (PARTITION BY channel ORDER BY bin) AS BIGINT) AS upto,
                    CAST(sum(k) OVER (PARTITION BY channel) AS BIGINT) AS n FROM b""",
    ),
)
def state_revenue_quantiles(spark, root):
    """Ranks from daily bins that add up over days and batches."""
    path = scratch(spark, "bins")
    events = star.sales_events(spark, root).filter("revenue > 0")
    arrived = feed(events, F.col("customer_id") % 2, [states.TS, "channel", "revenue"])
    for batch in (0, 1, 1):
        rows = states.bins_of(arrived(batch), "revenue", ["channel"])
        states.write_slots(rows, path, batch)
    bins = states.read_states(spark, path, SALES_AS_OF, 365, "daily")
    return states.quantiles(bins, ["channel"], {"median": 0.5, "p95": 0.95})


# ---- order lines by event date --------------------------------------------------------------------------

def dated_lines(spark, root, period):
    """Order lines written by month and bucket, then read for a period."""
    path = scratch(spark, "dated")
    name = "dated_" + os.path.basename(path).replace("-", "_")
    lines = star.table(spark, root, "lineitem")
    dated.write_order_lines(star.table(spark, root, "orders"), lines, name, path, dated.buckets_for(lines), "month")
    return dated.order_lines(spark, name, SALES_AS_OF, period, "month")


@query("dated_sales_metrics", ORACLES["sales_metrics_by_channel"])
def dated_sales_metrics(spark, root):
    wanted = {
        "total_revenue": ("revenue", "sum"), "avg_revenue": ("revenue", "avg"), "line_count": ("revenue", "count"),
    }
    return metrics.daily_metrics(star.sales_of(dated_lines(spark, root, 30)), wanted, SALES_AS_OF, "last 30 days", ["channel"])


@query("dated_churn_risk", ORACLES["churn_risk"])
def dated_churn_risk(spark, root):
    return sales.churn_risk(star.sales_of(dated_lines(spark, root, 90)), SALES_AS_OF, top=10)


@query(
    "dated_revenue_streams",
    over(
        """SELECT *, CASE WHEN percentage > 40 THEN 'high' WHEN percentage > 20 THEN 'medium' ELSE 'low' END
                    AS concentration_risk FROM s""",
        "revenue_events", s=STREAMS,
    ),
)
def dated_revenue_streams(spark, root):
    return revenue.revenue_streams(star.revenue_of(dated_lines(spark, root, 365)), SALES_AS_OF)


@query("dated_net_revenue_retention", ORACLES["net_revenue_retention"])
def dated_net_revenue_retention(spark, root):
    return revenue.net_revenue_retention(star.revenue_of(dated_lines(spark, root, 365)), SALES_AS_OF)


# ---- forecasts tested on later values -------------------------------------------------------------------

def ordered(frame: str) -> str:
    return f"OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN {frame})"


SO_FAR = ordered("UNBOUNDED PRECEDING AND CURRENT ROW")
ORIGINS = f"""SELECT *, regr_slope(value, idx) {SO_FAR} AS a, regr_intercept(value, idx) {SO_FAR} AS b,
                     avg(value) {ordered('6 PRECEDING AND CURRENT ROW')} AS ma FROM i"""
PAIRS = """SELECT * FROM (
             SELECT series_key, idx, step, value AS last_value, b + a * (idx + step) AS linear, ma AS moving_average,
                    lag(value, 7 - step) OVER w AS seasonal_naive, lead(value, step) OVER w AS actual
             FROM o CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS step)
             WINDOW w AS (PARTITION BY series_key, step ORDER BY idx)) WHERE idx >= 9 AND actual IS NOT NULL"""
LONG_PAIRS = "SELECT series_key, idx, step, actual, method, forecast FROM p UNPIVOT (forecast FOR method IN (linear, moving_average, seasonal_naive, last_value))"


@query(
    "backtest_errors",
    hourly_sql(
        """SELECT series_key, method, CAST(step AS INTEGER) AS step, count(*) AS origins, avg(abs(actual - forecast)) AS mae,
                  sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse, avg(actual - forecast) AS bias,
                  avg(abs((actual - forecast) / nullif(actual, 0))) * 100 AS mape FROM q GROUP BY 1, 2, 3""",
        o=ORIGINS, p=PAIRS, q=LONG_PAIRS,
    ),
)
def backtest_errors(spark, root):
    """Errors by step of four methods from every origin of the hourly series."""
    return backtest.errors_by_step(backtest.origins(event_series(spark, root)))


@query(
    "backtest_best_methods",
    hourly_sql(
        """SELECT series_key, arg_min(method, rmse) AS method, min(rmse) AS rmse
           FROM (SELECT series_key, method, sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse FROM q GROUP BY 1, 2) GROUP BY 1""",
        o=ORIGINS, p=PAIRS, q=LONG_PAIRS,
    ),
)
def backtest_best_methods(spark, root):
    return backtest.best_methods(backtest.origins(event_series(spark, root)))


@query(
    "backtest_outliers",
    hourly_sql(
        """SELECT series_key, step, actual, forecast, actual - forecast AS deviation, pe AS percent_error,
                  CASE WHEN pe < 10 THEN 'low' WHEN pe < 25 THEN 'medium' WHEN pe < 50 THEN 'high' ELSE 'critical' END AS severity
           FROM (SELECT series_key, idx + 1 AS step, actual, linear AS forecast, abs((actual - linear) / linear) * 100 AS pe,
                        stddev_pop(abs(actual - linear)) OVER (PARTITION BY series_key) AS sd FROM p WHERE step = 1)
           WHERE abs(actual - forecast) > 2 * sd""",
        o=ORIGINS, p=PAIRS,
    ),
)
def backtest_outliers(spark, root):
    """Points far from what the line through all earlier points said: no point is tested on a line fitted to it."""
    pairs = backtest.origins(event_series(spark, root), 1, ["linear"])
    by_point = pairs.select("series_key", (F.col("idx") + 1).alias("step"), "actual", "forecast")
    return fc.forecast_errors(by_point)


SHORT_CHANNEL = f"""SELECT channel || '|' || (customer_id % 40) AS series_key, event_timestamp AS ts, sum(revenue) AS value
                    FROM sales_events WHERE {within(75)} GROUP BY 1, 2"""


@query(
    "forecast_auto_branches",
    over(
        f"""SELECT {FORECAST_ROW}, 'linear_regression' AS method, mae, sd AS rmse FROM l JOIN t USING (series_key) WHERE n >= 10 AND line
            UNION ALL
            SELECT series_key, CAST(step AS INTEGER), strftime(last + (last - prev) * step, '%Y-%m-%d %H:%M:%S'),
                   level + growth * w AS f, f - 1.96 * sd, f + 1.96 * sd, 'exponential_smoothing', mae, rmse
            FROM (SELECT r.*, step, list_sum(list_transform(range(1, step + 1), lambda j: pow(0.9, j))) AS w, x.sd, x.mae, x.rmse, x.last, x.prev
                  FROM r JOIN (SELECT series_key, max(idx) AS idx, stddev_pop(e) AS sd, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse
                               FROM r GROUP BY 1) y USING (series_key, idx)
                  JOIN (SELECT r.series_key, stddev_pop(e) AS sd, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
                               max(ts) AS last, max(ts) FILTER (i.idx = n - 2) AS prev
                        FROM r JOIN i USING (series_key, idx) GROUP BY 1) x USING (series_key)
                  JOIN t USING (series_key), (SELECT unnest(range(1, 8)) AS step) WHERE NOT line)
            UNION ALL
            SELECT series_key, CAST(step AS INTEGER), strftime(last + coalesce(last - prev, INTERVAL 1 DAY) * step, '%Y-%m-%d %H:%M:%S'),
                   NULL, NULL, NULL, 'too_short', NULL, NULL
            FROM (SELECT series_key, max(ts) AS last, max(ts) FILTER (idx = n - 2) AS prev FROM i WHERE n < 10 GROUP BY 1),
                 (SELECT unnest(range(1, 8)) AS step)""",
        "sales_events",
        s=SHORT_CHANNEL, i=INDEXED, f=FIT, l=LINEAR.replace("SELECT f.series_key,", "SELECT f.series_key, n,", 1),
        t="""SELECT series_key, n >= 50 OR (reach > 0 AND abs(a * n) > 0.1 * reach) AS line
             FROM (SELECT series_key, max(value) - min(value) AS reach FROM i GROUP BY 1) JOIN f USING (series_key)""",
        r=SMOOTH,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def forecast_auto_branches(spark, root):
    """Series of every length: a line, smoothing at given parameters, or too short."""
    events = star.sales_events(spark, root).filter(in_period("event_timestamp", SALES_AS_OF, 75))
    group = F.concat_ws("|", "channel", (F.col("customer_id") % 40).cast("string"))
    rows = metrics.rollup_series(events, [group], "revenue", "daily", "sum")
    return fc.forecast(rows, 7, "auto", smoothing=(0.3, 0.2, 0.9))


def _term_sql() -> list[str]:
    n_waves, n_knots = regression.WAVES, regression.KNOTS
    share, days = "(idx::DOUBLE / n)", "(epoch_us(ts) / 86400000000.0::DOUBLE)"
    waves = [f"{wave}({days} * (2 * pi() * {k} / 7))" for k in range(1, n_waves + 1) for wave in ("sin", "cos")]
    knots = [f"greatest({share} - {k} / {n_knots + 1}::DOUBLE, 0.0::DOUBLE)" for k in range(1, n_knots + 1)]
    return ["1.0::DOUBLE", share, *knots, *waves]


@query(
    "regression_sums",
    channel_sql(
        """SELECT a.series_key, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, sum(a.x * b.x) AS product, sum(a.x * a.value) AS with_value
           FROM t a JOIN t b ON a.series_key = b.series_key AND a.ts = b.ts AND a.i <= b.i GROUP BY 1, 2, 3""",
        x=f"SELECT series_key, ts, value, [{', '.join(_term_sql())}] AS xs FROM i WHERE n >= 10",
        t="SELECT series_key, ts, value, unnest(range(0, len(xs))) AS i, unnest(xs) AS x FROM x",
    ),
)
def regression_sums(spark, root):
    """The normal equations of the seasonal regression, entry by entry."""
    sums = regression.sums(channel_series(spark, root))
    size = 2 + regression.KNOTS + 2 * regression.WAVES
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    entries = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("xx")[k].alias("product"), F.col("xy")[i].alias("with_value"))
        for k, (i, j) in enumerate(pairs)
    ])
    return sums.select("series_key", F.inline(entries))


# ---- sources, callbacks and arguments that no other query reaches ---------------------------------------

SALE_TOTALS = over(
    f"SELECT channel, count(*) AS events, sum(revenue * q) AS total_value FROM c WHERE NOT {ANY_SALE_ERROR} GROUP BY 1",
    c=SALES_CHECKS,
)


def response_pages(rows, most=10_000):
    """Rows as the responses of a service, of ``most`` items each; the first item of a task comes as a lone object.

    Items are written by the task that holds them, so a response's size does not follow the table's.
    """
    def pages(batches):
        import pyarrow as pa

        alone = True
        for batch in batches:
            items = batch.column(0).to_pylist()
            if alone and items:
                yield pa.RecordBatch.from_pydict({"value": [f'{{"data":{items.pop(0)}}}']})
                alone = False
            for k in range(0, len(items), most):
                yield pa.RecordBatch.from_pydict({"value": [f'{{"data":[{",".join(items[k:k + most])}]}}']})

    return rows.select(F.to_json(F.struct(*rows.columns)).alias("item")).mapInArrow(pages, "value string")


@query("landed_responses", SALE_TOTALS)
def landed_responses(spark, root):
    """Sales as service responses landed as files, some of which hold a lone object, ingested and totalled."""
    base = scratch(spark, "responses")
    # The stand-in for a service: each page is one response, and one file.
    response_pages(landed_sales(spark, root)).write.option("maxRecordsPerFile", 1).text(f"{base}/landing")
    events = ingest_from(spark, {"type": "api", "path": f"{base}/landing", "event_type": "sale"})
    good = ingest.process_batch(events, SALES_AS_OF).events
    return ingest.silver(good, "sale").groupBy("channel").agg(F.count("*").alias("events"), F.sum("total_value").alias("total_value"))


@query(
    "message_file_hooks",
    over(
        f"""SELECT 'on_batch' AS hook, count(*) FILTER ({GOOD}) AS events FROM m
            UNION ALL SELECT 'on_error', count(*) FILTER (NOT ({GOOD})) FROM m""",
        m=MESSAGES,
    ),
)
def message_file_hooks(spark, root):
    """Messages from files, a few files per batch; the hooks of good and of refused rows write what they were given."""
    base = scratch(spark, "hooks")
    customer_messages(star.table(spark, root, "events")).repartition(5).write.text(f"{base}/in")

    def told(hook):
        def write(rows, batch):
            counted = rows.agg(F.lit(hook).alias("hook"), F.count("*").alias("events"))
            counted.write.mode("overwrite").parquet(f"{base}/told/of={hook}/batch={batch}")

        return write

    stream = live.read_message_files(spark, f"{base}/in", 2)
    live.start_ingest(
        stream, base, f"{base}/checkpoint", EVENTS_AS_OF, None, told("on_batch"), told("on_error"), "files",
    ).awaitTermination()
    return spark.read.parquet(f"{base}/told").groupBy("hook").agg(F.sum("events").alias("events"))


@query(
    "strict_refusal",
    over(
        f"""SELECT 'valid rows' AS feed, CASE WHEN count(*) FILTER ({ANY_SALE_ERROR} AND NOT {ANY_SALE_ERROR}) > 0 THEN 'refused' ELSE 'passed' END AS outcome FROM c
            UNION ALL SELECT 'all rows', CASE WHEN count(*) FILTER ({ANY_SALE_ERROR}) > 0 THEN 'refused' ELSE 'passed' END FROM c""",
        c=SALES_CHECKS,
    ),
)
def strict_refusal(spark, root):
    """Strict mode ends the job at a refused row, and only then."""
    checked = ingest.validate(ingest.landed(landed_sales(spark, root), "sale"), SALES_AS_OF)
    outcomes = []
    for feed, rows in (("valid rows", ingest.valid_rows(checked)), ("all rows", checked)):
        try:
            ingest.require_valid(rows).write.format("noop").mode("overwrite").save()
            outcomes.append((feed, "passed"))
        except Exception as error:
            if "invalid event: " not in str(error):
                raise
            outcomes.append((feed, "refused"))
    return spark.createDataFrame(outcomes, "feed string, outcome string")


@query(
    "one_customer_churn",
    ORACLES["churn_risk"].replace("risk_score >= 0.5", "risk_score >= 0").replace(
        f"WHERE {within(90)}", f"WHERE {within(90)} AND customer_id = (SELECT max(customer_id) FROM sales_events WHERE {within(30)})"
    ),
)
def one_customer_churn(spark, root):
    """The question for one customer only: the last of those that bought in the last month."""
    events = star.sales_events(spark, root)
    last = events.filter(in_period("event_timestamp", SALES_AS_OF, 30)).agg(F.max("customer_id")).first()[0]
    return sales.churn_risk(events, SALES_AS_OF, customer_id=last, keep_from=0.0, top=10)


@query("recommendation_by_id", recs_sql(f"SELECT {SHORT_SQL} FROM r WHERE recommendation_id = (SELECT max(recommendation_id) FROM r)"))
def recommendation_by_id(spark, root):
    rows = recommendations(spark, root)
    wanted = rows.agg(F.max("recommendation_id")).first()[0]
    return rec.by_id(rows, wanted).select(*SHORT)


@query(
    "cross_domain_partial",
    recs_sql(
        """SELECT name, string_agg(domain, '; ' ORDER BY place) AS relevant_domains, 'Analyze trade-offs and optimize jointly' AS action
           FROM (VALUES
             ('Revenue Growth & Customer Retention', 1, 'sales'), ('Revenue Growth & Customer Retention', 2, 'customer'),
             ('Revenue Growth & Customer Retention', 3, 'revenue'), ('Inventory Optimization & Customer Satisfaction', 1, 'operations'),
             ('Inventory Optimization & Customer Satisfaction', 2, 'customer'), ('Pricing & Volume Optimization', 1, 'sales'),
             ('Pricing & Volume Optimization', 2, 'revenue'), ('Pricing & Volume Optimization', 3, 'operations'))
             v(name, place, domain)
           WHERE domain IN (SELECT domain FROM r WHERE domain <> 'operations') GROUP BY 1 HAVING count(*) >= 2"""
    ),
)
def cross_domain_partial(spark, root):
    """Rules when one domain has no results: a rule of two domains falls, one of three stays with two."""
    rows = rec.cross_domain_opportunities(recommendations(spark, root).filter("domain <> 'operations'"))
    return rows.select("name", "relevant_domains", "action")


@query(
    "exported_summary",
    """SELECT 'nation' AS name, count(*) AS records, CAST(3 AS INTEGER) AS columns, 'nation' AS folder FROM nation
       UNION ALL SELECT 'supplier', count(*), CAST(4 AS INTEGER), 'supplier' FROM supplier""",
)
def exported_summary(spark, root):
    frames = {name: star.table(spark, root, name) for name in ("nation", "supplier")}
    return export_with_summary(frames, scratch(spark, "export-summary"))


@query("cached_sales_trend", ORACLES["sales_daily_revenue_trend"])
def cached_sales_trend(spark, root):
    """A trend that is kept by its plan and the files, asked twice; the second answer opens no source file."""
    base = scratch(spark, "kept")
    ask = lambda: results.cached(metrics.trends(star.sales_events(spark, root), "revenue", SALES_AS_OF, "daily", 90), base)
    ask()
    again = ask()
    if any("result=" not in name for name in again.inputFiles()):
        raise RuntimeError("the result was not kept")
    return again


@query("order_payload_items", ORACLES["order_item_totals"])
def order_payload_items(spark, root):
    """Orders with their items nested become events; the items are read back from the events' payloads and added up."""
    lines, part = star.table(spark, root, "lineitem"), star.table(spark, root, "part")
    item = F.struct(
        F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("name"),
        F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("bigint").alias("price"),
    )
    # An order has seven lines at most.
    nested = lines.join(part, lines.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").cast("string").alias("order_id")).agg(
        F.collect_list(item).alias("items")
    )
    events = orders.orders_to_events(shop_orders(spark, root).join(nested, "order_id")).filter("event_type = 'sale'")
    payload = "order_id string, items array<struct<item_id: string, name: string, quantity: int, price: bigint>>"
    flat = orders.order_items(events.select(F.from_json("data", payload).alias("p")).select("p.*"))
    return flat.groupBy("name").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("lines"))


@query("journal_state", ORACLES["recommendation_state"])
def journal_state(spark, root):
    """Status changes merged in three batches that are not in order of time, one of them twice."""
    path = scratch(spark, "journal")
    log = status_log(spark, root)
    arrived = feed(log, F.pmod(F.xxhash64("recommendation_id", "updated_at"), F.lit(3)))
    for k in (2, 0, 1, 0):
        journal.merge(arrived(k), path, 16)
    rows = journal.current(recommendations(spark, root), path)
    return rows.select("recommendation_id", "status", "feedback", "actual_impact", "updated_at")
