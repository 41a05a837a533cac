"""Validation, enrichment and streaming over messages derived from the tables.

The messages break rules on purpose, by rules on the rows: refunds carry a negative
revenue, one order priority lands without a channel, some times are not times.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from metricmill.operators import ingest
from metricmill.plans.catalog import EVENTS_AS_OF, SALES_AS_OF, over, query
from metricmill.session import scratch
from metricmill.sources import star, tables
from metricmill.sources.files import read_csv_events, write_csv_by_type
from metricmill.streaming import ingest as live

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def landed_sales(spark, root):
    lines, orders = star.table(spark, root, "lineitem"), star.table(spark, root, "orders")
    stamp = (
        F.when(F.col("l_linenumber") == 5, F.lit("n/a"))
        .when(F.col("l_linenumber") % 2 == 0, F.date_format("o_orderdate", ISO))
        .otherwise(F.unix_seconds("o_orderdate").cast("string"))
    )
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.when(F.col("l_returnflag") == "R", -net).otherwise(net).cast("string").alias("revenue"),
        F.when(F.col("l_linenumber") == 7, F.lit("0"))
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias("quantity"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("channel"),
        stamp.alias("timestamp"),
    )


def landed_operations(spark, root):
    lines, orders = star.table(spark, root, "lineitem"), star.table(spark, root, "orders")
    part = star.table(spark, root, "part")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(part, lines.l_partkey == part.p_partkey)
    return joined.select(
        (F.col("p_size") - 3).cast("string").alias("inventory_level"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("warehouse_id"),
        (24 * F.datediff("l_shipdate", "o_orderdate")).cast("string").alias("fulfillment_time_hours"),
        F.date_format("l_shipdate", ISO).alias("timestamp"),
    )


def landed_revenue(spark, root):
    rows = star.revenue_events(spark, root)
    return rows.select(
        "revenue_type",
        F.col("amount").cast("string").alias("amount"),
        (12 * F.col("amount")).cast("string").alias("arr"),
        F.date_format("event_timestamp", ISO).alias("timestamp"),
    )


def customer_messages(events):
    """JSON text of the customer feed; works on a batch and on a streaming frame."""
    k = F.get_json_object("props", "$.k").cast("int")
    activity = (
        F.when(F.col("event_type") == "view", "login").when(F.col("event_type") == "purchase", "purchase")
        .when(F.col("event_type") == "error", "support").otherwise("review")
    )
    data = F.struct(
        F.col("user_id").cast("string").alias("customer_id"),
        activity.alias("event_type"),
        F.when(k % 10 >= 3, k % 7).alias("satisfaction_score"),
        F.when(k % 2 != 0, k % 13).alias("nps_score"),
        F.date_format("ts", ISO).alias("timestamp"),
    )
    routed = F.when(k % 17 == 0, F.lit("signal")).otherwise(F.lit("customer"))
    message = F.to_json(F.struct(routed.alias("event_type"), data.alias("data")))
    return events.select(F.when(k == 99, F.concat(F.lit("<"), message)).otherwise(message).alias("value"))


def checked_customers(spark, root):
    messages = customer_messages(star.table(spark, root, "events"))
    return ingest.validate(ingest.parse_messages(messages), EVENTS_AS_OF)


SALES_CHECKS = """SELECT *, revenue <= 0 AS e_revenue, q <= 0 AS e_quantity, channel IS NULL AS e_channel,
                         l_linenumber = 5 AS e_time
                  FROM (SELECT l.*, o.*, l_extendedprice * (1 - l_discount) AS net,
                               CASE WHEN l_returnflag = 'R' THEN -net ELSE net END AS revenue,
                               CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS q,
                               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS channel
                        FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)"""
ANY_SALE_ERROR = "(e_revenue OR e_quantity OR e_channel OR e_time)"


@query(
    "sale_validation_stats",
    over(
        f"""SELECT count(*) AS total, count(*) FILTER (NOT {ANY_SALE_ERROR}) AS valid,
                   count(*) FILTER ({ANY_SALE_ERROR}) AS invalid,
                   count(*) FILTER (NOT {ANY_SALE_ERROR}) / count(*) * 100 AS valid_rate FROM c""",
        c=SALES_CHECKS,
    ),
)
def sale_validation_stats(spark, root):
    return ingest.validation_stats(ingest.validate(ingest.landed(landed_sales(spark, root), "sale"), SALES_AS_OF))


@query(
    "sale_error_counts",
    over(
        """SELECT 'sale' AS event_type, error, count(*) AS events FROM (
             SELECT 'revenue: must be greater than 0' AS error FROM c WHERE e_revenue
             UNION ALL SELECT 'quantity: must be greater than 0' FROM c WHERE e_quantity
             UNION ALL SELECT 'channel: field required' FROM c WHERE e_channel
             UNION ALL SELECT 'timestamp: not a valid timestamp' FROM c WHERE e_time) GROUP BY error""",
        c=SALES_CHECKS,
    ),
)
def sale_error_counts(spark, root):
    return ingest.error_counts(ingest.validate(ingest.landed(landed_sales(spark, root), "sale"), SALES_AS_OF))


@query(
    "sale_enrichment",
    over(
        f"""SELECT channel, CAST(0 AS INTEGER) AS hour, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
                   isodow(o_orderdate) >= 6 AS is_weekend, count(*) AS events, sum(revenue * q) AS total_value
            FROM c WHERE NOT {ANY_SALE_ERROR} GROUP BY 1, 2, 3, 4""",
        c=SALES_CHECKS,
    ),
)
def sale_enrichment(spark, root):
    result = ingest.process_batch(ingest.landed(landed_sales(spark, root), "sale"), SALES_AS_OF)
    return ingest.silver(result.events, "sale").groupBy("channel", "hour", "day_of_week", "is_weekend").agg(
        F.count("*").alias("events"), F.sum("total_value").alias("total_value")
    )


@query(
    "operation_error_counts",
    """SELECT 'operation' AS event_type, error, count(*) AS events FROM (
         SELECT 'inventory_level: must be at least 0' AS error FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN part ON l_partkey = p_partkey WHERE p_size < 3
         UNION ALL SELECT 'fulfillment_time_hours: must be at least 0' FROM lineitem
           JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
           WHERE l_shipdate < o_orderdate) GROUP BY error""",
)
def operation_error_counts(spark, root):
    rows = ingest.landed(landed_operations(spark, root), "operation")
    return ingest.error_counts(ingest.validate(rows, SALES_AS_OF))


@query(
    "revenue_quarantine",
    over(
        """SELECT 'revenue' AS event_type, revenue_type, 'arr: must be at least 0' AS error, count(*) AS events
           FROM revenue_events WHERE amount < 0 GROUP BY 2""",
        "revenue_events",
    ),
)
def revenue_quarantine(spark, root):
    rows = ingest.validate(ingest.landed(landed_revenue(spark, root), "revenue"), SALES_AS_OF)
    kind = F.get_json_object("event", "$.revenue_type").alias("revenue_type")
    return ingest.invalid_rows(rows).groupBy("event_type", kind, "error").agg(F.count("*").alias("events"))


MESSAGES = """SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                     CASE event_type WHEN 'view' THEN 'login' WHEN 'purchase' THEN 'purchase'
                          WHEN 'error' THEN 'support' ELSE 'review' END AS activity,
                     CASE WHEN k % 10 >= 3 THEN k % 7 END AS s, CASE WHEN k % 2 <> 0 THEN k % 13 END AS p,
                     k = 99 AS broken, k % 17 = 0 AS unknown FROM events"""
GOOD = "NOT broken AND NOT unknown AND (s IS NULL OR s BETWEEN 1 AND 5) AND (p IS NULL OR p <= 10)"
SENTIMENT = "CASE WHEN s >= 4 THEN 'positive' WHEN s = 3 THEN 'neutral' WHEN s < 3 THEN 'negative' END"
NPS = "CASE WHEN p >= 9 THEN 'promoter' WHEN p >= 7 THEN 'passive' WHEN p < 7 THEN 'detractor' END"


@query(
    "message_error_counts",
    over(
        """SELECT event_type, error, count(*) AS events FROM (
             SELECT 'system' AS event_type, 'event_type: field required' AS error FROM m WHERE broken
             UNION ALL SELECT 'signal', 'event_type: unknown value' FROM m WHERE NOT broken AND unknown
             UNION ALL SELECT 'customer', 'satisfaction_score: must be between 1 and 5' FROM m
               WHERE NOT broken AND NOT unknown AND s NOT BETWEEN 1 AND 5
             UNION ALL SELECT 'customer', 'nps_score: must be between 0 and 10' FROM m
               WHERE NOT broken AND NOT unknown AND p > 10) GROUP BY 1, 2""",
        m=MESSAGES,
    ),
)
def message_error_counts(spark, root):
    return ingest.error_counts(checked_customers(spark, root))


ENRICHED_CUSTOMERS = f"""SELECT 'evt_' || substr(md5('customer_' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '_{{"customer_id":"'
           || user_id || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || '","event_type":"' || activity || '"'
           || coalesce(',"satisfaction_score":' || s, '') || coalesce(',"nps_score":' || p, '') || '}}'), 1, 16) AS event_id,
           'customer' AS domain, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_timestamp, user_id::VARCHAR AS customer_id,
           activity, s AS satisfaction_score, p AS nps_score, {SENTIMENT} AS sentiment, {NPS} AS nps_category
           FROM m WHERE {GOOD}"""


@query("customer_enrichment", over(ENRICHED_CUSTOMERS, m=MESSAGES))
def customer_enrichment(spark, root):
    rows = ingest.enrich(ingest.valid_rows(checked_customers(spark, root)), EVENTS_AS_OF)
    return ingest.silver(rows, "customer").drop("timestamp", "ingested_at")


def odd_messages(events):
    """Sales whose numbers and times are at the edge of what a message can hold."""
    k = F.get_json_object("props", "$.k").cast("int") % 10
    revenue = F.when(k == 0, '"NaN"').when(k == 1, '"Infinity"').when(k == 8, "1e400").otherwise("12.5")
    quantity = F.when(k == 4, "1.5").when(k == 5, '""').when(k == 9, "99999999999").otherwise("2")
    stamp = (
        F.when(k == 2, "99999999999999999999").when(k == 3, '"2024"').when(k == 6, "1700000000.5")
        .otherwise('"2024-01-05T10:00:00Z"')
    )
    body = F.format_string(
        '{"customer_id":"c%d","product_id":"p","revenue":%s,"quantity":%s,"channel":"web","timestamp":%s}',
        "user_id", revenue, quantity, stamp,
    )
    return events.select(F.format_string('{"event_type":"sale","data":%s}', body).alias("value"))


ODD = "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k FROM events"
ODD_ERRORS = """CASE k WHEN 0 THEN 'revenue: not a valid double' WHEN 1 THEN 'revenue: not a valid double'
    WHEN 2 THEN 'timestamp: not a valid timestamp' WHEN 3 THEN 'timestamp: not a valid timestamp'
    WHEN 4 THEN 'quantity: not a valid int' WHEN 5 THEN 'quantity: not a valid int'
    WHEN 8 THEN 'revenue: not a valid double' WHEN 9 THEN 'quantity: not a valid int' END"""


@query(
    "odd_message_errors",
    f"""SELECT 'sale' AS event_type, {ODD_ERRORS} AS error, count(*) AS events FROM ({ODD})
        WHERE k NOT IN (6, 7) GROUP BY 2""",
)
def odd_message_errors(spark, root):
    """NaN, infinity, numbers beyond their type and digits in quotes are findings; nothing fails."""
    parsed = ingest.parse_messages(odd_messages(star.table(spark, root, "events")))
    return ingest.error_counts(ingest.validate(parsed, EVENTS_AS_OF))


def event_stream(spark, root):
    star.pin_utc(spark)
    return spark.readStream.schema(star.TABLES["events"]).option("pathGlobFilter", "events.parquet").parquet(root)


def split_stream(spark, root, base, batches=6, per_file=100_000):
    """The event feed as files of about ``per_file`` rows whose times overlap, read in ``batches``.

    A file is read by one task, so a batch of a large feed has many.
    """
    events = star.table(spark, root, "events")
    files = max(1, math.ceil(events.count() / (batches * per_file)))
    events.repartition(batches * files, "event_id").write.parquet(f"{base}/feed")
    return spark.readStream.schema(star.TABLES["events"]).option("maxFilesPerTrigger", files).parquet(f"{base}/feed")


@query(
    "stream_counters",
    over(
        f"SELECT count(*) AS received, count(*) FILTER ({GOOD}) AS processed, count(*) FILTER (NOT ({GOOD})) AS failed FROM m",
        m=MESSAGES,
    ),
)
def stream_counters(spark, root):
    """Counters over all batches of a stream, from the rows written beside its sinks."""
    base = scratch(spark, "stream-counters")
    messages = customer_messages(split_stream(spark, root, base))
    live.start_ingest(messages, base, f"{base}/checkpoint", EVENTS_AS_OF, window_seconds=None).awaitTermination()
    return live.ingest_counters(spark, base)


@query(
    "stream_ingest",
    over(
        f"""SELECT 'events' AS sink, 'customer' AS event_type, {SENTIMENT} AS detail, count(*) AS events
            FROM m WHERE {GOOD} GROUP BY 3
            UNION ALL SELECT 'quarantine', 'system', 'event_type: field required', count(*) FROM m WHERE broken
            UNION ALL SELECT 'quarantine', 'signal', 'event_type: unknown value', count(*) FROM m
              WHERE NOT broken AND unknown
            UNION ALL SELECT 'quarantine', 'customer', e, count(*) FROM (
              SELECT concat_ws('; ', CASE WHEN s NOT BETWEEN 1 AND 5 THEN 'satisfaction_score: must be between 1 and 5' END,
                                     CASE WHEN p > 10 THEN 'nps_score: must be between 0 and 10' END) AS e
              FROM m WHERE NOT broken AND NOT unknown AND NOT ({GOOD})) GROUP BY 3""",
        m=MESSAGES,
    ),
)
def stream_ingest(spark, root):
    """The whole streaming path: parse, validate, enrich, write, then read the sinks back."""
    base = scratch(spark, "stream-ingest")
    messages = customer_messages(event_stream(spark, root))
    live.start_ingest(messages, base, f"{base}/checkpoint", EVENTS_AS_OF, window_seconds=None).awaitTermination()
    good = tables.read_events(spark, f"{base}/events").groupBy("event_type", F.col("sentiment").alias("detail"))
    bad = spark.read.parquet(f"{base}/quarantine").groupBy("event_type", F.col("error").alias("detail"))
    count = F.count("*").alias("events")
    return good.agg(count).withColumn("sink", F.lit("events")).unionByName(
        bad.agg(count).withColumn("sink", F.lit("quarantine"))
    )


@query(
    "stream_window_counts",
    """SELECT strftime(time_bucket(INTERVAL 10 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
              count(*) AS events FROM events GROUP BY 1, 2""",
)
def stream_window_counts(spark, root):
    base = scratch(spark, "stream-windows")
    events = split_stream(spark, root, base).withColumnRenamed("ts", "event_timestamp")
    live.start_updates(live.window_counts(events), f"{base}/out", f"{base}/checkpoint", True).awaitTermination()
    return live.latest(spark, f"{base}/out", ["window_start", "event_type"], "events")


@query(
    "stream_metric_channels",
    """SELECT 'metrics:customer' AS channel, 'metric_update' AS type, event_type AS metric, count(*) AS value
       FROM events GROUP BY event_type""",
)
def stream_metric_channels(spark, root):
    base = scratch(spark, "stream-channels")
    counts = event_stream(spark, root).groupBy("event_type").agg(
        F.count("*").alias("value"), F.max("ts").alias("ts")
    )
    rows = live.channel_rows(
        counts.select(F.lit("customer").alias("domain"), F.col("event_type").alias("metric"), "value", "ts")
    ).withColumn("metric", F.get_json_object("data", "$.metric"))
    live.start_updates(rows, f"{base}/out", f"{base}/checkpoint", True).awaitTermination()
    newest = live.latest(spark, f"{base}/out", ["channel", "type", "metric"], "data")
    return newest.select("channel", "type", "metric", F.get_json_object("data", "$.value").cast("bigint").alias("value"))


@query(
    "csv_round_trip",
    over(
        f"""SELECT channel, count(*) AS events, sum(revenue * q) AS total_value
            FROM c WHERE NOT {ANY_SALE_ERROR} GROUP BY 1""",
        c=SALES_CHECKS,
    ),
)
def csv_round_trip(spark, root):
    """Write the landed sales as CSV by type, ingest the files, and total what is valid."""
    base = scratch(spark, "csv")
    write_csv_by_type(landed_sales(spark, root).withColumn("event_type", F.lit("sale")), base)
    rows = ingest.process_batch(read_csv_events(spark, f"{base}/event_type=sale", "sale"), SALES_AS_OF).events
    return ingest.silver(rows, "sale").groupBy("channel").agg(
        F.count("*").alias("events"), F.sum("total_value").alias("total_value")
    )


@query(
    "stream_odd_messages",
    f"""SELECT CASE WHEN k IN (6, 7) THEN 'events' ELSE 'quarantine' END AS sink, {ODD_ERRORS} AS error, count(*) AS events
        FROM ({ODD}) GROUP BY 1, 2""",
)
def stream_odd_messages(spark, root):
    """The same through the stream: what is refused reaches quarantine and the stream goes on."""
    base = scratch(spark, "stream-odd")
    messages = odd_messages(event_stream(spark, root))
    live.start_ingest(messages, base, f"{base}/checkpoint", EVENTS_AS_OF, window_seconds=None).awaitTermination()
    good = tables.read_events(spark, f"{base}/events").select(F.lit("events").alias("sink"), F.lit(None).cast("string").alias("error"))
    bad = spark.read.parquet(f"{base}/quarantine").select(F.lit("quarantine").alias("sink"), "error")
    return good.union(bad).groupBy("sink", "error").agg(F.count("*").alias("events"))
