"""Day-partitioned event and metric tables, file sources, and operators no other query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricmill.functions.scalars import shortened
from metricmill.operators import ingest, orders
from metricmill.operators import recommend as rec
from metricmill.operators.detect import detect
from metricmill.plans.catalog import EVENTS_AS_OF, SALES_AS_OF, over, query, within
from metricmill.plans.ingest_queries import ANY_SALE_ERROR, SALES_CHECKS, landed_sales
from metricmill.plans.recommendation_queries import EVENT_Z, recommendations, recs_sql
from metricmill.plans.series_queries import HOURLY, INDEXED, event_series
from metricmill.session import scratch
from metricmill.sources import star, tables
from metricmill.sources.files import export_tables, ingest_from, write_csv_by_type, write_json_by_type
from metricmill.sources.registry import metric_table, register
from metricmill.sources.registry import query as ask


def customer_table(spark, root):
    """The customer feed written in two batches, the first of them twice, then compacted."""
    base = scratch(spark, "silver")
    events = star.customer_events(spark, root)
    first = F.pmod(F.col("customer_id"), F.lit(2)) == 0
    for batch, part in ((1, events.filter(first)), (2, events.filter(~first)), (1, events.filter(first))):
        tables.write_events(part, f"{base}/events", batch)
    tables.compact(spark, f"{base}/events", f"{base}/compact")
    return base


@query(
    "silver_customer_events",
    over(
        f"""SELECT event_type, count(*) AS events, CAST(sum(satisfaction_score) AS BIGINT) AS satisfaction FROM customer_events
            WHERE {within(7, EVENTS_AS_OF)} GROUP BY 1""",
        "customer_events",
    ),
)
def silver_customer_events(spark, root):
    base = customer_table(spark, root)
    rows = tables.read_events(spark, f"{base}/compact", EVENTS_AS_OF, 7)
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("satisfaction_score").alias("satisfaction"))


@query(
    "gold_customer_days",
    over(
        """SELECT strftime(event_timestamp, '%Y-%m-%d') AS event_date, event_type, count(*) AS events,
                  CAST(sum(satisfaction_score) AS DOUBLE) AS satisfaction
           FROM customer_events GROUP BY 1, 2""",
        "customer_events",
    ),
)
def gold_customer_days(spark, root):
    """Daily metrics from both batches, then the days of one batch computed anew."""
    base = customer_table(spark, root)
    measures = {"satisfaction": "satisfaction_score"}
    tables.write_daily_metrics(spark, f"{base}/events", f"{base}/gold", ["event_type"], measures)
    touched = spark.read.parquet(f"{base}/events").filter("batch = '2' and event_date >= '2024-01-20'")
    tables.write_daily_metrics(spark, f"{base}/events", f"{base}/gold", ["event_type"], measures, touched)
    return tables.read_daily_metrics(spark, f"{base}/gold").select("event_date", "event_type", "events", "satisfaction")


SALE_TOTALS = over(
    f"SELECT channel, count(*) AS events, sum(revenue * q) AS total_value FROM c WHERE NOT {ANY_SALE_ERROR} GROUP BY 1",
    c=SALES_CHECKS,
)


@query(
    "landed_batch",
    over(
        f"""SELECT 'valid' AS sink, count(*) AS events FROM c WHERE NOT {ANY_SALE_ERROR}
            UNION ALL SELECT 'refused', count(*) FROM c WHERE {ANY_SALE_ERROR}""",
        c=SALES_CHECKS,
    ),
)
def landed_batch(spark, root):
    """Checked once into a landing folder; both sinks read it."""
    rows = ingest.landed(landed_sales(spark, root), "sale")
    done = ingest.process_batch(rows, SALES_AS_OF, scratch(spark, "landing"))
    sinks = [f.agg(F.lit(n).alias("sink"), F.count("*").alias("events")) for n, f in (("valid", done.events), ("refused", done.invalid))]
    return sinks[0].union(sinks[1])


def sale_totals(rows):
    events = ingest.process_batch(rows, SALES_AS_OF).events
    return ingest.silver(events, "sale").groupBy("channel").agg(
        F.count("*").alias("events"), F.sum("total_value").alias("total_value")
    )


@query("json_by_type", SALE_TOTALS)
def json_by_type(spark, root):
    """Sales written as JSON by type and read back as landed rows."""
    base = scratch(spark, "json")
    write_json_by_type(landed_sales(spark, root).withColumn("event_type", F.lit("sale")), base)
    return sale_totals(ingest.landed(spark.read.json(f"{base}/event_type=sale"), "sale"))


@query("described_csv_source", SALE_TOTALS)
def described_csv_source(spark, root):
    base = scratch(spark, "csv-source")
    write_csv_by_type(landed_sales(spark, root).withColumn("event_type", F.lit("sale")), base)
    return sale_totals(ingest_from(spark, {"type": "csv", "event_type": "sale", "path": f"{base}/event_type=sale"}))


@query(
    "exported_tables",
    "SELECT 'nation' AS name, count(*) AS records FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier",
)
def exported_tables(spark, root):
    base = scratch(spark, "export")
    frames = {name: star.table(spark, root, name) for name in ("nation", "supplier")}
    paths = export_tables(frames, base)
    counts = [spark.read.json(path).agg(F.lit(name).alias("name"), F.count("*").alias("records")) for name, path in paths.items()]
    return counts[0].union(counts[1])


@query(
    "registry_sql",
    over(
        """SELECT channel, count(*) AS events FROM sales_events WHERE channel IN ('1-URGENT', '5-LOW') GROUP BY 1""",
        "sales_events",
    ),
)
def registry_sql(spark, root):
    """SQL with bound parameters over a registered metric table."""
    register({metric_table("sale"): star.sales_events(spark, root)})
    sql = f"SELECT channel, count(*) AS events FROM {metric_table('sales')} WHERE channel IN (:a, :b) GROUP BY channel"
    return ask(spark, sql, {"a": "1-URGENT", "b": "5-LOW"})


@query(
    "strict_validation",
    over(f"SELECT channel, count(*) AS events FROM c WHERE NOT {ANY_SALE_ERROR} GROUP BY 1", c=SALES_CHECKS),
)
def strict_validation(spark, root):
    """Strict mode over rows that are known to be valid; a refused row would fail the job."""
    checked = ingest.validate(ingest.landed(landed_sales(spark, root), "sale"), SALES_AS_OF)
    rows = ingest.require_valid(ingest.valid_rows(checked))
    return rows.groupBy(F.col("record.channel").alias("channel")).agg(F.count("*").alias("events"))


@query(
    "recommendation_page_total",
    recs_sql(
        """SELECT recommendation_id, composite_score, (SELECT count(*) FROM r) AS total
           FROM r ORDER BY composite_score DESC, recommendation_id LIMIT 25 OFFSET 25"""
    ),
)
def recommendation_page_total(spark, root):
    rows = rec.page_with_total(recommendations(spark, root), 25, 25)
    return rows.select("recommendation_id", "composite_score", "total")


@query(
    "order_item_totals",
    """SELECT p_name AS name, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity, count(*) AS lines
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def order_item_totals(spark, root):
    """Orders with their items nested as the source holds them, flattened again and added up."""
    lines, part = star.table(spark, root, "lineitem"), star.table(spark, root, "part")
    item = F.struct(
        F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("name"),
        F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("bigint").alias("price"),
    )
    # An order has seven lines at most.
    nested = lines.join(part, lines.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.collect_list(item).alias("items")
    )
    flat = orders.order_items(nested)
    return flat.groupBy("name").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("lines"))


@query(
    "truncated_titles",
    recs_sql("SELECT recommendation_id, CASE WHEN length(d) > 500 THEN left(d, 497) || '...' ELSE d END AS text "
             "FROM (SELECT recommendation_id, repeat(title || ' ', 20 + k % 30) AS d FROM r)"),
)
def truncated_titles(spark, root):
    rows = recommendations(spark, root)
    long = F.expr("repeat(concat(title, ' '), cast(20 + order_key % 30 as int))")
    return rows.select("recommendation_id", shortened(long, 500).alias("text"))


@query(
    "detected_by_method",
    over(
        """SELECT asked, 'z_score' AS method, series_key, count(*) AS anomalies FROM z, (VALUES ('z_score'), ('other')) v(asked)
           WHERE n >= 4 AND z > 2.5 GROUP BY 1, 3""",
        s=HOURLY, i=INDEXED, z=EVENT_Z.replace("FROM s", "FROM i"),
    ),
)
def detected_by_method(spark, root):
    """One call for all methods; an unknown one means z-scores."""
    series = event_series(spark, root)
    found = [detect(series, name).select("series_key", "method", F.lit(name).alias("asked")) for name in ("z_score", "other")]
    return found[0].union(found[1]).groupBy("asked", "method", "series_key").agg(F.count("*").alias("anomalies"))
