import pytest

from metricmill.operators import customers, metrics, operations, orders, revenue, sales

AS_OF = "2024-04-01"
SALE = "customer_id string, product_id string, purchase_id long, channel string, event_timestamp timestamp, revenue double, quantity double"


@pytest.fixture
def sale(frame):
    def build(*items):
        return frame([(c, p, i, "web", t, float(r), float(q)) for i, (c, p, t, r, q) in enumerate(items)], SALE)

    return build


def test_churn_scores_and_threshold(sale, rows):
    df = sale(
        ("same_day", "p", "2024-03-01", 500, 1), ("same_day", "p", "2024-03-01", 500, 1),      # 0.4 + 0.2
        ("exact", "p", "2024-01-10", 50, 1), ("exact", "p", "2024-01-11", 50, 1), ("exact", "p", "2024-01-12", 50, 1),  # 0.4 + 0.1
        ("loyal", "p", "2024-03-20", 500, 1), ("loyal", "p", "2024-03-30", 500, 1),            # 0.2
        ("once", "p", "2024-01-20", 10, 1),
        ("old", "p", "2023-01-01", 10, 1), ("old", "p", "2023-01-02", 10, 1),
    )
    got = rows(sales.churn_risk(df, AS_OF, top=10), "customer_id")
    assert set(got) == {"same_day", "exact"}
    assert got["same_day"]["risk_score"] == pytest.approx(0.6)
    assert got["same_day"]["avg_interval_days"] == 0
    assert got["exact"]["risk_score"] == pytest.approx(0.5)
    assert sales.churn_risk(df, AS_OF, customer_id="exact", top=10).count() == 1
    assert sales.churn_risk(df, AS_OF, top=1).first().customer_id == "same_day"


def test_upsell_counts_distinct_products(sale):
    df = sale(*[("a", f"p{i % 2}", "2024-03-01", 100, 1) for i in range(4)], ("b", "p", "2024-03-01", 100, 1))
    row = sales.upsell_opportunities(df, AS_OF, 20).collect()
    assert [(r.customer_id, r.purchase_count, r.products_purchased) for r in row] == [("a", 4, 2)]
    assert row[0].opportunity_score == pytest.approx((0.4 + 0.8) / 2)


def test_stockout(frame, sale):
    stock = frame([("p1", "2024-03-30", 10), ("p2", "2024-03-30", 1000), ("p3", "2024-03-30", 1)],
                  "product_id string, event_timestamp timestamp, inventory_level int")
    df = sale(("a", "p1", "2024-03-15", 1, 60), ("a", "p2", "2024-03-15", 1, 30))
    got = operations.stockout_risk(stock, df, AS_OF).collect()
    assert [(r.product_id, r.days_until_stockout, r.urgency, r.suggested_action) for r in got] == [
        ("p1", 5.0, "medium", "Reorder within 5 days")
    ]
    assert got[0].risk_score == pytest.approx(1 - 5 / 7)


def test_inventory_levels_formulas(sale):
    df = sale(("a", "p", "2024-03-01", 1, 10), ("a", "p", "2024-03-02", 1, 20), ("a", "q", "2024-03-02", 1, 4))
    got = {r.product_id: r for r in operations.inventory_levels(df, AS_OF).collect()}
    assert got["p"].safety_stock == pytest.approx(1.6448536 * 7.0710678 * 7**0.5, rel=1e-6)
    assert got["p"].reorder_point == pytest.approx(15 * 7 + got["p"].safety_stock)
    assert got["q"].safety_stock == 0
    assert got["q"].economic_order_quantity == pytest.approx((2 * 4 * 365 * 50 / 2) ** 0.5)


def _shipping(frame, items):
    return frame(items, "warehouse_id string, event_timestamp timestamp, fulfillment_time_hours double")


def test_disruption_with_flat_baseline_has_no_z(frame):
    df = _shipping(frame, [("w", "2024-03-10", 24.0), ("w", "2024-03-11", 24.0), ("w", "2024-03-30", 100.0),
                           ("v", "2024-03-30", 100.0)])
    got = operations.supply_disruptions(df, AS_OF).collect()
    assert [(r.warehouse_id, r.increase_hours, r.z_score, r.severity) for r in got] == [("w", 76.0, None, "low")]


def test_bottlenecks_need_ten_orders(frame):
    items = [("fast", f"2024-03-{d:02d}", 10.0) for d in range(10, 20)]
    items += [("mid", f"2024-03-{d:02d}", 12.0) for d in range(10, 20)]
    items += [("slow", f"2024-03-{d:02d}", 50.0 + d) for d in range(10, 20)]
    items += [("few", f"2024-03-{d:02d}", 900.0) for d in range(10, 19)]
    got = operations.bottlenecks(_shipping(frame, items), AS_OF).collect()
    assert [(r.warehouse_id, r.order_count, r.median_time, r.percent_of_slowest) for r in got] == [("slow", 10, 64.5, 100.0)]
    assert got[0].p95_time == pytest.approx(68.55)


def test_value_segments_do_not_multiply_by_events(frame, sale, rows):
    activity = frame([(f"c{i}", "2024-03-01") for i in range(10)] * 3, "customer_id string, event_timestamp timestamp")
    df = sale(*[(f"c{i}", "p", "2024-03-01", (10 - i) * 100, 1) for i in range(9)])
    got = rows(customers.value_segments(activity, df, (AS_OF, AS_OF)), "segment")
    assert {k: v["count"] for k, v in got.items()} == {"high_value": 3, "medium_value": 4, "low_value": 3}
    assert got["high_value"]["total_revenue"] == 2700
    assert sum(v["total_revenue"] for v in got.values()) == sum((10 - i) * 100 for i in range(9))


def test_behavior_segments(frame, rows):
    def made(name, **kinds):
        return [(name, k, "2024-03-01", s) for k, (n, s) in kinds.items() for _ in range(n)]

    df = frame(
        made("power", login=(20, None), purchase=(5, 5)) + made("regular", login=(5, None), purchase=(1, 5))
        + made("risk", support=(4, 5), review=(1, 5)) + made("mute", review=(5, None)) + made("calm", review=(5, 4))
        + made("small", login=(4, None)),
        "customer_id string, event_type string, event_timestamp timestamp, satisfaction_score int",
    )
    got = rows(customers.behavior_segments(df, AS_OF), "segment")
    assert {k: v["count"] for k, v in got.items()} == {"power_users": 1, "regular_users": 1, "at_risk": 2, "dormant": 1}


def test_lifecycle_segments(frame, rows):
    df = frame(
        [("new", "2024-03-10"), ("active", "2024-02-01"), ("active", "2024-03-20"), ("mature", "2023-11-01"),
         ("mature", "2024-03-30"), ("gone", "2023-12-01"), ("gone", "2024-01-01"), ("ancient", "2023-01-01")],
        "customer_id string, event_timestamp timestamp",
    )
    got = rows(customers.lifecycle_segments(df, AS_OF), "segment")
    assert {k: v["count"] for k, v in got.items()} == {"new": 1, "active": 1, "mature": 1, "churned": 1}


@pytest.mark.parametrize(
    "days, trend, level",
    [([3] * 6, "insufficient_data", "poor"), ([3] * 7, "insufficient_data", "poor"),
     ([3] * 7 + [4] * 7, "improving", "satisfactory"), ([5] * 3 + [3] * 7, "declining", "satisfactory"),
     ([5] * 14, "stable", "excellent")],
)
def test_sentiment(frame, days, trend, level):
    df = frame([("c", f"2024-03-{i + 10:02d}", s, None) for i, s in enumerate(days)],
               "customer_id string, event_timestamp timestamp, satisfaction_score int, nps_score int")
    row = customers.sentiment_summary(df, AS_OF).first()
    assert (row.trend, row.sentiment_level, row.total_responses) == (trend, level, len(days))
    assert row.overall_nps is None


def test_sentiment_without_answers_is_empty(frame):
    df = frame([("c", "2024-03-10", None, 4)],
               "customer_id string, event_timestamp timestamp, satisfaction_score int, nps_score int")
    assert customers.sentiment_summary(df, AS_OF).count() == 0


def _money(frame, items):
    return frame(items, "customer_id string, event_timestamp timestamp, revenue_type string, amount double")


def test_streams_and_concentration(frame, rows):
    df = _money(frame, [("a", "2024-03-20", "recurring", 60.0), ("a", "2024-03-21", "one_time", 30.0),
                        ("b", "2024-03-22", "expansion", 10.0)])
    streams = revenue.revenue_streams(df, AS_OF)
    got = rows(streams, "revenue_type")
    assert [got[k]["concentration_risk"] for k in ("recurring", "one_time", "expansion")] == ["high", "medium", "low"]
    assert got["recurring"]["stddev_transaction"] == 0
    row = revenue.revenue_concentration(streams).first()
    assert row.hhi == pytest.approx(4600) and row.concentration_level == "high" and row.diversification_score == 0
    assert revenue.revenue_concentration(streams.limit(0)).count() == 0


@pytest.mark.parametrize(
    "expansion, churn, level", [(25, 0, "excellent"), (10, 0, "good"), (0, 0, "healthy"), (0, -10, "concerning"), (0, -11, "critical")]
)
def test_retention_levels(frame, expansion, churn, level):
    df = _money(frame, [("a", "2024-03-20", "recurring", 100.0), ("a", "2024-03-20", "expansion", float(expansion)),
                        ("a", "2024-03-20", "churn", float(churn)), ("b", "2024-03-20", "churn", -500.0)])
    row = revenue.net_revenue_retention(df, AS_OF).first()
    assert row.nrr_level == level and row.customer_count == 1 and len(row.recommended_actions) == 3


def test_pricing(sale):
    df = sale(("a", "p", "2024-03-01", 10, 1), ("a", "p", "2024-03-01", 40, 2), ("a", "p", "2024-03-02", 20, 1),
              ("a", "single", "2024-03-01", 10, 1), ("a", "free", "2024-03-01", 10, 0))
    points = {(r.product_id, r.effective_price): r.total_quantity for r in revenue.price_points(df, AS_OF).collect()}
    assert points == {("p", 10.0): 1, ("p", 20.0): 3, ("single", 10.0): 1}
    assert revenue.pricing_opportunities(df, AS_OF).count() == 0  # quantities differ by half their mean
    flat = sale(("a", "p", "2024-03-01", 10, 1), ("a", "p", "2024-03-01", 20, 1))
    assert revenue.pricing_opportunities(flat, AS_OF).first().confidence == 1


def test_metric_anomalies_without_spread(frame):
    flat = frame([(f"2024-03-{d:02d}", 5.0) for d in range(1, 30)], "date string, v double")
    assert metrics.metric_anomalies(flat, "v", AS_OF).count() == 0
    spike = flat.unionByName(frame([("2024-03-31", 500.0)], "date string, v double"))
    assert [r.date for r in metrics.metric_anomalies(spike, "v", AS_OF).collect()] == ["2024-03-31"]


def test_periods_and_kpis_with_an_empty_side(sale, rows):
    df = sale(("a", "p", "2024-03-30", 10, 1), ("a", "p", "2024-03-30", 30, 1))
    got = rows(metrics.compare_periods(df, ["revenue"], AS_OF), "period")
    assert got["current"]["revenue"] == 20 and got["previous"]["revenue"] is None
    kpi = metrics.kpi_delta(df, {"total": ("revenue", "sum")}, AS_OF).first()
    assert kpi.current_value == 40 and kpi.percent_change is None and kpi.trend == "down"


def test_column_summary(spark, rows):
    df = spark.createDataFrame([(1, 2.0, None, "x"), (2, None, None, "y"), (9, 4.0, None, "z")],
                               "a int, b double, c double, s string")
    got = rows(metrics.column_summary(df), "column")
    assert got["a"]["median"] == 2 and got["a"]["row_count"] == 3 and got["b"]["non_null"] == 2
    assert got["b"]["median"] == 3 and got["c"]["mean"] is None and got["c"]["median"] is None
    one = rows(metrics.column_summary(df.limit(1)), "column")
    assert one["a"]["std"] == 0


def test_key_filter_and_unknown_aggregate(sale):
    df = sale(("a", "p", "2024-03-30", 10, 1), ("b", "q", "2024-03-30", 30, 1))
    got = metrics.analytics_query(df, "revenue", AS_OF, filters={"product_id": "q"}, group_by=["channel"]).collect()
    assert [(r["count"], r["avg"]) for r in got] == [(1, 30.0)]
    with pytest.raises(ValueError):
        metrics.analytics_query(df, "revenue", AS_OF, aggregations=["guess"])
    assert operations.stockout_risk(
        df.withColumnRenamed("quantity", "inventory_level"), df, AS_OF, product_id="q"
    ).count() == 0


def test_order_analytics(spark):
    schema = (
        "order_id string, customer_id string, store_id string, channel string, order_type string, "
        "items array<struct<item_id: string, name: string, name_en: string, quantity: int, price: bigint>>, "
        "subtotal bigint, tax bigint, fee bigint, total_idr bigint, payment string, order_status string, "
        "order_timestamp timestamp, minutes int"
    )

    def order(i, channel, status, hour, items, total):
        return (str(i), f"c{i}", "s1", channel, "delivery", items, total, 0, 0, total, "cash", status, None, 5), hour

    made = [
        order(1, "app", "completed", "2024-03-01 12:00:00", [("m1", "Nasi", "Rice", 2, 10), ("m2", "Teh", "Tea", 1, 5)], 100),
        order(2, "app", "cancelled", "2024-03-01 12:30:00", [("m2", "Teh", "Tea", 4, 5)], 50),
        order(3, "web", "completed", "2024-03-01 18:00:00", [("m1", "Nasi", "Rice", 1, 10)], 20),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([m for m, _ in made], schema)
    stamps = F.create_map(*[F.lit(x) for i, (_, h) in enumerate(made) for x in (str(i + 1), h)])
    df = df.withColumn("order_timestamp", stamps[F.col("order_id")].cast("timestamp"))
    totals = orders.order_totals(df).first()
    assert (totals.total_revenue_idr, totals.total_orders, totals.average_order_value) == (120, 3, 40.0)
    assert [(r.hour, r.orders) for r in orders.peak_hours(df, 5).collect()] == [(12, 2), (18, 1)]
    assert [(r.name, r.quantity) for r in orders.popular_items(orders.order_items(df), 10).collect()] == [("Teh", 5), ("Nasi", 3)]
    events = orders.orders_to_events(df)
    sale = events.filter("event_type = 'sale'")
    assert sale.count() == 3 and '"items":[{"item_id":"m1"' in sale.orderBy("event_id").first().data
    assert events.filter("event_type = 'customer'").count() <= 3
    assert orders.order_totals(df.limit(0)).first().average_order_value == 0
