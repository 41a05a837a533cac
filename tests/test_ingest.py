import json

import pytest
from pyspark.sql import functions as F

from metricmill.operators import ingest
from metricmill.plans import load_catalog
from metricmill.sources import files, registry
from metricmill.streaming import ingest as live

AS_OF = "2024-02-01"
GOOD_SALE = {"customer_id": "c", "product_id": "p", "revenue": "10.5", "quantity": "2", "channel": "web",
             "timestamp": "2024-01-06T10:30:00Z"}
BAD_SALES = {
    "customer_id: field required": {"customer_id": None},
    "product_id: field required": {"product_id": None},
    "revenue: must be greater than 0": {"revenue": "0"},
    "revenue: not a valid double": {"revenue": "much"},
    "quantity: must be greater than 0": {"quantity": "-1"},
    "quantity: not a valid int": {"quantity": "1.5"},
    "channel: field required": {"channel": "  "},
    "timestamp: not a valid timestamp": {"timestamp": "soon"},
    "timestamp: field required": {"timestamp": None},
}


def landed_rows(spark, items, kind):
    names = list(ingest.FIELDS)
    rows = [tuple(item.get(n) for n in names) for item in items]
    return ingest.landed(spark.createDataFrame(rows, ingest.LANDED), kind)


def test_each_sale_rule(spark):
    items = [GOOD_SALE] + [{**GOOD_SALE, **change} for change in BAD_SALES.values()]
    got = ingest.validate(landed_rows(spark, items, "sale"), AS_OF).collect()
    assert [list(r.errors) for r in got] == [[]] + [[e] for e in BAD_SALES]
    assert str(got[0].event_timestamp) == "2024-01-06 10:30:00"


@pytest.mark.parametrize(
    "kind, item, errors",
    [
        ("operation", {"inventory_level": "0", "product_id": "p", "warehouse_id": "w", "fulfillment_time_hours": "0"}, []),
        ("operation", {"inventory_level": "-1", "product_id": "p", "warehouse_id": "w", "fulfillment_time_hours": "-2"},
         ["inventory_level: must be at least 0", "fulfillment_time_hours: must be at least 0"]),
        ("customer", {"customer_id": "c", "event_type": "login"}, []),
        ("customer", {"customer_id": "c", "event_type": "login", "satisfaction_score": "", "nps_score": "10"}, []),
        ("customer", {"customer_id": "c", "event_type": "login", "satisfaction_score": "6", "nps_score": "11"},
         ["satisfaction_score: must be between 1 and 5", "nps_score: must be between 0 and 10"]),
        ("revenue", {"revenue_type": "churn", "amount": "-5"}, []),
        ("revenue", {"revenue_type": "churn", "amount": "-5", "arr": "-1"}, ["arr: must be at least 0"]),
        ("parcel", {"customer_id": "c"}, ["event_type: unknown value"]),
    ],
)
def test_other_types(spark, kind, item, errors):
    row = ingest.validate(landed_rows(spark, [{"timestamp": "1704537000", **item}], kind), AS_OF).first()
    assert list(row.errors) == errors
    assert str(row.event_timestamp) == ("2024-01-06 10:30:00" if kind != "parcel" else "2024-01-06 10:30:00")


def test_messages_nested_flat_and_broken(spark):
    lines = [
        json.dumps({"event_type": "sale", "data": GOOD_SALE}),
        json.dumps({**GOOD_SALE, "event_type": "sale", "revenue": 10.5, "quantity": 2, "timestamp": 1704537000}),
        json.dumps({"event_type": "customer", "data": {"customer_id": "c", "event_type": "login", "timestamp": "2024-01-06"}}),
        json.dumps({"type": "heartbeat", "timestamp": "2024-01-06T00:00:00Z"}),
        json.dumps({"note": "no type"}),
        "{broken",
    ]
    checked = ingest.validate(ingest.parse_messages(spark.createDataFrame([(x,) for x in lines], "value string")), AS_OF)
    got = {r.event: r for r in checked.collect()}
    assert [list(got[x].errors) for x in lines] == [[], [], [], [], ["event_type: field required"], ["event_type: field required"]]
    assert got[lines[2]].record.event_type == "login" and got[lines[2]].event_type == "customer"
    assert got[lines[0]].record.revenue == got[lines[1]].record.revenue == 10.5
    assert str(got[lines[4]].event_timestamp) == "2024-02-01 00:00:00"
    assert got[lines[5]].raw_data == "{broken" and got[lines[5]].event_type == "system"


def test_enrichment(spark):
    sale = ingest.silver(ingest.enrich(ingest.validate(landed_rows(spark, [GOOD_SALE], "sale"), AS_OF), AS_OF), "sale").first()
    assert (sale.total_value, sale.hour, sale.day_of_week, sale.is_weekend, sale.domain) == (21.0, 10, 5, True, "sales")
    people = [{"customer_id": "c", "event_type": "review", "timestamp": "2024-01-06", "satisfaction_score": s, "nps_score": n}
              for s, n in [("4", "9"), ("3", "7"), ("2", "6"), (None, None)]]
    got = ingest.silver(ingest.enrich(ingest.validate(landed_rows(spark, people, "customer"), AS_OF), AS_OF), "customer").collect()
    assert [(r.sentiment, r.nps_category) for r in got] == [
        ("positive", "promoter"), ("neutral", "passive"), ("negative", "detractor"), (None, None)
    ]


def test_ids_are_deterministic_and_differ(spark):
    items = [GOOD_SALE, GOOD_SALE, {**GOOD_SALE, "quantity": "3"}]
    ids = [r.event_id for r in ingest.enrich(ingest.validate(landed_rows(spark, items, "sale"), AS_OF), AS_OF).collect()]
    assert ids[0] == ids[1] != ids[2] and all(i.startswith("evt_") and len(i) == 20 for i in ids)


def test_batch_counts_stats_and_strict(spark):
    items = [GOOD_SALE] * 3 + [{**GOOD_SALE, "revenue": "-1"}]
    events = landed_rows(spark, items, "sale")
    result = ingest.process_batch(events, AS_OF)
    assert result.events.count() == 3
    assert result.counts.get == {"received": 4, "processed": 3, "failed": 1}
    refused = result.invalid.first()
    assert refused.error == "revenue: must be greater than 0" and '"revenue":"-1"' in refused.event
    stats = ingest.validation_stats(ingest.validate(events, AS_OF)).first()
    assert (stats.total, stats.valid, stats.invalid, stats.valid_rate) == (4, 3, 1, 75.0)
    assert ingest.validation_stats(ingest.validate(events.limit(0), AS_OF)).first().valid_rate == 0
    with pytest.raises(Exception, match="must be greater than 0"):
        ingest.require_valid(ingest.validate(events, AS_OF)).collect()
    assert ingest.require_valid(ingest.validate(events.limit(3), AS_OF)).count() == 3


def test_types_are_validated_apart_and_joined_after(spark):
    person = {"customer_id": "c", "event_type": "login", "timestamp": "2024-01-06"}
    frames = [
        ingest.validate(landed_rows(spark, [item, {}], kind), AS_OF)
        for kind, item in (("sale", GOOD_SALE), ("customer", person))
    ]
    good = [ingest.enrich(ingest.valid_rows(f), AS_OF) for f in frames]
    assert sorted(r.domain for r in good[0].unionByName(good[1]).collect()) == ["customer", "sales"]
    bad = [ingest.invalid_rows(f) for f in frames]
    assert bad[0].unionByName(bad[1]).count() == 2


def test_csv_blanks_and_column_order(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "event_type,customer_id,nps_score,satisfaction_score,timestamp\nlogin,c1,,4,2024-01-06 10:00:00\nlogin,,3,4.0,1704537000\n"
    )
    rows = files.ingest_from(spark, {"type": "csv", "path": str(tmp_path / "c.csv"), "event_type": "customer"})
    got = ingest.validate(rows, AS_OF).collect()
    assert [list(r.errors) for r in got] == [[], ["customer_id: field required"]]
    assert got[0].record.nps_score is None and got[1].record.satisfaction_score == 4


def test_json_payload_list_and_lone_object(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [GOOD_SALE, {**GOOD_SALE, "quantity": 5}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"data": GOOD_SALE}))
    rows = files.ingest_from(spark, {"type": "api", "path": str(tmp_path), "event_type": "sale"})
    assert sorted(r.record.quantity for r in ingest.validate(rows, AS_OF).collect()) == [2, 2, 5]


def test_responses_have_a_size_of_their_own(spark, tmp_path):
    """However many rows a table has, a landed response holds so many items; a lone one is an object."""
    load_catalog()
    from metricmill.plans.state_queries import response_pages

    rows = spark.range(0, 2500, numPartitions=2).select(*[
        F.lit(str(v)).alias(k) if k != "quantity" else (F.col("id") + 1).cast("string").alias(k) for k, v in GOOD_SALE.items()
    ], F.lit(None).cast("string").alias("arr"))
    response_pages(rows, 400).write.option("maxRecordsPerFile", 1).text(str(tmp_path / "r"))
    held = [json.loads(r.value)["data"] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert sorted(1 if isinstance(x, dict) else len(x) for x in held) == sorted(2 * [1, 400, 400, 400, 49])
    read = files.ingest_from(spark, {"type": "api", "path": str(tmp_path / "r"), "event_type": "sale"})
    assert sorted(int(r.q) for r in read.select(F.col("payload.quantity").alias("q")).collect()) == list(range(1, 2501))


def test_source_errors(spark):
    with pytest.raises(ValueError, match="unknown source"):
        files.ingest_from(spark, {"type": "queue"})
    with pytest.raises(ValueError, match="path"):
        files.ingest_from(spark, {"type": "csv"})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("sale", 1), ("customer", 2)], "event_type string, n int")
    files.write_json_by_type(df, str(tmp_path / "j"))
    files.write_csv_by_type(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j" / "event_type=sale")).first().n == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    targets = files.export_tables({"stores": df, "menu": df.limit(1)}, str(tmp_path / "x"))
    assert set(targets) == {"stores", "menu"} and spark.read.json(targets["menu"]).count() == 1


def test_registry(spark):
    spark.range(3).createOrReplaceTempView("raw_events")
    spark.range(5).createOrReplaceTempView("sales_events")
    assert registry.domain_events(spark, "sale").count() == 5
    assert registry.domain_events(spark, "weather").count() == 3
    assert registry.metric_table("customers") == "metrics_customers" and registry.metric_table("x") == "raw_events"
    kept = registry.query(spark, "SELECT id FROM sales_events WHERE id >= :low", {"low": 3}, keep=True)
    assert kept.count() == 2 and kept.is_cached
    kept.unpersist()


def _messages(n=40):
    out = []
    for i in range(n):
        out.append(json.dumps({"event_type": "customer", "data": {
            "customer_id": f"c{i}", "event_type": "login", "satisfaction_score": i % 7, "timestamp": f"2024-01-06T10:00:{i:02d}Z"}}))
    return out + ["{broken", json.dumps({"event_type": "parcel"})]


def test_stream_equals_batch_and_restarts_without_repeats(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    lines = _messages()
    (source / "1.txt").write_text("\n".join(lines[:20]) + "\n")
    seen = []

    def run():
        query = live.start_ingest(
            live.read_message_files(spark, str(source), 1), target, checkpoint, AS_OF, window_seconds=None,
            on_batch=lambda df, i: seen.append((i, df.count())),
        )
        query.awaitTermination()
        return query

    run()
    first = live.ingest_counters(spark, target).first()
    assert first.received == 20 and first.processed + first.failed == 20
    (source / "2.txt").write_text("\n".join(lines[20:]) + "\n")
    run()
    run()  # nothing new
    batch = ingest.validate(ingest.parse_messages(spark.createDataFrame([(x,) for x in lines], "value string")), AS_OF)
    streamed = spark.read.parquet(f"{target}/events")
    expected = ingest.enrich(ingest.valid_rows(batch), AS_OF)
    assert sorted(r.event_id for r in streamed.collect()) == sorted(r.event_id for r in expected.collect())
    refused = spark.read.parquet(f"{target}/quarantine")
    assert sorted((r.event, r.error) for r in refused.collect()) == sorted(
        (r.event, r.error) for r in ingest.invalid_rows(batch).collect()
    )
    assert streamed.count() + refused.count() == len(lines)
    assert [i for i, _ in seen] == [0, 1]


def test_windows_updates_and_repeats(spark, tmp_path):
    source = tmp_path / "in"
    events = spark.createDataFrame(
        [("e1", "sale", "2024-01-06 10:00:01"), ("e1", "sale", "2024-01-06 10:00:01"), ("e2", "sale", "2024-01-06 10:00:12"),
         ("e3", "customer", "2024-01-06 10:00:13")], "event_id string, event_type string, t string",
    ).select("event_id", "event_type", F.col("t").cast("timestamp").alias("event_timestamp"))
    events.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    live.start_updates(live.window_counts(stream), str(tmp_path / "w"), str(tmp_path / "wc"), True).awaitTermination()
    got = live.latest(spark, str(tmp_path / "w"), ["window_start", "event_type"], "events").collect()
    assert sorted((str(r.window_start)[-8:], r.event_type, r.events) for r in got) == [
        ("10:00:00", "sale", 2), ("10:00:10", "customer", 1), ("10:00:10", "sale", 1)
    ]
    live.start_updates(live.without_repeats(stream), str(tmp_path / "d"), str(tmp_path / "dc"), True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3


def test_channel_rows(spark):
    metrics = spark.createDataFrame([("sales", "revenue", 5.0)], "domain string, metric string, value double").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp"))
    alerts = spark.createDataFrame([('{"a":1}',)], "payload string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = live.channel_rows(metrics, alerts).collect()
    assert [(r.channel, r.type) for r in got] == [("metrics:sales", "metric_update"), ("alerts", "alert")]
    assert json.loads(got[0].data)["metric"] == "revenue"


def test_event_tables_prune_days_and_replay(spark, tmp_path):
    from metricmill.sources import tables

    rows = spark.range(4000).select(
        F.col("id").alias("n"), F.expr("timestamp'2024-01-01' + make_dt_interval(0, cast(id % 240 as int))").alias("event_timestamp")
    )
    path = str(tmp_path / "events")
    for batch in (1, 2, 1):
        tables.write_events(rows.filter(F.col("n") % 2 == batch % 2), path, batch)
    tables.compact(spark, path, f"{path}-compact")
    for place in (path, f"{path}-compact"):
        recent = tables.read_events(spark, place, "2024-01-11", 2)
        assert recent.count() == rows.filter("event_timestamp >= '2024-01-09'").count()
        plan = recent._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in plan
    assert tables.read_events(spark, path).count() == 4000
    tables.write_daily_metrics(spark, path, f"{path}-days", [], {"total": "n"})
    before = {r.event_date: r.total for r in tables.read_daily_metrics(spark, f"{path}-days").collect()}
    touched = spark.read.parquet(path).filter("event_date = '2024-01-03'")
    tables.write_daily_metrics(spark, path, f"{path}-days", [], {"total": "n"}, touched)
    assert {r.event_date: r.total for r in tables.read_daily_metrics(spark, f"{path}-days").collect()} == before
    assert tables.read_daily_metrics(spark, f"{path}-days", "2024-01-11", 3).count() == 3


def test_numbers_beyond_their_type_are_findings(spark):
    def errors(**fields):
        data = {"customer_id": "c", "product_id": "p", "revenue": 1.5, "quantity": 2, "channel": "x", "timestamp": 1_700_000_000} | fields
        text = json.dumps({"event_type": "sale", "data": data})
        return ingest.validate(ingest.parse_messages(spark.createDataFrame([(text,)], "value string")), AS_OF).first()

    assert errors().errors == []
    for odd in (float("nan"), float("inf"), "NaN", "1e400"):
        assert errors(revenue=odd).errors == ["revenue: not a valid double"]
    for odd in ("1.5", "", 10**12):
        assert errors(quantity=odd).errors == ["quantity: not a valid int"]
    for odd in ("2024", 10**19, "99999999999999999999", -(10**15)):
        assert errors(timestamp=odd).errors == ["timestamp: not a valid timestamp"]
    assert str(errors(timestamp="2024-01-05T10:00:00Z").event_timestamp) == "2024-01-05 10:00:00"


def test_ids_do_not_depend_on_the_fallback_time(spark):
    text = json.dumps({"event_type": "system"})
    parsed = ingest.parse_messages(spark.createDataFrame([(text,)], "value string"))
    ids = {ingest.enrich(ingest.validate(parsed, day), day).first().event_id for day in ("2024-01-01", "2024-02-01")}
    assert len(ids) == 1


def test_split_stream_keeps_its_batches_and_adds_files(spark, tmp_path):
    """A larger feed has more files a batch, so more tasks; the number of batches stays."""
    load_catalog()
    from metricmill.plans.ingest_queries import split_stream

    root, base, seen = "/root/testdata/sf0.001", str(tmp_path / "s"), []
    whole = spark.read.parquet(f"{root}/events.parquet")
    stream = split_stream(spark, root, base, 3, max(1, whole.count() // 12))
    take = lambda batch, _: seen.append((batch.select(F.input_file_name()).distinct().count(), {r.event_id for r in batch.collect()}))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and all(files >= 4 for files, _ in seen)
    assert sum(len(ids) for _, ids in seen) == whole.count() == len(set().union(*[ids for _, ids in seen]))
