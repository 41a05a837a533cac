import itertools

import pytest
from pyspark.sql import functions as F

from metricmill.functions.texts import OPPOSING_WORDS
from metricmill.operators import actions, alerts, conflicts, scenario
from metricmill.operators import recommend as rec

AS_OF = "2024-03-10"
SCHEMA = ("recommendation_id string, title string, domain string, confidence double, impact string, urgency string, "
          "effort string, composite_score double, stakeholders array<string>, tags map<string,string>, status string, "
          "created_at timestamp, updated_at timestamp")


@pytest.fixture
def recs(frame):
    def build(*items):
        base = {"title": "t", "domain": "sales", "confidence": 0.8, "impact": "low", "urgency": "low", "effort": "easy",
                "composite_score": 0.5, "stakeholders": [], "tags": {}, "status": "pending",
                "created_at": "2024-03-01", "updated_at": "2024-03-01"}
        names = [part.split()[0] for part in SCHEMA.replace("map<string,string>", "m").split(", ")]
        made = [{**base, **item} for item in items]
        return frame([tuple(m[n] for n in names) for m in made], SCHEMA).withColumn(
            "source", F.struct(F.col("domain").alias("agent_type"))
        )

    return build


def ids(df):
    return [r.recommendation_id for r in df.collect()]


def test_create_overwrites_by_content(frame):
    drafts = frame(
        [("a", "x", 0.5, "low", "2024-03-01", "old"), ("a", "x", 0.9, "low", "2024-03-02", "new"),
         ("b", "x", 0.5, "odd", "2024-03-01", None)],
        "title string, description string, confidence double, impact string, updated_at timestamp, rationale string",
    ).withColumn("urgency", F.lit("critical")).withColumn("effort", F.lit("easy"))
    got = {r.title: r for r in rec.create(drafts, AS_OF).collect()}
    assert got["a"].rationale == "new" and got["a"].composite_score == pytest.approx(0.27 + 0.1 + 0.25 + 0.15)
    assert got["b"].composite_score == pytest.approx(0.15 + 0.2 + 0.25 + 0.15)
    assert got["a"].status == "pending" and got["a"].tags == {} and got["a"].stakeholders == []
    assert got["a"].recommendation_id.startswith("rec_") and len(got["a"].recommendation_id) == 16


def test_filters(recs):
    df = recs(
        {"recommendation_id": "1", "stakeholders": ["CEO"], "tags": {"a": "1", "b": "2"}},
        {"recommendation_id": "2", "domain": "customer", "confidence": 0.2, "tags": {"a": "1"}},
        {"recommendation_id": "3", "status": "approved", "created_at": "2024-03-05", "stakeholders": ["CFO", "COO"]},
    )
    assert rec.select(df).count() == 3
    assert rec.select(df, domains=[], min_confidence=0, tags={}).count() == 3
    assert ids(rec.select(df, tags={"a": "1", "b": "2"})) == ["1"]
    assert sorted(ids(rec.select(df, stakeholders=["COO", "CEO"]))) == ["1", "3"]
    assert ids(rec.select(df, agent_types=["customer"])) == ["2"]
    assert ids(rec.select(df, created_from="2024-03-05", created_to="2024-03-05")) == ["3"]
    assert sorted(ids(rec.confident(df))) == ["1", "3"]
    assert ids(rec.by_id(df, "2")) == ["2"]


def test_pages(recs):
    df = recs(*[{"recommendation_id": str(i), "composite_score": i / 10} for i in range(7)])
    assert ids(rec.page(df, 3)) == ["6", "5", "4"] and ids(rec.page(df, 3, 3)) == ["3", "2", "1"]
    assert ids(rec.page(df, 3, 6)) == ["0"]


def test_strategies(recs):
    df = recs(
        {"recommendation_id": "1", "composite_score": 0.9, "urgency": "odd", "impact": "medium", "effort": "complex"},
        {"recommendation_id": "2", "composite_score": 0.5, "urgency": "critical", "impact": "odd",
         "stakeholders": ["Regional Manager"], "effort": "moderate"},
        {"recommendation_id": "3", "composite_score": 0.1, "urgency": "high", "impact": "high",
         "stakeholders": ["x", "Executive Sponsor"], "effort": "easy"},
    )
    expected = {"score_based": "123", "urgency_first": "231", "impact_first": "312", "effort_aware": "321", "stakeholder": "321"}
    for strategy, order in expected.items():
        assert ids(rec.prioritize(df, strategy, 20)) == list(order), strategy
    assert rec.prioritize(df, "urgency_first", 1).count() == 1
    ranked = rec.ranked(df, 2).collect()
    assert [(r.recommendation_id, r.tags["orchestrator_rank"]) for r in ranked] == [("2", "1"), ("3", "2")]


def test_expiry_at_exactly_a_week(recs, rows):
    df = recs(
        {"recommendation_id": "exact", "created_at": "2024-03-03"}, {"recommendation_id": "older", "created_at": "2024-03-02 23:59:59"},
        {"recommendation_id": "done", "created_at": "2024-01-01", "status": "completed"},
    )
    got = rows(rec.expire(df, AS_OF), "recommendation_id")
    assert {k: v["status"] for k, v in got.items()} == {"exact": "pending", "older": "archived", "done": "completed"}
    assert str(got["older"]["updated_at"]).startswith("2024-03-10")


def test_status_log_and_tallies(recs, frame, rows):
    df = recs({"recommendation_id": "1"}, {"recommendation_id": "2", "domain": "customer"}, {"recommendation_id": "3"})
    log = frame(
        [("1", "approved", "good", None, "2024-03-02"), ("1", "completed", "", 5.0, "2024-03-03"),
         ("1", "completed", None, -1.0, "2024-03-04"), ("2", "rejected", None, 0.0, "2024-03-02")],
        "recommendation_id string, status string, feedback string, actual_impact double, updated_at timestamp",
    )
    got = rows(rec.apply_status_log(df, log), "recommendation_id")
    assert (got["1"]["status"], got["1"]["feedback"], got["1"]["actual_impact"]) == ("completed", "good", -1.0)
    assert got["3"]["status"] == "pending" and str(got["1"]["updated_at"]).startswith("2024-03-04")
    tallies = rows(rec.feedback_tallies(log, df), "domain")
    assert (tallies["sales"]["success"], tallies["sales"]["failure"]) == (1, 1)
    assert (tallies["customer"]["success"], tallies["customer"]["failure"]) == (0, 1)


def test_actions(recs, frame, rows):
    df = recs({"recommendation_id": "1"}).withColumn("expected_impact_value", F.lit(9.0))
    requests = frame(
        [("1", "email", "first", "2024-03-02"), ("1", "email", "second", "2024-03-03"), ("lost", "email", "x", "2024-03-03")],
        "recommendation_id string, action_type string, description string, created_at timestamp",
    )
    made = actions.create_actions(requests, df)
    assert {r.expected_impact for r in made.collect()} == {9.0} and made.select("action_id").distinct().count() == 2
    assert ids(actions.orphans(requests, df)) == ["lost"]
    assert actions.record_actions(df, made).first().action_taken == "second"
    assert actions.latest_actions(made, 1).first().description == "second"
    log = frame(
        [("a", "running", 10.0, None, None, "2024-03-02"), ("a", "running", 40.0, None, None, "2024-03-03"),
         ("a", "completed", None, "ok", None, "2024-03-04"), ("b", "running", 5.0, None, None, "2024-03-02"),
         ("b", "failed", None, None, "late", "2024-03-05"), ("c", "scheduled", None, None, None, "2024-03-05")],
        "action_id string, status string, progress double, result string, error_message string, updated_at timestamp",
    )
    got = rows(actions.action_states(log), "action_id")
    assert (got["a"]["status"], got["a"]["progress"], got["a"]["result"]) == ("completed", 100.0, "ok")
    assert str(got["a"]["started_at"]).startswith("2024-03-02") and str(got["a"]["completed_at"]).startswith("2024-03-04")
    assert (got["b"]["status"], got["b"]["progress"], got["b"]["completed_at"], got["b"]["error_message"]) == ("failed", 5.0, None, "late")
    assert got["c"]["progress"] == 0 and got["c"]["started_at"] is None
    assert {r.status: r.actions for r in actions.action_counts(actions.action_states(log)).collect()} == {
        "completed": 1, "failed": 1, "scheduled": 1}


def test_board_takes_the_best_pending(recs, rows):
    df = recs(*[{"recommendation_id": str(i), "composite_score": i / 10, "urgency": "high" if i % 2 else "low"} for i in range(6)],
              {"recommendation_id": "done", "status": "completed", "composite_score": 9.0})
    got = rows(rec.board(df, 2), "urgency")
    assert {k: [e["recommendation_id"] for e in v["entries"]] for k, v in got.items()} == {"high": ["5", "3"], "low": ["4", "2"]}


def test_extraction(spark):
    body = ('{"recommendations": [{"summary": "A", "confidence": 0.9, "impact": "high", "urgency": "critical", "effort": "easy"},'
            '{"summary": "B", "confidence": 0.6}, {"summary": "C", "confidence": 0.8}]}')
    df = spark.createDataFrame([("1", "sales", f"Text {body} more"), ("2", "sales", "nothing"), ("3", "sales", "{bad")],
                               "analysis_id string, domain string, text string")
    got = rec.page(rec.extract(df).withColumnRenamed("analysis_id", "recommendation_id")).collect()
    assert [(r.title, round(r.composite_score, 4)) for r in got] == [("A", 0.97), ("C", 0.665)]
    assert [r.title for r in rec.extract(df, max_items=1).collect()] == ["A"]


TITLES = ["Reduce price", "Increase price now", "reduce cost to increase margin", "Raise inventory", "LOWER inventory cost",
          "Lower and raise nothing", "Invest in staff", "Cut staff", "Hold", "Grow", "price review", "maximize minimize"]


def _conflict(a, b):
    a, b = a.lower(), b.lower()
    return any((x in a and y in b) or (y in a and x in b) for x, y in OPPOSING_WORDS)


def _kind(a, b):
    text = (a.lower(), b.lower())
    for word, name in conflicts.CONFLICT_CLASSES:
        if any(word in t for t in text):
            return name
    return conflicts.CONFLICT_OTHER


@pytest.mark.parametrize("copies", [1, 3])
def test_conflicts_against_all_pairs(recs, copies):
    items = [{"recommendation_id": f"{i:02d}", "title": TITLES[i % len(TITLES)], "composite_score": (i * 7 % 11) / 11,
              "domain": ["sales", "customer"][i % 2]} for i in range(len(TITLES) * copies)]
    df = recs(*items)
    pairs = [(a, b) for a, b in itertools.combinations(items, 2) if _conflict(a["title"], b["title"])]
    expected = {}
    for a, b in pairs:
        kind = _kind(a["title"], b["title"])
        expected[kind] = expected.get(kind, 0) + 1
    assert {r.conflict_type: r.pairs for r in conflicts.conflict_summary(df).collect()} == expected

    got = {r.recommendation_id: r for r in conflicts.opponents(df).collect()}
    for item in items:
        rivals = [x for p in pairs if item in p for x in p if x is not item]
        row = got.pop(item["recommendation_id"], None)
        if not rivals:
            assert row is None
            continue
        top = max(rivals, key=lambda x: (x["composite_score"], x["recommendation_id"]))
        winner = item if item["composite_score"] > top["composite_score"] else top
        assert (row.opponents, row.strongest_opponent) == (len(rivals), top["recommendation_id"])
        assert row.conflict_type == _kind(item["title"], top["title"])
        assert row.resolution.startswith(f"Prioritize {winner['domain']} ")
    assert not got

    listed = conflicts.top_conflicts(df, len(items)).collect()
    assert sorted((r.id_1, r.id_2) for r in listed) == sorted((a["recommendation_id"], b["recommendation_id"]) for a, b in pairs)


def test_cross_domain_rules_need_two_domains(spark):
    def names(*domains):
        df = spark.createDataFrame([(d,) for d in domains], "domain string")
        return {r.name: list(r.relevant_domains) for r in rec.cross_domain_opportunities(df).collect()}

    assert names("sales") == {}
    assert names("customer", "operations", "operations") == {"Inventory Optimization & Customer Satisfaction": ["operations", "customer"]}
    assert len(names("sales", "customer", "revenue", "operations")) == 3


def test_confidence_and_findings(recs, spark, rows):
    df = recs({"recommendation_id": "1", "confidence": 0.8}, {"recommendation_id": "2", "domain": "customer", "confidence": 0.6},
              {"recommendation_id": "3", "domain": "revenue", "confidence": 1.0})
    seen = spark.createDataFrame([("sales", 9), ("customer", 10), ("revenue", 50), ("operations", 99)], "domain string, rows long")
    got = rows(rec.analysis_confidence(df, seen), "domain")
    assert {k: round(v["confidence"], 4) for k, v in got.items()} == {"sales": 0.56, "customer": 0.51, "revenue": 1.0, "operations": 0.5}
    metric = spark.createDataFrame([("sales",)] * 3 + [("customer",)], "domain string")
    findings = rows(rec.key_findings(metric, metric.filter("domain = 'sales'").limit(2)), "domain")
    assert findings["sales"]["key_findings"] == ["Analyzed 3 metric records", "Detected 2 anomalous data points"]
    assert findings["customer"]["key_findings"] == ["Analyzed 1 metric records"]
    assert rows(rec.key_findings(metric), "domain")["sales"]["anomalies"] == 0


def test_statistics_views_and_counters(recs, rows):
    df = recs({"recommendation_id": "1"}, {"recommendation_id": "2", "urgency": "critical", "status": "rejected"})
    stats = {(r.breakdown, r.label): r.recommendations for r in rec.statistics(df).collect()}
    assert stats == {("status", "pending"): 1, ("status", "rejected"): 1, ("domain", "sales"): 2, ("urgency", "low"): 1,
                     ("urgency", "critical"): 1, ("total", "all"): 2}
    assert ids(rec.filtered_view(df)) == ["2", "1"] and ids(rec.filtered_view(df, urgency=["low"])) == ["1"]
    assert rec.urgency_counts(df).first().asDict() == {"critical": 1, "high": 0, "medium": 0, "low": 1}
    assert rec.status_counts(df).first().asDict() == {"pending": 1, "approved": 0, "completed": 0, "dismissed": 1}


def test_alerts(frame, rows):
    found = frame([("s", 3, "2024-03-01", 10.0, 4.0, 6.0, 3.2, "high", "z_score"), ("s", 4, None, 1.0, None, None, 1.0, "odd", "z_score")],
                  "series_key string, idx int, ts timestamp, value double, expected_value double, deviation double, score double, "
                  "severity string, method string")
    got = alerts.anomaly_alerts(found, "revenue", ["a@b"]).collect()
    assert [r.priority for r in got] == ["high", "medium"] and got[0].title.endswith("Anomaly Detected: revenue")
    assert "Value: 10.00\nExpected: 4.00\nDeviation: 6.00\nSeverity: HIGH\nTime: 2024-03-01 00:00:00" in got[0].message
    assert "Expected: N/A" in got[1].message and got[0].recipients == ["a@b"]
    log = frame([("high", True), ("high", False), ("low", True), ("low", True)], "priority string, sent boolean")
    stats = rows(alerts.notification_stats(log), "label")
    assert (stats["all"]["total"], stats["all"]["delivered"], stats["all"]["success_rate"]) == (4, 3, 75.0)
    assert stats["high"]["failed"] == 1
    measures = frame([("revenue_vs_forecast_percent", -12.0), ("nps_change_points", -10.0), ("largest_stream_percent", 40.1)],
                     "measure string, value double")
    assert sorted(r.rule for r in alerts.rule_alerts(measures).collect()) == ["revenue_concentration", "revenue_miss_vs_forecast"]


def test_what_if(spark, rows):
    plans = spark.createDataFrame([("none", 0.0, 0.0, 0.0), ("push", 0.25, -0.2, 0.3), ("save", -0.2, 0.2, -0.2)],
                                  "scenario_id string, marketing_spend_change double, price_adjustment double, staffing_change double")
    base = spark.createDataFrame([(1000.0, 100, 50)], "revenue double, orders long, customers long")
    got = rows(scenario.what_if(plans, base), "scenario_id")
    assert got["none"]["projected_revenue"] == 1000 and len(got["none"]["recommendations"]) == 1
    assert got["push"]["revenue_percent"] == pytest.approx((0.2 + 0.1 + 0.09) * 100)
    assert got["push"]["projected_orders"] == pytest.approx(100 * (1 + 0.39 * 0.9))
    assert got["save"]["projected_customers"] == pytest.approx(50 * (1 - 0.16 * 0.6))
    assert len(got["save"]["recommendations"]) == 3
