"""Recommendations, actions, alerts and scenarios derived from the order tables.

One recommendation per order: its texts and labels follow from the keys, so the same
rows come out of both engines. Lines serve as status and action log entries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from metricmill.functions.scalars import composite_score, fixed_id
from metricmill.functions.texts import SCENARIO_NOTES
from metricmill.functions.timeparts import in_period
from metricmill.operators import actions, alerts, anomalies, conflicts, metrics, revenue, scenario
from metricmill.operators import forecast as fc
from metricmill.operators import recommend as rec
from metricmill.plans.catalog import EVENTS_AS_OF, SALES_AS_OF, over, query, within
from metricmill.plans.series_queries import HOURLY, event_series
from metricmill.plans.domain_queries import STREAMS
from metricmill.session import stage
from metricmill.sources import star

VERBS = ["Reduce", "Increase", "Lower", "Raise", "Cut", "Invest in", "Decrease", "Grow", "Minimize", "Maximize", "Review"]
OBJECTS = ["price", "cost", "inventory", "staffing", "delivery", "marketing", "service"]
PEOPLE = [["Executive Sponsor", "Sales"], ["Regional Manager"], ["Director of Operations"], ["CEO Office"], []]
IMPACTS = ["low", "medium", "high", "unrated"]
EFFORTS = ["easy", "moderate", "complex", "unclear"]
KINDS = ["alert", "suggestion", "automation", "insight"]
NAMES = ["sales", "operations", "customer", "revenue"]
URGENCY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unset", "5-LOW": "low"}


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def recommendations(spark, root):
    k = F.col("o_orderkey")
    urgency = F.create_map(*[F.lit(x) for item in URGENCY.items() for x in item])[F.col("o_orderpriority")]
    extra = F.when(k % 13 == 0, " to increase margin").otherwise("")
    people = F.element_at(
        F.array(*[F.array(*[F.lit(p) for p in group]).cast("array<string>") for group in PEOPLE]),
        (k % len(PEOPLE) + 1).cast("int"),
    )
    rows = star.table(spark, root, "orders").select(
        F.concat(pick(VERBS, k), F.lit(" "), pick(OBJECTS, k), extra).alias("title"),
        F.concat(F.lit("Order "), k.cast("string")).alias("description"),
        pick(KINDS, k).alias("insight_type"),
        pick(NAMES, k).alias("domain"),
        (k % 100 / 100).alias("confidence"),
        pick(IMPACTS, k).alias("impact"),
        urgency.alias("urgency"),
        pick(EFFORTS, F.floor(k / 4)).alias("effort"),
        F.col("o_totalprice").alias("expected_impact_value"),
        F.lit("Derived from the order").alias("rationale"),
        people.alias("stakeholders"),
        F.array(F.lit("revenue"), F.lit("orders")).alias("metrics_affected"),
        F.create_map(F.lit("region"), (k % 6).cast("string"), F.lit("tier"), (k % 2).cast("string")).alias("tags"),
        F.struct(pick(NAMES, k).alias("agent_type")).alias("source"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "approved")
        .otherwise("pending").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        k.alias("order_key"),
    )
    score = composite_score(*[F.col(c) for c in ("confidence", "impact", "urgency", "effort")])
    return rows.withColumn("recommendation_id", fixed_id("rec_", F.concat_ws("_", "title", "description"))).withColumn(
        "composite_score", score
    )


def listed(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def level(column: str, names: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.items()) + " ELSE 2 END"


RECS = f"""
    SELECT *, 'rec_' || substr(md5(title || '_' || description), 1, 12) AS recommendation_id,
           confidence * 0.3 + {level("impact", {"low": 1, "medium": 2, "high": 3})} / 3 * 0.3
             + {level("urgency", {"low": 1, "medium": 2, "high": 3, "critical": 4})} / 4 * 0.25
             + {level("effort", {"easy": 3, "moderate": 2, "complex": 1})} / 3 * 0.15 AS composite_score
    FROM (SELECT o_orderkey AS k,
                 ({listed(VERBS)})[k % 11 + 1] || ' ' || ({listed(OBJECTS)})[k % 7 + 1]
                   || CASE WHEN k % 13 = 0 THEN ' to increase margin' ELSE '' END AS title,
                 'Order ' || k AS description, ({listed(KINDS)})[k % 4 + 1] AS insight_type,
                 ({listed(NAMES)})[k % 4 + 1] AS domain, k % 100 / 100 AS confidence,
                 ({listed(IMPACTS)})[k % 4 + 1] AS impact,
                 CASE o_orderpriority {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in URGENCY.items())} END AS urgency,
                 ({listed(EFFORTS)})[(k // 4) % 4 + 1] AS effort, o_totalprice AS expected_impact_value,
                 ({listed(["; ".join(p) for p in PEOPLE])})[k % 5 + 1] AS stakeholders,
                 (k % 6)::VARCHAR AS region, (k % 2)::VARCHAR AS tier,
                 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'approved' ELSE 'pending' END AS status,
                 o_orderdate AS created_at
          FROM orders)"""
SHORT = ["recommendation_id", "title", "domain", "urgency", "impact", "effort", "confidence", "composite_score"]
SHORT_SQL = ", ".join(SHORT)
URGENCY_RANK = "CASE urgency WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def recs_sql(body: str, **ctes: str) -> str:
    return over(body, r=RECS, **ctes)


@query(
    "recommendation_scores",
    recs_sql(f"SELECT {SHORT_SQL} FROM r"),
)
def recommendation_scores(spark, root):
    return recommendations(spark, root).select(*SHORT)


@query(
    "recommendation_create",
    """SELECT 'rec_' || substr(md5(title || '_' || description), 1, 12) AS recommendation_id, title, description,
              'pending' AS status, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS updated_at,
              '2001-08-02 00:00:00' AS created_at, 0.8 * 0.3 + 3 / 3 * 0.3 + 1 / 4 * 0.25 + 3 / 3 * 0.15 AS composite_score,
              0::INTEGER AS stakeholders, 0::INTEGER AS metrics_affected, 0::INTEGER AS tags
       FROM (SELECT 'Review ' || o_orderpriority AS title, 'Customer group ' || (o_custkey % 100) AS description,
                    o_orderdate AS t FROM orders) GROUP BY 1, 2, 3""",
)
def recommendation_create(spark, root):
    drafts = star.table(spark, root, "orders").select(
        F.concat(F.lit("Review "), "o_orderpriority").alias("title"),
        F.concat(F.lit("Customer group "), (F.col("o_custkey") % 100).cast("string")).alias("description"),
        F.lit(0.8).alias("confidence"), F.lit("high").alias("impact"), F.lit("low").alias("urgency"),
        F.lit("easy").alias("effort"), F.col("o_orderdate").alias("updated_at"),
    )
    created = rec.create(drafts, SALES_AS_OF)
    sizes = [F.size(c).alias(c) for c in ("stakeholders", "metrics_affected", "tags")]
    return created.select(
        "recommendation_id", "title", "description", "status", "updated_at", "created_at", "composite_score", *sizes
    )


@query(
    "recommendation_filter",
    recs_sql(
        f"""SELECT {SHORT_SQL} FROM r
            WHERE domain IN ('sales', 'customer') AND status IN ('pending', 'approved') AND urgency IN ('critical', 'high')
              AND impact IN ('low', 'high') AND insight_type IN ('alert', 'automation') AND confidence >= 0.2
              AND composite_score >= 0.4 AND domain IN ('sales', 'customer')
              AND (contains(stakeholders, 'Regional Manager') OR contains(stakeholders, 'CEO Office')
                   OR contains(stakeholders, 'Executive Sponsor'))
              AND region = '0' AND tier = '0' AND created_at >= TIMESTAMP '1996-01-01'
              AND created_at <= TIMESTAMP '2001-01-01'"""
    ),
)
def recommendation_filter(spark, root):
    picked = rec.select(
        recommendations(spark, root),
        domains=["sales", "customer"], status=["pending", "approved"], urgency=["critical", "high"],
        impact=["low", "high"], insight_types=["alert", "automation"], agent_types=["sales", "customer"],
        min_confidence=0.2, min_score=0.4, stakeholders=["Regional Manager", "CEO Office", "Executive Sponsor"],
        tags={"region": "0", "tier": "0"}, created_from="1996-01-01", created_to="2001-01-01",
    )
    return picked.select(*SHORT)


@query(
    "recommendation_page",
    recs_sql(
        f"""SELECT {SHORT_SQL} FROM r WHERE status = 'pending' AND confidence >= 0.7
            ORDER BY composite_score DESC, recommendation_id LIMIT 50 OFFSET 50"""
    ),
)
def recommendation_page(spark, root):
    pending = rec.confident(rec.select(recommendations(spark, root), status=["pending"]))
    return rec.page(pending, 50, 50).select(*SHORT)


def strategy_sql(order: str) -> str:
    return recs_sql(f"SELECT {SHORT_SQL} FROM r ORDER BY {order}, recommendation_id LIMIT 20")


STRATEGIES = {
    "score_based": "composite_score DESC, confidence DESC",
    "urgency_first": f"{URGENCY_RANK}, composite_score DESC",
    "impact_first": "CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, composite_score DESC",
    "effort_aware": "CASE effort WHEN 'easy' THEN 0 WHEN 'moderate' THEN 1 WHEN 'complex' THEN 2 ELSE 3 END, composite_score DESC",
    "stakeholder": """CASE WHEN lower(stakeholders) LIKE '%executive%' OR lower(stakeholders) LIKE '%ceo%' THEN 0
                           WHEN lower(stakeholders) LIKE '%manager%' OR lower(stakeholders) LIKE '%director%' THEN 1
                           ELSE 2 END, composite_score DESC""",
}
for _name, _order in STRATEGIES.items():

    @query(f"prioritize_{_name}", strategy_sql(_order))
    def prioritized(spark, root, strategy=_name):
        return rec.prioritize(recommendations(spark, root), strategy, 20).select(*SHORT)


@query(
    "cross_domain_ranking",
    recs_sql(
        f"""SELECT {SHORT_SQL}, CAST(row_number() OVER (ORDER BY {URGENCY_RANK}, composite_score DESC,
                   recommendation_id) AS VARCHAR) AS orchestrator_rank FROM r
            ORDER BY {URGENCY_RANK}, composite_score DESC, recommendation_id LIMIT 20"""
    ),
)
def cross_domain_ranking(spark, root):
    everything = recommendations(spark, root)
    parts = [everything.filter(F.col("domain") == name) for name in NAMES]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return rec.ranked(merged, 20).select(*SHORT, F.col("tags")["orchestrator_rank"].alias("orchestrator_rank"))


@query(
    "recommendation_view",
    recs_sql(
        f"""SELECT {SHORT_SQL} FROM r WHERE urgency IN ('critical', 'low') AND domain IN ('operations')
            AND status IN ('approved')"""
    ),
)
def recommendation_view(spark, root):
    rows = rec.filtered_view(recommendations(spark, root), ["critical", "low"], ["operations"], ["approved"])
    return rows.select(*SHORT)


@query(
    "recommendation_statistics",
    recs_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS breakdown, {c} AS label, count(*) AS recommendations, avg(confidence) AS avg_confidence,
                       avg(composite_score) AS avg_score FROM r GROUP BY {c}"""
            for c in ("status", "domain", "urgency")
        )
        + " UNION ALL SELECT 'total', 'all', count(*), avg(confidence), avg(composite_score) FROM r"
    ),
)
def recommendation_statistics(spark, root):
    return rec.statistics(recommendations(spark, root))


@query(
    "urgency_counts",
    recs_sql(
        "SELECT " + ", ".join(f"count(*) FILTER (urgency = '{u}') AS {u}" for u in ("critical", "high", "medium", "low"))
        + " FROM r"
    ),
)
def urgency_counts(spark, root):
    return rec.urgency_counts(recommendations(spark, root))


@query(
    "action_center_counters",
    recs_sql(
        """SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved,
                  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'rejected') AS dismissed
           FROM r"""
    ),
)
def action_center_counters(spark, root):
    return rec.status_counts(recommendations(spark, root))


def status_log(spark, root):
    """Each order line as a status change of the order's recommendation."""
    lines = star.table(spark, root, "lineitem")
    keys = recommendations(spark, root).select("recommendation_id", "order_key")
    flag = F.col("l_returnflag")
    return lines.join(keys, lines.l_orderkey == keys.order_key).select(
        "recommendation_id",
        F.when(flag == "A", "approved").when(flag == "R", "rejected").otherwise("in_progress").alias("status"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("line "), F.col("l_linenumber").cast("string")))
        .alias("feedback"),
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") - 50000).alias("actual_impact"),
        F.col("l_shipdate").alias("updated_at"),
    )


STATUS_LOG = """SELECT recommendation_id, CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected'
                       ELSE 'in_progress' END AS s, CASE WHEN l_linenumber % 3 = 0 THEN 'line ' || l_linenumber END AS f,
                       CASE WHEN l_linestatus = 'F' THEN l_extendedprice - 50000 END AS a, l_shipdate AS t
                FROM lineitem JOIN r ON l_orderkey = k"""


@query(
    "recommendation_state",
    recs_sql(
        """SELECT r.recommendation_id, coalesce(st.s, r.status) AS status, f AS feedback, a AS actual_impact,
                  strftime(coalesce(t, created_at), '%Y-%m-%d %H:%M:%S') AS updated_at
           FROM r LEFT JOIN st USING (recommendation_id)""",
        log=STATUS_LOG,
        st="""SELECT recommendation_id, max({'t': t, 's': s}).s AS s, max(t) AS t,
                     (max({'t': t, 's': s, 'f': f}) FILTER (f IS NOT NULL)).f AS f,
                     (max({'t': t, 's': s, 'a': a}) FILTER (a IS NOT NULL)).a AS a FROM log GROUP BY 1""",
    ),
)
def recommendation_state(spark, root):
    rows = rec.apply_status_log(recommendations(spark, root), status_log(spark, root))
    return rows.select("recommendation_id", "status", "feedback", "actual_impact", "updated_at")


@query(
    "feedback_tallies",
    recs_sql(
        """SELECT domain, count(*) FILTER (a > 0) AS success, count(*) FILTER (a <= 0) AS failure
           FROM log JOIN r USING (recommendation_id) WHERE a IS NOT NULL GROUP BY 1""",
        log=STATUS_LOG,
    ),
)
def feedback_tallies(spark, root):
    return rec.feedback_tallies(status_log(spark, root), recommendations(spark, root))


@query(
    "recommendation_expiry",
    recs_sql(
        f"""SELECT CASE WHEN e THEN 'archived' ELSE status END AS status, count(*) AS recommendations,
                   count(*) FILTER (e) AS expired
            FROM (SELECT *, status = 'pending' AND created_at < TIMESTAMP '{SALES_AS_OF}' - INTERVAL 168 HOUR AS e FROM r)
            GROUP BY 1"""
    ),
)
def recommendation_expiry(spark, root):
    return rec.expire(recommendations(spark, root), SALES_AS_OF).groupBy("status").agg(
        F.count("*").alias("recommendations"), F.count_if("expired").alias("expired")
    )


def action_requests(spark, root):
    """Each line as a request for an action; a third of the lines name no known recommendation."""
    lines = star.table(spark, root, "lineitem")
    keys = recommendations(spark, root).select("recommendation_id", "order_key")
    known = F.when(F.col("l_returnflag") != "R", F.col("recommendation_id"))
    return lines.join(keys, lines.l_orderkey == keys.order_key).select(
        F.coalesce(known, F.concat(F.lit("rec_lost_"), "l_linestatus")).alias("recommendation_id"),
        F.lit("review").alias("action_type"),
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("description"),
        F.lit("ops").alias("executor"),
        F.col("l_shipdate").alias("scheduled_at"),
        F.col("l_shipdate").alias("created_at"),
    )


@query(
    "actions_created",
    recs_sql(
        """SELECT recommendation_id, count(*) AS actions, max(expected_impact_value) AS expected_impact,
                  max({'t': l_shipdate, 'd': 'Line ' || l_linenumber}).t::DATE::VARCHAR AS last_created
           FROM lineitem JOIN r ON l_orderkey = k WHERE l_returnflag <> 'R' GROUP BY 1"""
    ),
)
def actions_created(spark, root):
    created = actions.create_actions(action_requests(spark, root), recommendations(spark, root))
    return created.groupBy("recommendation_id").agg(
        F.count("*").alias("actions"), F.max("expected_impact").alias("expected_impact"),
        F.to_date(F.max("created_at")).alias("last_created"),
    )


@query(
    "latest_actions",
    recs_sql(
        """SELECT 'act_' || substr(md5(concat_ws('_', recommendation_id, 'review', 'Line ' || l_linenumber, t)), 1, 12)
                    AS action_id, recommendation_id, 'Line ' || l_linenumber AS description, t AS created_at
           FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS t FROM lineitem JOIN r ON l_orderkey = k
                 WHERE l_returnflag <> 'R') ORDER BY l_shipdate DESC, 1 LIMIT 10"""
    ),
)
def latest_actions(spark, root):
    created = actions.create_actions(action_requests(spark, root), recommendations(spark, root))
    return actions.latest_actions(created, 10).select("action_id", "recommendation_id", "description", "created_at")


@query(
    "actions_written_back",
    recs_sql(
        """SELECT recommendation_id, a.d AS action_taken, strftime(coalesce(a.t, created_at), '%Y-%m-%d %H:%M:%S') AS updated_at
           FROM r LEFT JOIN (
             SELECT recommendation_id, max(t) AS t, (max({'t': t, 'id': id, 'd': d})).d AS d
             FROM (SELECT recommendation_id, l_shipdate AS t, 'Line ' || l_linenumber AS d,
                          md5(concat_ws('_', recommendation_id, 'review', 'Line ' || l_linenumber,
                                        strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')))[1:12] AS id
                   FROM lineitem JOIN r ON l_orderkey = k WHERE l_returnflag <> 'R') GROUP BY 1) a
           USING (recommendation_id)"""
    ),
)
def actions_written_back(spark, root):
    base = recommendations(spark, root)
    made = actions.create_actions(action_requests(spark, root), base)
    return actions.record_actions(base, made).select("recommendation_id", "action_taken", "updated_at")


@query(
    "orphan_action_requests",
    """SELECT 'rec_lost_' || l_linestatus AS recommendation_id, count(*) AS requests
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1""",
)
def orphan_action_requests(spark, root):
    lost = actions.orphans(action_requests(spark, root), recommendations(spark, root))
    return lost.groupBy("recommendation_id").agg(F.count("*").alias("requests"))


def action_log(spark, root):
    n = F.col("l_linenumber")
    status = (
        F.when(n == 1, "scheduled").when(n <= 4, "running").when(n == 5, "failed").otherwise("completed")
    )
    return star.table(spark, root, "lineitem").select(
        F.concat(F.lit("act_"), F.col("l_orderkey").cast("string")).alias("action_id"),
        status.alias("status"),
        F.col("l_quantity").alias("progress"),
        F.when(n >= 6, F.concat(F.lit("shipped by "), F.col("l_suppkey").cast("string"))).alias("result"),
        F.when(n == 5, "late").alias("error_message"),
        F.col("l_shipdate").alias("updated_at"),
    )


@query(
    "action_states",
    over(
        """SELECT action_id, max({'t': t, 's': s}).s AS status, max({'t': t, 's': s, 'p': p}).p AS progress,
                  strftime(min(t) FILTER (s = 'running'), '%Y-%m-%d %H:%M:%S') AS started_at,
                  strftime(max(t) FILTER (s = 'completed'), '%Y-%m-%d %H:%M:%S') AS completed_at,
                  (max({'t': t, 's': s, 'r': r}) FILTER (r IS NOT NULL)).r AS result,
                  max(e) AS error_message, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS updated_at
           FROM (SELECT *, CASE WHEN s = 'completed' THEN 100 ELSE q END AS p FROM log) GROUP BY 1""",
        log="""SELECT 'act_' || l_orderkey AS action_id, CASE WHEN l_linenumber = 1 THEN 'scheduled'
                      WHEN l_linenumber <= 4 THEN 'running' WHEN l_linenumber = 5 THEN 'failed' ELSE 'completed' END AS s,
                      l_quantity AS q, CASE WHEN l_linenumber >= 6 THEN 'shipped by ' || l_suppkey END AS r,
                      CASE WHEN l_linenumber = 5 THEN 'late' END AS e, l_shipdate AS t FROM lineitem""",
    ),
)
def action_states(spark, root):
    return actions.action_states(action_log(spark, root))


@query(
    "recommendation_board",
    recs_sql(
        """SELECT urgency, count(*) AS entries, string_agg(recommendation_id, '; ' ORDER BY composite_score DESC,
                  recommendation_id) AS ids
           FROM (SELECT * FROM r WHERE status = 'pending' QUALIFY row_number() OVER (
                   PARTITION BY urgency ORDER BY composite_score DESC, recommendation_id) <= 50)
           GROUP BY 1"""
    ),
)
def recommendation_board(spark, root):
    return rec.board(recommendations(spark, root), 50).select(
        "urgency", F.size("entries").cast("bigint").alias("entries"),
        F.transform("entries", lambda e: e["recommendation_id"]).alias("ids"),
    )


def analyses(spark, root):
    """One analysis text per order; every ninth holds no JSON."""
    k = F.col("o_orderkey")

    def item(name, confidence):
        return F.struct(
            F.concat(F.lit(f"{name} "), k.cast("string")).alias("summary"), F.lit("suggestion").alias("insight_type"),
            confidence.alias("confidence"), pick(IMPACTS, k).alias("impact"), F.lit("high").alias("urgency"),
            pick(EFFORTS, F.floor(k / 4)).alias("effort"),
        )

    body = F.to_json(F.struct(F.array(item("First", k % 100 / 100), item("Second", k % 50 / 50)).alias("recommendations")))
    text = F.when(k % 9 == 0, "No structured findings.").otherwise(
        F.concat(F.lit("Findings follow.\n"), body, F.lit("\nEnd of report."))
    )
    return star.table(spark, root, "orders").select(
        k.cast("string").alias("analysis_id"), pick(NAMES, k).alias("domain"), text.alias("text")
    )


@query(
    "extracted_recommendations",
    f"""SELECT analysis_id, domain, title, confidence, confidence * 0.3
               + {level("impact", {"low": 1, "medium": 2, "high": 3})} / 3 * 0.3 + 3 / 4 * 0.25
               + {level("effort", {"easy": 3, "moderate": 2, "complex": 1})} / 3 * 0.15 AS composite_score
        FROM (SELECT k::VARCHAR AS analysis_id, ({listed(NAMES)})[k % 4 + 1] AS domain, name || ' ' || k AS title,
                     CASE name WHEN 'First' THEN k % 100 / 100 ELSE k % 50 / 50 END AS confidence,
                     ({listed(IMPACTS)})[k % 4 + 1] AS impact, ({listed(EFFORTS)})[(k // 4) % 4 + 1] AS effort
              FROM (SELECT o_orderkey AS k FROM orders), (VALUES ('First'), ('Second')) v(name) WHERE k % 9 <> 0)
        WHERE confidence >= 0.7""",
)
def extracted_recommendations(spark, root):
    rows = rec.extract(analyses(spark, root))
    return rows.select("analysis_id", "domain", "title", "confidence", "composite_score")


PAIRS = [("reduce", "increase"), ("lower", "raise"), ("cut", "invest"), ("decrease", "grow"), ("minimize", "maximize")]
# All pairs of recommendations with opposing words, listed one by one.
SIDES = "[" + ", ".join(
    f"CASE WHEN contains(t, '{word}') THEN {{'p': {i}, 's': {side}}} END"
    for i, words in enumerate(PAIRS) for side, word in enumerate(words)
) + "]"
TAGS = f"SELECT *, unnest({SIDES}) AS tag FROM t"
CONFLICTS = """SELECT DISTINCT a.recommendation_id AS id, b.recommendation_id AS other, a.composite_score AS score,
                      b.composite_score AS other_score, a.domain, b.domain AS other_domain,
                      CASE WHEN contains(a.t, 'price') OR contains(b.t, 'price') THEN 'pricing_trade_off'
                           WHEN contains(a.t, 'cost') OR contains(b.t, 'cost') THEN 'cost_benefit_trade_off'
                           WHEN contains(a.t, 'inventory') OR contains(b.t, 'inventory')
                           THEN 'inventory_optimization_trade_off' ELSE 'resource_allocation_conflict' END AS conflict_type
               FROM g a JOIN g b ON a.tag.p = b.tag.p AND a.tag.s = 1 - b.tag.s
                 AND a.recommendation_id <> b.recommendation_id"""


@query(
    "conflict_summary",
    recs_sql(
        "SELECT conflict_type, count(*) // 2 AS pairs FROM c GROUP BY 1",
        t="SELECT recommendation_id, composite_score, domain, lower(title) AS t FROM r", g=TAGS, c=CONFLICTS,
    ),
)
def conflict_summary(spark, root):
    return conflicts.conflict_summary(recommendations(spark, root))


@query(
    "conflict_opponents",
    recs_sql(
        """SELECT id AS recommendation_id, opponents, top.other AS strongest_opponent, top.conflict_type,
                  'Prioritize ' || CASE WHEN score > top.score THEN domain ELSE top.domain END
                    || ' recommendation due to higher priority score' AS resolution
           FROM (SELECT id, any_value(score) AS score, any_value(domain) AS domain, count(*) AS opponents,
                        max({'score': other_score, 'other': other, 'domain': other_domain,
                             'conflict_type': conflict_type}) AS top FROM c GROUP BY 1)""",
        t="SELECT recommendation_id, composite_score, domain, lower(title) AS t FROM r", g=TAGS, c=CONFLICTS,
    ),
)
def conflict_opponents(spark, root):
    return conflicts.opponents(recommendations(spark, root))


@query(
    "top_conflicts",
    recs_sql(
        """SELECT id AS id_1, domain AS agent_1, other AS id_2, other_domain AS agent_2, conflict_type,
                  'Prioritize ' || CASE WHEN score > other_score THEN domain ELSE other_domain END
                    || ' recommendation due to higher priority score' AS resolution FROM c WHERE id < other""",
        t="""SELECT recommendation_id, composite_score, domain, lower(title) AS t FROM r
             ORDER BY composite_score DESC, recommendation_id LIMIT 20""",
        g=TAGS, c=CONFLICTS,
    ),
)
def top_conflicts(spark, root):
    return conflicts.top_conflicts(recommendations(spark, root), 20).drop("title_1", "title_2")


@query(
    "cross_domain_opportunities",
    """SELECT name, relevant_domains, action FROM (VALUES
         ('Revenue Growth & Customer Retention', 'sales; customer; revenue', 'Analyze trade-offs and optimize jointly'),
         ('Inventory Optimization & Customer Satisfaction', 'operations; customer', 'Analyze trade-offs and optimize jointly'),
         ('Pricing & Volume Optimization', 'sales; revenue; operations', 'Analyze trade-offs and optimize jointly'))
         v(name, relevant_domains, action) WHERE (SELECT count(*) FROM orders) > 4""",
)
def cross_domain_opportunities(spark, root):
    rows = rec.cross_domain_opportunities(recommendations(spark, root))
    return rows.select("name", "relevant_domains", "action")


@query("domain_summary", recs_sql(
    "SELECT domain, count(*) AS recommendation_count, avg(confidence) AS confidence FROM r GROUP BY 1"))
def domain_summary(spark, root):
    return rec.domain_summary(recommendations(spark, root))


METRIC_ROWS = f"""SELECT 'sales' AS domain, count(DISTINCT event_timestamp) AS rows FROM sales_events WHERE {within(5)}
                  UNION ALL SELECT 'revenue', count(DISTINCT event_timestamp) FROM revenue_events WHERE {within(30)}
                  UNION ALL SELECT 'customer', count(DISTINCT CAST(event_timestamp AS DATE)) FROM customer_events
                  UNION ALL SELECT 'marketing', 12"""


def metric_rows(spark, root):
    """Daily metric rows of several domains, tagged with the domain."""
    sources = [
        ("sales", star.sales_events(spark, root), SALES_AS_OF, 5),
        ("revenue", star.revenue_events(spark, root), SALES_AS_OF, 30),
        ("customer", star.customer_events(spark, root), EVENTS_AS_OF, 31),
    ]
    parts = [
        metrics.daily_metrics(events, {"n": ("event_timestamp", "count")}, as_of, days).select(
            F.lit(name).alias("domain"), "date", F.col("n").cast("double").alias("value")
        )
        for name, events, as_of, days in sources
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "analysis_confidence",
    over(
        """SELECT domain, CASE WHEN c IS NULL THEN 0.5 ELSE
                    least(c * CASE WHEN rows < 10 THEN 0.7 WHEN rows < 50 THEN 0.85 ELSE 1.0 END, 1.0) END AS confidence
           FROM m LEFT JOIN (SELECT domain, avg(confidence) AS c FROM r GROUP BY 1) USING (domain)""",
        "sales_events", "revenue_events", "customer_events", r=RECS, m=METRIC_ROWS.replace(
            "UNION ALL SELECT 'marketing', 12", ""),
    ),
)
def analysis_confidence(spark, root):
    counts = metric_rows(spark, root).groupBy("domain").agg(F.count("*").alias("rows"))
    return rec.analysis_confidence(recommendations(spark, root), counts)


DAILY_COUNTS = f"""SELECT 'sales' AS domain, CAST(event_timestamp AS DATE) AS d, count(*)::DOUBLE AS value FROM sales_events
                     WHERE {within(5)} GROUP BY 2
                   UNION ALL SELECT 'revenue', CAST(event_timestamp AS DATE), count(*)::DOUBLE FROM revenue_events
                     WHERE {within(30)} GROUP BY 2
                   UNION ALL SELECT 'customer', CAST(event_timestamp AS DATE), count(*)::DOUBLE FROM customer_events
                     GROUP BY 2"""


@query(
    "key_findings",
    over(
        """SELECT domain, records, anomalies, 'Analyzed ' || records || ' metric records' || CASE WHEN anomalies > 0
                  THEN '; Detected ' || anomalies || ' anomalous data points' ELSE '' END AS key_findings
           FROM (SELECT domain, count(*) AS records, count(*) FILTER (n >= 4 AND abs((value - m) / nullif(sd, 0)) > 2)
                          AS anomalies
                 FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM c
                       WINDOW w AS (PARTITION BY domain)) GROUP BY 1)""",
        "sales_events", "revenue_events", "customer_events", c=DAILY_COUNTS,
    ),
)
def key_findings(spark, root):
    rows = stage(metric_rows(spark, root))
    series = rows.select(F.col("domain").alias("series_key"), F.col("date").cast("timestamp").alias("ts"), "value")
    odd = anomalies.z_score(series, 2.0).select(F.col("series_key").alias("domain"))
    return rec.key_findings(rows, odd)


ALERT_SEVERITY = "CASE WHEN z < 2 THEN 'low' WHEN z < 3 THEN 'medium' WHEN z < 4 THEN 'high' ELSE 'critical' END"
EVENT_Z = """SELECT *, abs((value - mean) / nullif(sd, 0)) AS z FROM (
               SELECT *, avg(value) OVER (PARTITION BY series_key) AS mean,
                      stddev_pop(value) OVER (PARTITION BY series_key) AS sd FROM s)"""


@query(
    "anomaly_alerts",
    over(
        f"""SELECT 'email' AS channel, {ALERT_SEVERITY} AS priority, '🚨 Anomaly Detected: ' || series_key AS title,
                   'ops@example.com' AS recipients, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
                   printf('Anomaly detected in %s%sValue: %.2f%sExpected: %.2f%sDeviation: %.2f%sSeverity: %s%sTime: %s',
                          series_key, chr(10) || chr(10), value, chr(10), mean, chr(10), value - mean, chr(10),
                          upper({ALERT_SEVERITY}), chr(10), strftime(ts, '%Y-%m-%d %H:%M:%S')) AS message,
                   series_key AS metric, 'z_score' AS method, z AS score
            FROM z WHERE z > 2.5""",
        s=HOURLY, z=EVENT_Z,
    ),
)
def anomaly_alerts(spark, root):
    rows = alerts.anomaly_alerts(anomalies.z_score(event_series(spark, root)), F.col("series_key"), ["ops@example.com"])
    said = [F.get_json_object("metadata", f"$.{name}").alias(name) for name in ("metric", "method")]
    score = F.get_json_object("metadata", "$.score").cast("double").alias("score")
    # No context is given for z-scores; its line is empty.
    message = F.regexp_replace("message", r"(?s)\n\nContext: \{\}$", "").alias("message")
    return rows.select("channel", "priority", "title", "recipients", "timestamp", message, *said, score)


@query(
    "recommendation_notices",
    recs_sql(
        """SELECT 'email' AS channel, 'high' AS priority, 'Recommendation: ' || title AS title,
                  'Summary: ' || title || chr(10) || chr(10) || 'Description:' || chr(10) || description || chr(10) || chr(10)
                  || 'Details:' || chr(10) || '- Impact: ' || impact || chr(10) || '- Urgency: ' || urgency || chr(10)
                  || '- Effort: ' || effort || chr(10) || '- Confidence: ' || (k % 100) || '%' || chr(10) || chr(10)
                  || 'Rationale:' || chr(10) || 'Derived from the order' || chr(10) || chr(10) || 'Affected Metrics:'
                  || chr(10) || 'revenue, orders' AS message,
                  'lead@example.com' AS recipients, '{"recommendation_id":"' || recommendation_id || '"}' AS metadata
           FROM r"""
    ),
)
def recommendation_notices(spark, root):
    return alerts.recommendation_notices(recommendations(spark, root), ["lead@example.com"], "high")


@query(
    "notification_stats",
    over(
        """SELECT priority AS label, count(*) AS total, count(*) FILTER (sent) AS delivered,
                  count(*) FILTER (NOT sent) AS failed, count(*) FILTER (sent) / count(*) * 100 AS success_rate
           FROM l GROUP BY 1
           UNION ALL SELECT 'all', count(*), count(*) FILTER (sent), count(*) FILTER (NOT sent),
                  count(*) FILTER (sent) / count(*) * 100 FROM l""",
        s=HOURLY, z=EVENT_Z,
        l=f"SELECT {ALERT_SEVERITY} AS priority, hour(ts) % 5 <> 0 AS sent FROM z WHERE z > 2.5",
    ),
)
def notification_stats(spark, root):
    rows = alerts.anomaly_alerts(anomalies.z_score(event_series(spark, root)), F.col("series_key"))
    return alerts.notification_stats(rows.withColumn("sent", F.hour("timestamp") % 5 != 0))


def alert_measures(spark, root):
    """KPI measures the alert rules look at, one row each."""
    week = stage(
        metrics.rollup_series(
            star.revenue_events(spark, root).filter(in_period("event_timestamp", SALES_AS_OF, 97)), [], "amount", "daily"
        )
    )
    before = week.filter(F.col("ts") < F.lit("2001-07-26").cast("timestamp"))
    expected = fc.projected_totals(fc.forecast(before, 7, "linear")).select("projected_total")
    actual = week.filter(F.col("ts") >= F.lit("2001-07-26").cast("timestamp")).groupBy("series_key").agg(
        F.sum("value").alias("actual")
    )
    gap = actual.withColumn("expected", expected.scalar()).select(
        F.lit("revenue_vs_forecast_percent").alias("measure"),
        ((F.col("actual") - F.col("expected")) / F.col("expected") * 100).alias("value"),
    )
    events = star.customer_events(spark, root)
    recent = in_period("event_timestamp", EVENTS_AS_OF, 15)
    promoter, detractor = F.col("nps_score") >= 9, F.col("nps_score") < 7

    def nps(side):
        answered = F.count_if(side & F.col("nps_score").isNotNull())
        return (F.count_if(side & promoter) - F.count_if(side & detractor)) / answered * 100

    support = F.col("event_type") == "support"
    customer = events.filter(in_period("event_timestamp", EVENTS_AS_OF, 30)).agg(
        (nps(recent) - nps(~recent)).alias("nps"),
        (F.count_if(recent & support) / F.count_if(~recent & support) * 100 - 100).alias("support"),
    )
    rows = F.array(
        F.struct(F.lit("nps_change_points").alias("measure"), F.col("nps").alias("value")),
        F.struct(F.lit("support_volume_change_percent").alias("measure"), F.col("support").alias("value")),
    )
    streams = revenue.revenue_streams(star.revenue_events(spark, root), SALES_AS_OF)
    largest = streams.agg(F.max("percentage").alias("value")).select(
        F.lit("largest_stream_percent").alias("measure"), "value"
    )
    return gap.unionByName(customer.select(F.inline(rows))).unionByName(largest)


MEASURES = f"""
    SELECT 'revenue_vs_forecast_percent' AS measure, (actual - expected) / expected * 100 AS value
    FROM (SELECT sum(value) AS actual FROM day WHERE ts >= TIMESTAMP '2001-07-26'),
         (SELECT sum(b + a * (n - 1 + step)) AS expected
          FROM (SELECT regr_slope(value, i) AS a, regr_intercept(value, i) AS b, count(*) AS n
                FROM (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM day WHERE ts < TIMESTAMP '2001-07-26')),
               (SELECT unnest(range(1, 8)) AS step))
    UNION ALL
    SELECT 'nps_change_points', (count(*) FILTER (c AND nps_score >= 9) - count(*) FILTER (c AND nps_score < 7))
             / count(*) FILTER (c AND nps_score IS NOT NULL) * 100
           - (count(*) FILTER (NOT c AND nps_score >= 9) - count(*) FILTER (NOT c AND nps_score < 7))
             / count(*) FILTER (NOT c AND nps_score IS NOT NULL) * 100 FROM ev
    UNION ALL
    SELECT 'support_volume_change_percent', count(*) FILTER (c AND event_type = 'support')
             / count(*) FILTER (NOT c AND event_type = 'support') * 100 - 100 FROM ev
    UNION ALL SELECT 'largest_stream_percent', max(percentage) FROM st"""
MEASURE_CTES = {
    "day": f"SELECT event_timestamp AS ts, sum(amount) AS value FROM revenue_events WHERE {within(97)} GROUP BY 1",
    "ev": f"""SELECT *, event_timestamp >= TIMESTAMP '2024-01-16' AS c FROM customer_events
              WHERE {within(30, EVENTS_AS_OF)}""",
    "st": STREAMS,
    "m": MEASURES,
}


@query(
    "alert_measures",
    over("SELECT measure, value FROM m", "revenue_events", "customer_events", **MEASURE_CTES),
)
def alert_measures_query(spark, root):
    return alert_measures(spark, root)


@query(
    "rule_alerts",
    over(
        """SELECT m.measure, value, rule, domain, threshold::DOUBLE AS threshold FROM m JOIN (VALUES
             ('revenue_drop_vs_forecast', 'sales', 'revenue_vs_forecast_percent', -15.0, true),
             ('revenue_miss_vs_forecast', 'revenue', 'revenue_vs_forecast_percent', -10.0, true),
             ('nps_drop', 'customer', 'nps_change_points', -10.0, true),
             ('support_volume_spike', 'customer', 'support_volume_change_percent', 50.0, false),
             ('revenue_concentration', 'revenue', 'largest_stream_percent', 40.0, false))
             v(rule, domain, measure, threshold, below) ON v.measure = m.measure
           WHERE CASE WHEN below THEN value < threshold ELSE value > threshold END""",
        "revenue_events", "customer_events", **MEASURE_CTES,
    ),
)
def rule_alerts(spark, root):
    return alerts.rule_alerts(alert_measures(spark, root))


def scenarios(spark, root):
    n = F.col("n_nationkey")
    return star.table(spark, root, "nation").select(
        F.col("n_name").alias("scenario_id"),
        ((n - 8) / 40).alias("marketing_spend_change"),
        ((n % 7 - 3) / 20).alias("price_adjustment"),
        ((n % 5 - 1) / 8).alias("staffing_change"),
    )


def _note_sql(column: str, high: float, low: float, up: str, down: str) -> str:
    return f"""CASE WHEN {column} > {high} THEN '{SCENARIO_NOTES[up]}' WHEN {column} < {low}
               THEN '{SCENARIO_NOTES[down]}' END"""


@query(
    "what_if_scenarios",
    over(
        f"""SELECT scenario_id, revenue * (1 + v) AS projected_revenue, orders * (1 + v * 0.9) AS projected_orders,
                   customers * (1 + mk * 0.6) AS projected_customers, v * 100 AS revenue_percent,
                   v * 90 AS orders_percent, mk * 60 AS customers_percent,
                   coalesce(nullif(concat_ws('; ', {_note_sql("m", 0.2, -0.1, "marketing_up", "marketing_down")},
                     {_note_sql("p", 0.1, -0.1, "price_up", "price_down")},
                     {_note_sql("s", 0.2, -0.1, "staffing_up", "staffing_down")}), ''), '{SCENARIO_NOTES["none"]}')
                     AS recommendations
            FROM (SELECT *, m * 0.8 AS mk, m * 0.8 - p * 0.5 + s * 0.3 AS v
                  FROM (SELECT n_name AS scenario_id, (n_nationkey - 8) / 40 AS m, (n_nationkey % 7 - 3) / 20 AS p,
                               (n_nationkey % 5 - 1) / 8 AS s FROM nation)), base""",
        "sales_events",
        base=f"""SELECT sum(revenue) AS revenue, count(DISTINCT purchase_id) AS orders,
                        count(DISTINCT customer_id) AS customers FROM sales_events WHERE {within(30)}""",
    ),
)
def what_if_scenarios(spark, root):
    sales = star.sales_events(spark, root).filter(in_period("event_timestamp", SALES_AS_OF, 30))
    # A purchase has one customer, so two plain reductions count both.
    orders = sales.groupBy("customer_id", "purchase_id").agg(F.sum("revenue").alias("revenue"))
    customers = orders.groupBy("customer_id").agg(F.sum("revenue").alias("revenue"), F.count("*").alias("orders"))
    base = customers.agg(
        F.sum("revenue").alias("revenue"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.count("*").alias("customers")
    )
    return scenario.what_if(scenarios(spark, root), base)
