"""Recommendations as a table: scoring, creation, filtering, ranking and lifecycle.

State changes are appended to logs. The current state is a map-side combinable
``max_by`` per id, so an id with very many changes never gathers its history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmill.functions.scalars import composite_score, first_json, fixed_id
from metricmill.functions.texts import CROSS_DOMAIN_ACTION, CROSS_DOMAIN_RULES
from metricmill.functions.timeparts import days_before, instant
from metricmill.schemas import EFFORT_ORDER, EXTRACTED, IMPACT_ORDER, URGENCY_ORDER, lookup

ID = "recommendation_id"


def create(drafts: DataFrame, as_of, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Content id, composite score and defaults; of several drafts with one id the last wins.

    ``updated_at`` orders the drafts when present.
    """
    empty = {
        "stakeholders": F.array().cast("array<string>"),
        "metrics_affected": F.array().cast("array<string>"),
        "tags": F.create_map().cast("map<string,string>"),
        "status": F.lit("pending"),
        "created_at": instant(as_of),
        "updated_at": instant(as_of),
    }
    filled = drafts.withColumns(
        {
            name: F.coalesce(F.col(name), default) if name in drafts.columns else default
            for name, default in empty.items()
        }
    )
    scored = filled.withColumn(ID, fixed_id("rec_", F.concat_ws("_", "title", "description"))).withColumn(
        "composite_score", composite_score(*[F.col(c) for c in ("confidence", "impact", "urgency", "effort")], weights)
    )
    return latest_by_id(scored)


def latest_by_id(rows: DataFrame, key: str = ID, order: str = "updated_at") -> DataFrame:
    """Last write wins; equal times are settled by the larger content hash."""
    columns = [F.col(c) for c in rows.columns if c != key]
    tie = F.xxhash64(*[c for c, t in rows.dtypes if c != key and not t.startswith("map")])
    newest = F.max_by(F.struct(*columns), F.struct(order, tie.alias("tie"))).alias("row")
    return rows.groupBy(key).agg(newest).select(key, "row.*")


def select(
    recommendations: DataFrame,
    domains: Sequence[str] = (),
    insight_types: Sequence[str] = (),
    status: Sequence[str] = (),
    urgency: Sequence[str] = (),
    impact: Sequence[str] = (),
    agent_types: Sequence[str] = (),
    min_confidence: float = 0.0,
    min_score: float = 0.0,
    stakeholders: Sequence[str] = (),
    tags: Mapping[str, str] | None = None,
    created_from=None,
    created_to=None,
) -> DataFrame:
    """All given conditions; an empty or zero argument means no condition."""
    picked = recommendations
    for column, wanted in (
        ("domain", domains), ("insight_type", insight_types), ("status", status), ("urgency", urgency),
        ("impact", impact), ("source.agent_type", agent_types),
    ):
        if wanted:
            picked = picked.filter(F.col(column).isin(list(wanted)))
    if min_confidence:
        picked = picked.filter(F.col("confidence") >= min_confidence)
    if min_score:
        picked = picked.filter(F.col("composite_score") >= min_score)
    if stakeholders:
        picked = picked.filter(F.arrays_overlap("stakeholders", F.array(*[F.lit(s) for s in stakeholders])))
    for key, value in (tags or {}).items():
        picked = picked.filter(F.try_element_at("tags", F.lit(key)) == value)
    if created_from is not None:
        picked = picked.filter(F.col("created_at") >= instant(created_from))
    if created_to is not None:
        picked = picked.filter(F.col("created_at") <= instant(created_to))
    return picked


def by_id(recommendations: DataFrame, recommendation_id: str) -> DataFrame:
    return recommendations.filter(F.col(ID) == recommendation_id)


def confident(recommendations: DataFrame, threshold: float = 0.7) -> DataFrame:
    return recommendations.filter(F.col("confidence") >= threshold)


def page(picked: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, best score first. The total is ``picked.count()``."""
    ordered = picked.orderBy(F.desc("composite_score"), ID)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_with_total(picked: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page whose rows also carry the number of rows there are."""
    total = picked.agg(F.count("*").alias("total")).scalar()
    return page(picked, limit, offset).withColumn("total", total)


def best(recommendations: DataFrame, top: int) -> DataFrame:
    return page(recommendations, top)


def stakeholder_tier() -> Column:
    def any_of(*words: str) -> Column:
        return F.exists(
            "stakeholders",
            lambda s: F.lower(s).contains(words[0]) | F.lower(s).contains(words[1]),
        )

    return F.when(any_of("executive", "ceo"), 0).when(any_of("manager", "director"), 1).otherwise(2)


def prioritize(recommendations: DataFrame, strategy: str, limit: int) -> DataFrame:
    """The first ``limit`` by the chosen order; a top-k, never a full sort. Unknown strategies keep no order."""
    score = F.desc("composite_score")
    orders = {
        "score_based": [score, F.desc("confidence")],
        "urgency_first": [lookup(URGENCY_ORDER, F.col("urgency"), 4).asc(), score],
        "impact_first": [lookup(IMPACT_ORDER, F.col("impact"), 3).asc(), score],
        "effort_aware": [lookup(EFFORT_ORDER, F.col("effort"), 3).asc(), score],
        "stakeholder": [stakeholder_tier().asc(), score],
    }
    return recommendations.orderBy(*orders.get(strategy, []), ID).limit(limit)


def ranked(recommendations: DataFrame, top: int) -> DataFrame:
    """The top of all domains by urgency, then score, with its rank put in the tags.

    The ranking window covers the ``top`` rows that are left after the top-k.
    """
    order = [lookup(URGENCY_ORDER, F.col("urgency"), 4).asc(), F.desc("composite_score"), F.asc(ID)]
    rank = F.row_number().over(Window.orderBy(*order))
    rows = recommendations.orderBy(*order).limit(top).withColumn("rank", rank)
    kept = F.map_filter("tags", lambda k, v: k != "orchestrator_rank")
    return rows.withColumn(
        "tags", F.map_concat(kept, F.create_map(F.lit("orchestrator_rank"), F.col("rank").cast("string")))
    )


def filtered_view(
    recommendations: DataFrame, urgency: Sequence[str] = (), domains: Sequence[str] = (), status: Sequence[str] = ()
) -> DataFrame:
    """Filter for display, most urgent first."""
    picked = select(recommendations, domains=domains, status=status, urgency=urgency)
    return picked.orderBy(lookup(URGENCY_ORDER, F.col("urgency"), 4), ID)


def statistics(recommendations: DataFrame) -> DataFrame:
    """Counts by status, domain and urgency and the overall means, in one pass."""
    names = ["status", "domain", "urgency"]
    which = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in names], F.lit("total"))
    grouped = recommendations.groupingSets([[c] for c in names] + [[]], *names)
    return grouped.agg(
        which.alias("breakdown"),
        F.coalesce(*names, F.lit("all")).alias("label"),
        F.count("*").alias("recommendations"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("composite_score").alias("avg_score"),
    ).drop(*names)


def urgency_counts(recommendations: DataFrame) -> DataFrame:
    """One column per urgency level."""
    return recommendations.agg(
        *[F.count_if(F.col("urgency") == level).alias(level) for level in URGENCY_ORDER]
    )


def status_counts(recommendations: DataFrame) -> DataFrame:
    wanted = {"pending": "pending", "approved": "approved", "completed": "completed", "dismissed": "rejected"}
    return recommendations.agg(
        *[F.count_if(F.col("status") == status).alias(name) for name, status in wanted.items()]
    )


def analysis_confidence(recommendations: DataFrame, metric_rows: DataFrame) -> DataFrame:
    """Per domain: mean confidence, lowered for thin data; 0.5 without recommendations.

    ``metric_rows`` has (domain, rows), the number of metric rows the analysis saw.
    """
    means = recommendations.groupBy("domain").agg(F.avg("confidence").alias("mean"))
    quality = F.when(F.col("rows") < 10, 0.7).when(F.col("rows") < 50, 0.85).otherwise(1.0)
    confidence = F.when(F.col("mean").isNotNull(), F.least(F.col("mean") * quality, F.lit(1.0)))
    return metric_rows.join(means, "domain", "left").select(
        "domain", F.coalesce(confidence, F.lit(0.5)).alias("confidence")
    )


# -- lifecycle -------------------------------------------------------------------


def apply_status_log(recommendations: DataFrame, log: DataFrame) -> DataFrame:
    """Current rows after all status changes; feedback and impact keep their last given value.

    Entries of one instant are settled by the larger values, so a rerun gives the same state.
    """
    def last(column: str, given: Column) -> Column:
        return F.max(F.when(given, F.struct("updated_at", "status", column)))[column]

    state = log.groupBy(ID).agg(
        F.max(F.struct("updated_at", "status"))["status"].alias("new_status"),
        last("feedback", F.length("feedback") > 0).alias("new_feedback"),
        last("actual_impact", F.col("actual_impact").isNotNull()).alias("new_impact"),
        F.max("updated_at").alias("new_time"),
    )
    joined = recommendations.join(state, ID, "left")
    updates = {"status": "new_status", "feedback": "new_feedback", "actual_impact": "new_impact", "updated_at": "new_time"}
    present = {
        old: F.coalesce(new, old) if old in recommendations.columns else F.col(new) for old, new in updates.items()
    }
    return joined.withColumns(present).drop(*updates.values())


def feedback_tallies(log: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Successes and failures per domain by the sign of the measured impact.

    The log is reduced per id before the join, so a busy id joins as one row.
    """
    measured = log.filter(F.col("actual_impact").isNotNull()).groupBy(ID).agg(
        F.count_if(F.col("actual_impact") > 0).alias("success"),
        F.count_if(F.col("actual_impact") <= 0).alias("failure"),
    )
    return (
        measured.join(recommendations.select(ID, "domain"), ID)
        .groupBy("domain")
        .agg(F.sum("success").alias("success"), F.sum("failure").alias("failure"))
    )


def expire(recommendations: DataFrame, as_of, hours: float = 168) -> DataFrame:
    """Archive pending rows created more than ``hours`` ago; ``expired`` marks them."""
    old = (F.col("status") == "pending") & (F.col("created_at") < days_before(as_of, hours / 24))
    return recommendations.withColumn("expired", old).withColumns(
        {
            "status": F.when(F.col("expired"), "archived").otherwise(F.col("status")),
            "updated_at": F.when(F.col("expired"), instant(as_of)).otherwise(F.col("updated_at")),
        }
    )


def board(recommendations: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best pending rows of every urgency level, best first.

    Ranked within slices of a level first, so that a level with a third of all rows is no single task.
    """
    order = [F.desc("composite_score"), F.asc(ID)]
    pending = recommendations.filter(F.col("status") == "pending").withColumn("slice", F.pmod(F.xxhash64(ID), F.lit(64)))
    in_slice = Window.partitionBy("urgency", "slice").orderBy(*order)
    in_level = Window.partitionBy("urgency").orderBy(*order)
    top = pending.withColumn("place", F.row_number().over(in_slice)).filter(F.col("place") <= limit)
    top = top.withColumn("place", F.row_number().over(in_level)).filter(F.col("place") <= limit)
    entry = F.struct((-F.col("composite_score")).alias("order"), ID, "title", "domain")
    return top.groupBy("urgency").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


# -- extraction and cross-domain -------------------------------------------------


def extract(analyses: DataFrame, max_items: int | None = None, threshold: float = 0.7,
            weights: Mapping[str, float] | None = None) -> DataFrame:
    """Recommendations out of text that holds a JSON object: all are scored, the confident ones returned.

    With ``max_items`` only so many of one text are, the best by score. Text without JSON gives none.
    """
    parsed = F.from_json(first_json(F.col("text")), EXTRACTED)["recommendations"]
    items = analyses.select("analysis_id", "domain", F.posexplode(parsed).alias("place", "item"))
    items = items.select("analysis_id", "domain", "place", "item.*")
    score = composite_score(*[F.col(c) for c in ("confidence", "impact", "urgency", "effort")], weights)
    good = confident(items.withColumn("composite_score", score), threshold)
    if max_items is not None:  # a text's own items, as many as the text lists
        best_first = Window.partitionBy("analysis_id").orderBy(F.desc("composite_score"), "place")
        good = good.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= max_items).drop("rank")
    return good.drop("place").withColumnRenamed("summary", "title")


def domain_summary(recommendations: DataFrame) -> DataFrame:
    return recommendations.groupBy("domain").agg(
        F.count("*").alias("recommendation_count"), F.avg("confidence").alias("confidence")
    )


def cross_domain_opportunities(results: DataFrame) -> DataFrame:
    """Rules of which at least two domains have results. The rule table is three fixed rows."""
    spark = results.sparkSession
    rules = spark.createDataFrame(
        CROSS_DOMAIN_RULES, "name string, domains array<string>, description string, related_metrics array<string>"
    )
    # Domain names only: the distinct labels, not the rows, are gathered.
    present = results.select("domain").distinct().agg(F.collect_list("domain").alias("present")).scalar()
    seen = F.filter("domains", lambda d: F.array_contains("present", d))
    return (
        rules.withColumn("present", present)
        .withColumn("relevant_domains", seen)
        .drop("present")
        .filter(F.size("relevant_domains") >= 2)
        .withColumn("action", F.lit(CROSS_DOMAIN_ACTION))
    )


def key_findings(metric_rows: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Per domain: how many metric rows were analysed and how many points were unusual."""
    counts = metric_rows.groupBy("domain").agg(F.count("*").alias("records"))
    if anomalies is not None:
        odd = anomalies.groupBy("domain").agg(F.count("*").alias("anomalies"))
        counts = counts.join(odd, "domain", "left").na.fill(0, ["anomalies"])
    else:
        counts = counts.withColumn("anomalies", F.lit(0).cast("bigint"))
    findings = F.array(
        F.when(F.col("records") > 0, F.format_string("Analyzed %d metric records", "records")),
        F.when(F.col("anomalies") > 0, F.format_string("Detected %d anomalous data points", "anomalies")),
    )
    return counts.withColumn("key_findings", F.filter(findings, lambda x: x.isNotNull()))
