"""Alert and notification rows. Delivery is left to whatever reads the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: alert rules and message wording -----------------------------
ALERT_RULES = [
    ("revenue_drop_vs_forecast", "sales", "revenue_vs_forecast_percent", "below", -15.0),
    ("revenue_miss_vs_forecast", "revenue", "revenue_vs_forecast_percent", "below", -10.0),
    ("nps_drop", "customer", "nps_change_points", "below", -10.0),
    ("support_volume_spike", "customer", "support_volume_change_percent", "above", 50.0),
    ("revenue_concentration", "revenue", "largest_stream_percent", "above", 40.0),
]
ANOMALY_TITLE = "🚨 Anomaly Detected: %s"
ANOMALY_MESSAGE = """Anomaly detected in %s

Value: %s
Expected: %s
Deviation: %s
Severity: %s
Time: %s"""
ANOMALY_CONTEXT = """

Context: %s"""
RECOMMENDATION_TITLE = "Recommendation: %s"
UNTITLED = "New insight"
NOTICE_MESSAGE = """Summary: %s

Description:
%s

Details:
- Impact: %s
- Urgency: %s
- Effort: %s
- Confidence: %s

Rationale:
%s

Affected Metrics:
%s"""
MISSING = "N/A"
# ---- end of fixed values -------------------------------------------------------

PRIORITIES = ["low", "medium", "high", "critical"]


def _recipients(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _shown(number: Column) -> Column:
    return F.when(number.isNull(), MISSING).otherwise(F.format_string("%.2f", number))


def anomaly_alerts(
    anomalies: DataFrame, metric: str | Column, recipients: Sequence[str] = (), channel: str = "email"
) -> DataFrame:
    """One alert per anomaly; an unknown severity becomes medium priority."""
    name = F.lit(metric) if isinstance(metric, str) else metric
    level = F.coalesce("severity", F.lit("medium"))
    shown = [
        name, _shown(F.col("value")), _shown(F.col("expected_value")), _shown(F.col("deviation")), F.upper(level),
        F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(MISSING)),
    ]
    template = ANOMALY_MESSAGE
    if "context" in anomalies.columns:
        template += ANOMALY_CONTEXT
        shown.append(F.coalesce(F.to_json("context"), F.lit("{}")))
    return anomalies.select(
        F.lit(channel).alias("channel"),
        F.when(level.isin(PRIORITIES), level).otherwise("medium").alias("priority"),
        F.format_string(ANOMALY_TITLE, name).alias("title"),
        F.format_string(template, *shown).alias("message"),
        _recipients(recipients).alias("recipients"),
        F.to_json(F.struct(name.alias("metric"), "value", "score", "severity", "method")).alias("metadata"),
        F.col("ts").alias("timestamp"),
    )


def recommendation_notices(
    recommendations: DataFrame, recipients: Sequence[str] = (), priority: str = "medium"
) -> DataFrame:
    def part(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(MISSING))

    percent = F.format_string("%.0f%%", F.coalesce("confidence", F.lit(0.0)) * 100)
    names = F.array_join(F.coalesce("metrics_affected", F.array().cast("array<string>")), ", ")
    message = F.format_string(
        NOTICE_MESSAGE, part("title"), part("description"), part("impact"), part("urgency"), part("effort"), percent,
        part("rationale"), names,
    )
    return recommendations.select(
        F.lit("email").alias("channel"),
        F.lit(priority).alias("priority"),
        F.format_string(RECOMMENDATION_TITLE, F.coalesce("title", F.lit(UNTITLED))).alias("title"),
        F.rtrim(message).alias("message"),
        _recipients(recipients).alias("recipients"),
        F.to_json(F.struct("recommendation_id")).alias("metadata"),
    )


def notification_stats(log: DataFrame) -> DataFrame:
    """Per priority and in total: notices, delivered, failed and the success rate."""
    rate = F.try_divide(F.count_if("sent"), F.count("*")) * 100
    return log.groupingSets([["priority"], []], "priority").agg(
        F.coalesce(F.when(F.grouping("priority") == 0, F.col("priority")), F.lit("all")).alias("label"),
        F.count("*").alias("total"),
        F.count_if("sent").alias("delivered"),
        F.count_if(~F.col("sent")).alias("failed"),
        F.coalesce(rate, F.lit(0.0)).alias("success_rate"),
    ).drop("priority")


def rule_alerts(measures: DataFrame) -> DataFrame:
    """Rules that the measures (measure, value) break. The rule table is five fixed rows."""
    rules = measures.sparkSession.createDataFrame(
        ALERT_RULES, "rule string, domain string, measure string, direction string, threshold double"
    )
    broken = F.when(F.col("direction") == "below", F.col("value") < F.col("threshold")).otherwise(
        F.col("value") > F.col("threshold")
    )
    return measures.join(F.broadcast(rules), "measure").filter(broken).drop("direction")
