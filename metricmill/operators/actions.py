"""Actions taken on recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmill.functions.scalars import fixed_id
from metricmill.operators.recommend import ID


def create_actions(requests: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Actions with the expected impact of their recommendation; ids follow from the request.

    ``requests`` has (recommendation_id, action_type, description, executor, scheduled_at, created_at).
    Requests for an unknown recommendation are in ``orphans``.
    """
    impact = recommendations.select(ID, F.col("expected_impact_value").alias("expected_impact"))
    content = F.concat_ws("_", ID, "action_type", "description", F.col("created_at").cast("string"))
    return requests.join(impact, ID).select(
        fixed_id("act_", content).alias("action_id"), *requests.columns, "expected_impact",
        F.lit("pending").alias("status"), F.lit(0.0).alias("progress"),
    )


def orphans(requests: DataFrame, recommendations: DataFrame) -> DataFrame:
    return requests.join(recommendations.select(ID), ID, "left_anti")


def record_actions(recommendations: DataFrame, actions: DataFrame) -> DataFrame:
    """Write the newest action's description back to its recommendation."""
    newest = actions.groupBy(ID).agg(
        F.max_by("description", F.struct("created_at", "action_id")).alias("new_action"),
        F.max("created_at").alias("acted_at"),
    )
    taken = F.coalesce("new_action", "action_taken") if "action_taken" in recommendations.columns else F.col("new_action")
    return (
        recommendations.join(newest, ID, "left")
        .withColumns({"action_taken": taken, "updated_at": F.coalesce("acted_at", "updated_at")})
        .drop("new_action", "acted_at")
    )


def action_states(log: DataFrame) -> DataFrame:
    """Current state of each action from its change log.

    The first running entry starts it, the last completed entry ends it and sets the
    progress to 100; result and error keep their last given value.
    Entries of one instant are settled by the larger values.
    """
    entry = log.withColumn(
        "progress", F.when(F.col("status") == "completed", 100.0).otherwise(F.col("progress"))
    )

    def last(column: str) -> Column:
        return F.max(F.when(F.col(column).isNotNull(), F.struct("updated_at", "status", column)))[column]

    return entry.groupBy("action_id").agg(
        F.max(F.struct("updated_at", "status"))["status"].alias("status"),
        F.coalesce(last("progress"), F.lit(0.0)).alias("progress"),
        F.min(F.when(F.col("status") == "running", F.col("updated_at"))).alias("started_at"),
        F.max(F.when(F.col("status") == "completed", F.col("updated_at"))).alias("completed_at"),
        last("result").alias("result"),
        last("error_message").alias("error_message"),
        F.max("updated_at").alias("updated_at"),
    )


def latest_actions(actions: DataFrame, top: int) -> DataFrame:
    return actions.orderBy(F.desc("created_at"), "action_id").limit(top)


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("status").agg(F.count("*").alias("actions"))
