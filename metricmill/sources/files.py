"""File, database and stream readers, and file sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmill.operators.ingest import LANDED, landed


def read_csv_events(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """CSV with a header; columns are matched by name and stay text until validated."""
    return landed(spark.read.option("header", True).csv(path), kind)


def read_json_payload(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed service responses ``{"data": [...]}``; a lone object counts as a list of one."""
    responses = spark.read.schema("data STRING").option("multiLine", True).json(path)
    text = F.when(F.ltrim("data").startswith("["), F.col("data")).otherwise(
        F.concat(F.lit("["), F.col("data"), F.lit("]"))
    )
    items = responses.select(F.inline(F.from_json(text, f"array<{LANDED.simpleString()}>")))
    return landed(items, kind)


def read_database(spark: SparkSession, url: str, table: str, kind: str, **options) -> DataFrame:
    """Any JDBC source; give partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return landed(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), kind)


def ingest_from(spark: SparkSession, source: Mapping[str, str]) -> DataFrame:
    """Rows of a described source: ``type`` is csv, api (landed responses) or database."""
    kind = source.get("event_type", "system")
    if source.get("type") in ("csv", "api") and not source.get("path"):
        raise ValueError("path is required")
    if source.get("type") == "csv":
        return read_csv_events(spark, source["path"], kind)
    if source.get("type") == "api":
        return read_json_payload(spark, source["path"], kind)
    if source.get("type") == "database":
        rest = {k: v for k, v in source.items() if k not in ("type", "event_type", "url", "table")}
        return read_database(spark, source["url"], source["table"], kind, **rest)
    raise ValueError(f"unknown source type: {source.get('type')}")


def write_json_by_type(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    events.write.mode(mode).partitionBy("event_type").json(path)


def write_csv_by_type(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    events.write.mode(mode).partitionBy("event_type").option("header", True).csv(path)


def export_with_summary(tables: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> DataFrame:
    """Export tables and, beside them in ``summary``, one row per table: name, records, columns, folder.

    Records are counted in the files that were written, not in the frames once more.
    """
    targets = export_tables(tables, path, mode)
    rows = None
    for name, folder in targets.items():
        frame = tables[name]
        row = frame.sparkSession.read.schema(frame.schema).json(folder).agg(
            F.lit(name).alias("name"), F.count("*").alias("records"),
            F.lit(len(frame.columns)).alias("columns"), F.lit(name).alias("folder"),
        )
        rows = row if rows is None else rows.unionByName(row)
    if rows is None:
        raise ValueError("nothing to export")
    rows.write.mode(mode).json(f"{path.rstrip('/')}/summary")
    return rows.sparkSession.read.schema(rows.schema).json(f"{path.rstrip('/')}/summary")


def export_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> dict[str, str]:
    """Each table as JSON in its own folder; returns the folders."""
    targets = {name: f"{path.rstrip('/')}/{name}" for name in tables}
    for name, frame in tables.items():
        frame.write.mode(mode).json(targets[name])
    return targets
