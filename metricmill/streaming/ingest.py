"""Structured Streaming over the batch validation and enrichment."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metricmill.operators import ingest
from metricmill.sources import commits, tables

COUNTERS = "ingest"
BatchHook = Callable[[DataFrame, int], None]


def read_message_files(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Lines of JSON text dropped in a folder; the checkpoint is the acknowledgement."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def read_message_bus(spark: SparkSession, options: Mapping[str, str], max_messages: int = 100_000) -> DataFrame:
    """Kafka topics as text; needs the Kafka connector on the classpath."""
    stream = spark.readStream.format("kafka").options(**options).option("maxOffsetsPerTrigger", max_messages)
    return stream.load().select(F.col("value").cast("string"))


def checked(messages: DataFrame, as_of=None) -> DataFrame:
    """Parsed and validated messages; the counters are read from the query's progress."""
    now = as_of if as_of is not None else F.current_timestamp()
    return ingest.validate(ingest.parse_messages(messages), now, COUNTERS)


def start_ingest(
    messages: DataFrame,
    target: str,
    checkpoint: str,
    as_of=None,
    window_seconds: int | None = 10,
    on_batch: BatchHook | None = None,
    on_error: BatchHook | None = None,
    name: str = "stream",
    distinct: bool = False,
) -> StreamingQuery:
    """Write good events to a day-partitioned table and refused ones to quarantine, once per micro-batch.

    A batch is a commit of the event table (``sources/tables.py``, partitioned by day and type) under ``name`` and its number, so
    a replay after a lost driver replaces what the lost run wrote, and readers see whole batches only. Quarantine
    and counters have a folder per batch, which a replay overwrites. ``window_seconds`` is the flush
    interval; None reads what is there and stops. The hooks get the enriched and the refused rows of a batch.
    With ``distinct`` an event whose id is in the table already, however long ago it came, is not written again.
    """
    def flush(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good = ingest.enrich(ingest.valid_rows(batch), as_of if as_of is not None else F.current_timestamp())
            bad = ingest.invalid_rows(batch)
            if distinct:
                good = tables.unseen(good, f"{target}/events", f"{name}-{batch_id}")
            tables.write_events(good, f"{target}/events", f"{name}-{batch_id}", ("event_type",))
            bad.write.mode("overwrite").parquet(f"{target}/quarantine/batch_id={batch_id}")
            _counts(batch).write.mode("overwrite").parquet(f"{target}/counters/batch_id={batch_id}")
            if on_batch:
                on_batch(good, batch_id)
            if on_error:
                on_error(bad, batch_id)
        finally:
            batch.unpersist()

    writer = checked(messages, as_of).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    if window_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{window_seconds} seconds").start()


def _counts(batch: DataFrame) -> DataFrame:
    ok = F.size("errors") == 0
    return batch.agg(
        F.count("*").alias("received"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed")
    )


def ingest_counters(spark: SparkSession, target: str) -> DataFrame:
    """One row of totals over all batches ever written; each batch has its row beside its events."""
    names = ["received", "processed", "failed"]
    rows = spark.read.parquet(f"{target}/counters")
    return rows.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])


def window_counts(events: DataFrame, ts: str = "event_timestamp", window: str = "10 seconds",
                  late: str | None = None) -> DataFrame:
    """Events per event-time window and type.

    Every event counts, in whatever order files arrive; the state keeps a row per window and type. An
    endless stream may bound the state by ``late``: arrivals later than that are then not counted.
    """
    return (
        (events.withWatermark(ts, late) if late else events)
        .groupBy(F.window(ts, window).alias("w"), "event_type")
        .agg(F.count("*").alias("events"))
        .select(F.col("w.start").alias("window_start"), "event_type", "events")
    )


def start_window_counts(
    events: DataFrame, target: str, checkpoint: str, ts: str = "event_timestamp", window: str = "10 seconds",
    available_now: bool = False, name: str = "stream",
) -> StreamingQuery:
    """Counts per window and type of a stream whose rows may be late by any time.

    Every micro-batch commits its own counts, which add up (``read_window_counts``), so no state is kept and a late row is
    counted like any other; a batch that is replayed replaces its counts.
    """
    def flush(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.window(ts, window)["start"].alias("window_start"), "event_type").agg(F.count("*").alias("events"))
        rows = counts.withColumns({commits.DAY: F.to_date("window_start"), "batch": F.lit(f"{name}-{batch_id}")})
        _, replaced = commits.write(rows, target, "batch", [f"{name}-{batch_id}"])
        commits.drop_dead(batch.sparkSession, target, replaced)

    writer = events.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return writer.trigger(**trigger).start()


def read_window_counts(spark: SparkSession, target: str, days: tuple[str, str] | None = None) -> DataFrame:
    """The counts of all batches so far, or of windows that begin on the days from first to last."""
    rows = commits.read(spark, target, days)
    return rows.groupBy("window_start", "event_type").agg(F.sum("events").alias("events"))


def without_repeats(events: DataFrame, ts: str = "event_timestamp", late: str = "10 minutes") -> DataFrame:
    """Drop events whose deterministic id was seen within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(["event_id"])


def start_updates(
    rows: DataFrame, target: str, checkpoint: str, available_now: bool = False, mode: str = "update"
) -> StreamingQuery:
    """Write changing aggregates, or rows as they come (``append``), as one folder per batch.

    ``latest`` reads the current values of aggregates.
    """
    def flush(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    writer = rows.writeStream.outputMode(mode).foreachBatch(flush).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return writer.trigger(**trigger).start()


def latest(spark: SparkSession, target: str, keys: list[str], value: str) -> DataFrame:
    return spark.read.parquet(target).groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))


def channel_rows(metrics: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Live updates as rows of one table: ``metrics:<domain>`` and ``alerts`` channels.

    ``metrics`` has (domain, metric, value, ts); ``alerts`` has (payload, ts) with JSON text.
    """
    updates = metrics.select(
        F.concat(F.lit("metrics:"), "domain").alias("channel"),
        F.lit("metric_update").alias("type"),
        F.to_json(F.struct("metric", "value", "domain", F.col("ts").alias("timestamp"))).alias("data"),
        "ts",
    )
    if alerts is None:
        return updates
    return updates.unionByName(
        alerts.select(F.lit("alerts").alias("channel"), F.lit("alert").alias("type"), F.col("payload").alias("data"), "ts")
    )
