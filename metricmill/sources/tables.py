"""Event and metric tables partitioned by day: written per batch, compacted, read by period.

Files lie in folders ``event_date=...`` and belong to the table once the commit log lists them
(``sources/commits.py``). Writing a batch again replaces all its rows, whatever days the new rows have; a
period read opens only files of its days. The daily metric tables are computed from the event tables for
the days that a batch touched, a day without events included.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmill.functions.timeparts import days_before, in_period, instant, period_days
from metricmill.sources import commits

TS = "event_timestamp"
# Batches with less than this are gathered by ``fold``.
SMALL = 256 * 1024 * 1024


def write_events(
    events: DataFrame, path: str, batch: str | int, folders: Sequence[str] = (), keep_replaced: bool = False
) -> list[str]:
    """Add a batch of events, or replace it if it was written before; the days whose events changed.

    Rows are dealt by day; days that hold much of the batch are split over several files. Events
    without a time lie under the day ``__HIVE_DEFAULT_PARTITION__``. ``folders`` are columns to partition by
    below the day. The files that held replaced rows only are deleted, unless ``keep_replaced`` leaves them to
    readers that are still at them (``commits.vacuum`` deletes them later).
    """
    spark = events.sparkSession
    rows = events.withColumn("event_date", F.to_date(TS)).withColumn("batch", F.lit(str(batch)))
    made, replaced = commits.write(rows, path, "batch", [str(batch)], ("event_date", *folders))
    if not keep_replaced:
        commits.drop_dead(spark, path, replaced)
    return sorted(commits.touched_days([made, *replaced]))


def unseen(events: DataFrame, path: str, batch: str | int) -> DataFrame:
    """``events`` without those whose ``event_id`` another batch of the table holds, and each id once.

    Only days that the events lie on are searched: an id stands for its event's time too. Rows of the batch itself do
    not count, so a replay keeps what it wrote.
    """
    spark = events.sparkSession
    once = events.dropDuplicates(["event_id"])
    try:
        days = [r[0] for r in once.select(F.to_date(TS)).distinct().collect()]  # a calendar
        named = sorted(str(d) if d else commits.NO_DAY for d in days)
        held = commits.read(spark, path, (named[0], named[-1]) if named else ("", ""))
    except FileNotFoundError:  # the first batch
        return once
    known = held.filter(F.col("batch") != F.lit(str(batch))).select("event_id")
    return once.join(known, "event_id", "left_anti").select(*events.columns)


def fold(spark: SparkSession, path: str, small: int = SMALL) -> int:
    """Gather the batches that hold less than ``small`` bytes into one commit; how many there were.

    Their rows keep their batch, so a folded batch can still be replaced. Larger batches are not copied.
    """
    little = [c for c in commits.log(spark, path) if c.live and sum(size for _, _, size in c.files) < small]
    names = [key for c in little for key in c.covers if key not in c.dead]
    if len(little) > 1:
        rows = commits.read(spark, path).filter(F.col("batch").isin(names))
        commits.write(rows, path, "fold", names)
    return len(little)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """A copy of an event table with the batches of each day in as few files as their size allows."""
    rows = commits.read(spark, path)
    names = [key for c in commits.log(spark, path) if c.live for key in c.covers if key not in c.dead]
    commits.write(rows, target, "fold", names)


def day_range(as_of, period: str | float) -> tuple[str, str] | None:
    """First and last day of a period as text; None if ``as_of`` is known to Spark only."""
    if isinstance(as_of, Column):
        return None
    end = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(str(as_of))
    return str((end - timedelta(days=period_days(period))).date()), str(end.date())


def read_events(spark: SparkSession, path: str, as_of=None, period: str | float | None = None) -> DataFrame:
    """Events of a table, or of a period: only files of its days are listed, the times within them filter rows."""
    if period is None:
        return commits.read(spark, path).drop("event_date", "batch")
    rows = commits.read(spark, path, day_range(as_of, period))
    first = F.to_date(days_before(as_of, period_days(period)))
    days = F.col("event_date").between(first, F.to_date(instant(as_of)))
    return rows.filter(days & in_period(TS, as_of, period)).drop("event_date", "batch")


def write_daily_metrics(
    spark: SparkSession, events_path: str, path: str, keys: list[str], measures: dict[str, str],
    days: DataFrame | Sequence[str | date] | None = None,
) -> None:
    """Daily sums and counts per key; only ``days`` (a list, or a frame with event_date) are computed anew, else all.

    A day that has no events any more has no rows any more.
    """
    sums = {name: F.sum(F.col(column).cast("double")) for name, column in measures.items()}
    write_days(
        spark, events_path, path, days, lambda rows: rows.groupBy("event_date", *keys).agg(
            F.count("*").alias("events"), *[column.alias(name) for name, column in sums.items()]
        )
    )


def write_days(spark: SparkSession, events_path: str, path: str, days, reduce) -> None:
    """Replace days of a table by what ``reduce`` makes of their events (event_date stays)."""
    if isinstance(days, DataFrame):
        days = [r[0] for r in days.select("event_date").distinct().collect()]  # a calendar
    if days is None:
        known = commits.log(spark, path)
        days = commits.touched_days(c for c in commits.log(spark, events_path) if c.live) | {k for c in known for k in c.covers}
    covers = sorted({commits.NO_DAY if d is None else str(d) for d in days})
    rows = commits.read(spark, events_path, (covers[0], covers[-1]) if covers else ("", ""))
    named = [d for d in covers if d != commits.NO_DAY]
    inside = F.col("event_date").isin([date.fromisoformat(d) for d in named]) if named else F.lit(False)
    if commits.NO_DAY in covers:
        inside = inside | F.col("event_date").isNull()
    commits.write(reduce(rows.filter(inside)), path, "day", covers)


def read_daily_metrics(spark: SparkSession, path: str, as_of=None, period: str | float | None = None) -> DataFrame:
    """Days of a metric table that begin within the period."""
    if period is None:
        return commits.read(spark, path)
    rows = commits.read(spark, path, day_range(as_of, period))
    first = F.to_date(days_before(as_of, period_days(period)))
    return rows.filter((F.col("event_date") >= first) & (F.col("event_date") < F.to_date(instant(as_of))))
