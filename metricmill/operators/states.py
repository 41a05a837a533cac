"""Mergeable states of measures: what a slot of time knows, from which any longer period follows.

A state holds, for a slot (an hour or a day) and keys, the number of events and per measure the number of
values, their sum, the sum of squared deviations from their mean, the smallest and the largest. States of
several slots, keys or batches merge into the state of all of them without error (but rounding). Ranks
come from a second table of the same kind: counts of values in bins whose bounds grow by a fixed ratio, which
merge by addition.

The tables lie under a commit log and are written per batch: a new batch adds states, a batch that is
written again replaces its own, and no event is read twice.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricmill.functions.timeparts import bucket_start, in_period, period_days
from metricmill.sources import commits
from metricmill.sources.tables import day_range

TS = "event_timestamp"
SLOT = "slot"
SECONDS = {"hourly": 3600, "daily": 86400}
# Bins of positive values have numbers from about -38,000 to 36,000 at the default ratio; this keeps the signs apart.
OFFSET = 1_000_000


def states_of(events: DataFrame, measures: Mapping[str, str | Column], keys: Sequence[str] = (), grain: str = "hourly") -> DataFrame:
    """(slot, keys, events, <m>_n, <m>_sum, <m>_m2, <m>_min, <m>_max): one row per slot and keys that occur.

    Null values of a measure do not count in its state; null keys and times are groups of their own.
    """
    columns = [F.count("*").alias("events")]
    for name, value in measures.items():
        own = F.col(value) if isinstance(value, str) else value
        v = own.cast("double")
        columns += [
            F.count(v).alias(f"{name}_n"), F.sum(v).alias(f"{name}_sum"), (F.var_pop(v) * F.count(v)).alias(f"{name}_m2"),
            F.min(own).alias(f"{name}_min"), F.max(own).alias(f"{name}_max"),
        ]
    return events.groupBy(bucket_start(F.col(TS), grain).alias(SLOT), *keys).agg(*columns)


def write_states(
    events: DataFrame, path: str, batch: str | int, measures: Mapping[str, str | Column], keys: Sequence[str] = (), grain: str = "hourly"
) -> None:
    """Add the states of a batch of events to a table, in place of those it had."""
    write_slots(states_of(events, measures, keys, grain), path, batch)


def write_slots(rows: DataFrame, path: str, batch: str | int) -> None:
    """Add a batch's rows with a slot to a table, in place of those it had. States are small, so a month is one folder."""
    placed = rows.withColumns({commits.DAY: F.to_date(F.date_trunc("month", SLOT)), "batch": F.lit(str(batch))})
    _, replaced = commits.write(placed, path, "batch", [str(batch)])
    commits.drop_dead(rows.sparkSession, path, replaced)


def read_states(spark: SparkSession, path: str, as_of=None, period: str | float | None = None, grain: str = "hourly") -> DataFrame:
    """States of all slots, or of those in a period, from the files of its months. A slot has a row per batch.

    A period that begins or ends within a slot cannot be answered and is refused.
    """
    if period is None:
        return commits.read(spark, path).drop("event_date", "batch")
    days = day_range(as_of, period)
    if days:
        end = datetime.fromisoformat(str(as_of))
        start = end - timedelta(days=period_days(period))
        if any((t - datetime(1970, 1, 1)).total_seconds() % SECONDS[grain] for t in (start, end)):
            raise ValueError(f"the period from {start} to {end} does not consist of {grain} slots")
        days = (f"{days[0][:8]}01", days[1])
    rows = commits.read(spark, path, days).filter(in_period(SLOT, as_of, period))
    if days:
        rows = rows.filter(F.col("event_date").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")))
    return rows.drop("event_date", "batch")


def merged(states: DataFrame, measures: Sequence[str], by: Mapping[str, Column]) -> DataFrame:
    """The states of larger groups: (names of ``by``, events, and the columns of the measures); states again.

    Squared deviations add up once each state's mean is compared with the group's, which a first
    aggregate of the states gives. With an empty ``by`` there is one row, also for no states.
    """
    names = list(by)
    rows = states.withColumns({f"__{n}": c for n, c in by.items()})
    groups = [F.col(f"__{n}").alias(n) for n in names]
    sums = [F.sum("events").alias("events")]
    for m in measures:
        sums += [F.sum(f"{m}_n").alias(f"{m}_n"), F.sum(f"{m}_sum").alias(f"{m}_sum"), F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max")]
    whole = rows.groupBy(*groups).agg(*sums)
    centres = whole.select(
        *[F.col(n).alias(f"__of_{n}") for n in names], *[F.try_divide(f"{m}_sum", f"{m}_n").alias(f"__mean_{m}") for m in measures]
    )
    off = {m: F.try_divide(f"{m}_sum", f"{m}_n") - F.col(f"__mean_{m}") for m in measures}
    spread = [F.sum(F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_m2") + F.col(f"{m}_n") * off[m] * off[m])).alias(f"{m}_m2") for m in measures]
    if not names:
        means = centres.first()
        held = rows.withColumns({f"__mean_{m}": F.lit(means[f"__mean_{m}"]).cast("double") for m in measures})
        one = held.agg(*sums, *spread)
        return one.withColumn("events", F.coalesce("events", F.lit(0)))
    same = [F.col(f"__{n}").eqNullSafe(F.col(f"__of_{n}")) for n in names]
    about = rows.join(centres, same).groupBy(*[F.col(f"__{n}").alias(f"__of_{n}") for n in names]).agg(*spread)
    joined = whole.join(about, [F.col(n).eqNullSafe(F.col(f"__of_{n}")) for n in names])
    return joined.drop(*[f"__of_{n}" for n in names])


def average(m: str) -> Column:
    return F.try_divide(f"{m}_sum", f"{m}_n")


def deviation(m: str) -> Column:
    """Sample deviation; null for fewer than two values."""
    return F.when(F.col(f"{m}_n") > 1, F.sqrt(F.col(f"{m}_m2") / (F.col(f"{m}_n") - 1)))


AGGREGATES = {
    "avg": average, "sum": lambda m: F.col(f"{m}_sum"), "min": lambda m: F.col(f"{m}_min"), "max": lambda m: F.col(f"{m}_max"),
    "count": lambda m: F.col(f"{m}_n"), "stddev": deviation,
}


def trends(states: DataFrame, metric: str, period: str = "daily") -> DataFrame:
    """The rows of ``metrics.trends`` from the states of a period."""
    rows = merged(states, [metric], {"period": bucket_start(F.col(SLOT), period)})
    return rows.select(
        "period", average(metric).alias("avg_value"), F.col(f"{metric}_min").alias("min_value"), F.col(f"{metric}_max").alias("max_value"),
        F.col("events").alias("count"), deviation(metric).alias("std_dev"),
    ).orderBy(F.desc("period"))


def daily_metrics(states: DataFrame, metrics: Mapping[str, tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """The rows of ``metrics.daily_metrics`` from states; ``metrics`` maps a name to (measure, aggregate)."""
    used = sorted({m for m, _ in metrics.values()})
    rows = merged(states, used, {"date": F.to_date(SLOT)} | {k: F.col(k) for k in keys})
    return rows.select("date", *keys, *[AGGREGATES[how](m).alias(name) for name, (m, how) in metrics.items()]).orderBy(F.desc("date"), *keys)


def compare_periods(states: DataFrame, metrics: Mapping[str, tuple[str, str]], cut: Column) -> DataFrame:
    """(metric, current_value, previous_value, absolute_change, percent_change, trend) of two adjacent periods.

    ``cut`` is where the current one begins; a period without states has nulls.
    """
    used = sorted({m for m, _ in metrics.values()})
    sides = merged(states, used, {"current": F.col(SLOT) >= cut})
    rows = F.array(*[
        F.struct(F.lit(name).alias("metric"), AGGREGATES[how](m).cast("double").alias("value")) for name, (m, how) in metrics.items()
    ])
    long = sides.select("current", F.inline(rows))
    both = long.groupBy("metric").agg(
        F.max(F.when(F.col("current"), F.col("value"))).alias("current_value"),
        F.max(F.when(~F.col("current"), F.col("value"))).alias("previous_value"),
    )
    change = F.col("current_value") - F.col("previous_value")
    return (
        both.withColumn("absolute_change", change)
        .withColumn("percent_change", F.try_divide(change, F.nullif("previous_value", F.lit(0.0))) * 100)
        .withColumn("trend", F.when(F.col("percent_change") > 0, "up").otherwise("down"))
    )


def series(states: DataFrame, keys: Sequence[str], metric: str, grain: str, how: str = "sum", label: str = "all") -> DataFrame:
    """Series (series_key, ts, value) as ``metrics.rollup_series`` makes them from events; every series operator takes it."""
    key = F.concat_ws("|", *keys) if keys else F.lit(label)
    rows = merged(states, [metric], {"series_key": key, "ts": bucket_start(F.col(SLOT), grain)})
    return rows.select("series_key", "ts", AGGREGATES[how](metric).cast("double").alias("value")).filter(F.col("value").isNotNull())


def bin_of(value: Column, ratio: float) -> Column:
    """Number of the bin of a finite value: ascending with it, 0 for zero."""
    steps = F.log(F.abs(value)) / math.log(ratio)
    size = F.ceil(F.greatest(F.least(steps, F.lit(OFFSET / 2)), F.lit(-OFFSET / 2))) + OFFSET
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def bin_value(number: Column, ratio: float) -> Column:
    """The value that stands for a bin: at most (ratio - 1) / (ratio + 1) of any value in it away from that value."""
    middle = F.pow(F.lit(ratio), F.abs(number) - OFFSET) * (2 / (1 + ratio))
    return F.when(number > 0, middle).when(number < 0, -middle).otherwise(F.lit(0.0))


def bins_of(events: DataFrame, value: str | Column, keys: Sequence[str] = (), grain: str = "daily", ratio: float = 1.02) -> DataFrame:
    """(slot, keys, bin, n): how many values of a slot lie in each bin. Nulls and values that are not finite are left out."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = events.select(bucket_start(F.col(TS), grain).alias(SLOT), *keys, v.alias("__v"))
    finite = F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf"))
    return rows.filter(finite).groupBy(SLOT, *keys, bin_of(F.col("__v"), ratio).alias("bin")).agg(F.count("*").alias("n"))


def quantiles(bins: DataFrame, by: Sequence[str], probs: Mapping[str, float], ratio: float = 1.02) -> DataFrame:
    """(by, n, one column per entry of ``probs``): the value at rank floor(p * (n - 1)), within the bins' ratio.

    Bins of all slots, keys and batches add up first; what is ordered then are the bins of a group, whose
    number the ratio bounds (some 75,000 for each sign, a few hundred in practice).
    """
    together = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by)
    counted = together.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))

    def at(p: float) -> Column:
        rank = F.floor(F.lit(p) * (F.col("total") - 1))
        return F.min(F.when(F.col("upto") > rank, F.col("bin")))

    found = counted.groupBy(*by).agg(F.max("total").alias("n"), *[at(p).alias(name) for name, p in probs.items()])
    return found.select(*by, "n", *[bin_value(F.col(name), ratio).alias(name) for name in probs])
