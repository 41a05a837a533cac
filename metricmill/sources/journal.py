"""The state of recommendations as a journal: of all status changes, the few that still decide it.

The entries that decide a recommendation's status, feedback and impact are the latest of each, three at most. They lie
in buckets by id under a commit log; a new batch of changes is merged with the entries of the buckets it
touches, and those are written anew. Merging is the same as applying all changes at once, in whatever order
batches come, and merging a batch again changes nothing. Older versions can be read while their files are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricmill.operators.recommend import ID, apply_status_log
from metricmill.sources import commits

COLUMNS = [ID, "status", "feedback", "actual_impact", "updated_at"]
BUCKET = "bucket"
# Parts of a bucket that tasks can take apart from each other.
PARTS = 16
# A bucket with more changes in a batch, and with four times its share of them, is reduced before the shuffle.
BUSY = 100_000


def _given() -> dict[str, Column]:
    """Which entries of a log say something about a column."""
    return {"status": F.lit(True), "feedback": F.length("feedback") > 0, "actual_impact": F.col("actual_impact").isNotNull()}


def _candidate(c: str) -> Column:
    return F.coalesce(_given()[c] & (F.col("updated_at") == F.col(f"t_{c}")), F.lit(False))


def _late(rows: DataFrame) -> DataFrame:
    return rows.filter(_candidate("status") | _candidate("feedback") | _candidate("actual_impact"))


def latest(log: DataFrame) -> DataFrame:
    """The entries at the latest times of their ids, found by hash aggregates: a busy id is combined before the shuffle."""
    times = log.groupBy(F.col(ID).alias("of")).agg(*[F.max(F.when(g, F.col("updated_at"))).alias(f"t_{c}") for c, g in _given().items()])
    return _late(log.select(*COLUMNS).join(times, F.col(ID) == F.col("of"))).select(*COLUMNS)


def deciding(log: DataFrame, parts: int = 256) -> DataFrame:
    """The entries of a status log that decide the state; applying them gives what the whole log gives.

    Entries are shuffled once, dealt by the hash of their id into ``parts``; every further step stays in its part.
    """
    part = F.pmod(F.xxhash64(ID), F.lit(parts)).cast("int")
    rows = log.filter(F.col(ID).isNotNull()).select(*COLUMNS, part.alias("part")).repartition("part")

    def settled(c: str) -> Column:
        """What entries of one instant are settled by: the larger values; the others only make it one entry."""
        return F.struct(*dict.fromkeys(["status", c, "feedback", "actual_impact"]))

    own = Window.partitionBy("part", ID)
    late = _late(rows.select("*", *[F.max(F.when(g, F.col("updated_at"))).over(own).alias(f"t_{c}") for c, g in _given().items()]))
    late = late.select("*", *[F.max(F.when(_candidate(c), settled(c))).over(own).alias(f"best_{c}") for c in _given()])
    wins = [F.coalesce(_candidate(c) & settled(c).eqNullSafe(F.col(f"best_{c}")), F.lit(False)) for c in _given()]
    same = Window.partitionBy("part", *COLUMNS).orderBy(F.lit(0))
    return late.filter(wins[0] | wins[1] | wins[2]).withColumn("copy", F.row_number().over(same)).filter("copy = 1").select(*COLUMNS)


def merge(log: DataFrame, path: str, buckets: int = 256) -> list[int]:
    """Merge a batch of status changes into the journal; the buckets that were written anew.

    ``buckets`` stays what it was when the journal began. Changes without an id are left out.
    """
    spark = log.sparkSession
    bucket = F.pmod(F.xxhash64(ID), F.lit(buckets)).cast("int").alias(BUCKET)
    batch = log.filter(F.col(ID).isNotNull()).select(*COLUMNS)
    sizes = {r[0]: r[1] for r in batch.groupBy(bucket).count().collect()}  # at most ``buckets``
    touched = sorted(sizes)
    if not touched:
        return []
    names = {str(b) for b in touched}
    busy = [b for b, n in sizes.items() if n > BUSY and n > 4 * sum(sizes.values()) / buckets]
    if busy:  # some id has much of the batch
        within = F.pmod(F.xxhash64(ID), F.lit(buckets)).cast("int").isin(busy)
        batch = batch.filter(~within).unionByName(latest(batch.filter(within)))
    try:
        batch = commits.read(spark, path, only=names).select(*COLUMNS).unionByName(batch)
    except FileNotFoundError:  # the first batch
        pass
    # Parts lie within buckets, so a task has few of them to write, without another shuffle.
    commits.write(deciding(batch, buckets * PARTS).select("*", bucket), path, "bucket", sorted(names), (BUCKET,), dealt=True)
    return touched


def entries(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The deciding entries of all ids, as they were after commit ``upto``."""
    return commits.read(spark, path, upto=upto).select(*COLUMNS)


def current(recommendations: DataFrame, path: str, upto: int | None = None) -> DataFrame:
    """The recommendations with the state that the journal gives them."""
    return apply_status_log(recommendations, entries(recommendations.sparkSession, path, upto))
