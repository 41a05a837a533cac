"""Exact order statistics of many keys at once, by narrowing ranges and without a shuffle of all values.

The first pass counts the values of every key in bins that are the same for all keys (64 to each doubling, ascending
with the value), with the smallest and the largest value of each. The bin that holds a wanted rank is
known from the counts. If it holds one value only, that is the result. If it holds few, they are counted one by
one; if it holds many, its range is cut into PARTS equal parts, those are counted, and so on: every round
looks at the values of the brackets alone, all ranks of all keys together. Counts are added up before the
shuffle, brackets enclose their rank by construction, and null keys are keys like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmill.session import stage

PER_DOUBLING = 64
PARTS = 4096
# A bracket of at most so many values is counted value by value.
FEW = 20_000
# So few brackets are also a plain filter, which reaches the scan.
LITERALS = 64
BIN, LOW, HIGH, COUNT = "__bin", "__low", "__high", "__count"


def _bin(v: Column) -> Column:
    """A bin number that ascends with the value; NaN counts as the largest, as in Spark's order."""
    # Sizes of doubles lie between 2 ** -1074 and 2 ** 1024; infinity comes after them.
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * PER_DOUBLING) + 2000 * PER_DOUBLING
    return F.when(F.isnan(v), 4000 * PER_DOUBLING).when(v > 0, size).when(v < 0, -size).otherwise(0).cast("long")


def histogram(df: DataFrame, keys: list[str], value: str, moments: bool = False) -> DataFrame:
    """One row per key and bin that occurs: count, smallest and largest value; nulls in a bin of their own (null).

    With ``moments`` also ``total`` and ``square``: the sum, and the squared deviations from the bin's mean.
    Staged, as several steps read it; its size is keys times bins, not values.
    """
    v = F.col("__v")
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    sums = [F.sum(v).alias("total"), (F.var_pop(v) * F.count(v)).alias("square")] if moments else []
    found = rows.groupBy(*keys, F.when(v.isNotNull(), _bin(v)).alias(BIN)).agg(
        F.count("*").alias(COUNT), F.min(v).alias(LOW), F.max(v).alias(HIGH), *sums
    )
    return stage(found)


def _same(keys: list[str], prefix: str = "__of_") -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]


def _locate(counted: DataFrame, within: list[str], order: str) -> DataFrame:
    """Adds ``__below``: how many values of the group come before the row's own."""
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("__below", F.coalesce(F.sum(COUNT).over(before), F.lit(0)))


def _members(df: DataFrame, keys: list[str], value: str, brackets: DataFrame) -> DataFrame:
    """(bracket's keys, bin, range and first rank; __v): the values that lie in a bracket."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    ranges = brackets.select(*keys, BIN, LOW, HIGH, "__first").distinct()
    some = ranges.limit(LITERALS + 1).collect()
    if len(some) <= LITERALS:
        inside = F.lit(False)
        for r in some:
            here = F.col("__v").between(r[LOW], r[HIGH])
            for k in keys:
                here = here & F.col(k).eqNullSafe(F.lit(r[k]))
            inside = inside | here
        rows = rows.filter(inside)
    named = ranges.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col(BIN).alias("__of_bin"), LOW, HIGH, "__first")
    rows = rows.withColumn(BIN, _bin(F.col("__v")))
    fits = [*_same(keys), F.col(BIN) == F.col("__of_bin"), F.col("__v").between(F.col(LOW), F.col(HIGH))]
    return rows.join(named, fits).drop("__of_bin", *[f"__of_{k}" for k in keys])


def _at_ranks(df: DataFrame, keys: list[str], value: str, ranks, held: DataFrame | None = None) -> DataFrame:
    """(keys, n, name, v): the value at a 0-based ascending rank among the non-null values.

    ``ranks(n)`` gives (name, rank) columns for a count of values; ``held`` is the histogram, if there is one.
    """
    held = histogram(df, keys, value) if held is None else held
    counted = _locate(held.filter(F.col(BIN).isNotNull()), keys, BIN)
    counted = counted.withColumn("n", F.sum(COUNT).over(Window.partitionBy(*keys)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks(F.col("n"))])
    inside = F.filter(wanted, lambda w: (w["rank"] >= F.col("__below")) & (w["rank"] < F.col("__below") + F.col(COUNT)))
    brackets = stage(counted.withColumn("w", F.explode(inside)).select(
        *keys, "n", "w.name", "w.rank", BIN, LOW, HIGH, F.col("__below").alias("__first"), COUNT
    ))
    found = None
    place = [*keys, BIN, LOW, HIGH, "__first"]

    def add(rows: DataFrame) -> DataFrame:
        picked = rows.select(*keys, "n", "name", F.col(LOW).alias("v"))
        return picked if found is None else found.unionByName(picked)

    while True:
        settled = F.col(LOW) == F.col(HIGH)
        found = add(brackets.filter(settled))
        brackets = brackets.filter(~settled)
        most = brackets.agg(F.max(COUNT)).first()[0]
        if most is None:
            return found
        members = _members(df, keys, value, brackets)
        if most <= FEW:
            part = F.col("__v")
        else:
            span = F.col(HIGH) / 2 - F.col(LOW) / 2  # halves, as the difference of two doubles may overflow
            part = F.least(F.floor((F.col("__v") / 2 - F.col(LOW) / 2) / span * PARTS), F.lit(PARTS - 1))
        parts = members.groupBy(*place, part.alias("__part")).agg(
            F.count("*").alias(COUNT), F.min("__v").alias("__l"), F.max("__v").alias("__h")
        )
        parts = _locate(parts, place, "__part").withColumn("__below", F.col("__below") + F.col("__first"))
        parts = parts.select(
            *[F.col(k).alias(f"__of_{k}") for k in keys], F.col(BIN).alias("__b"), F.col("__first").alias("__f"), "__below",
            F.col(COUNT).alias("__c"), "__l", "__h",
        )
        here = [*_same(keys), F.col(BIN) == F.col("__b"), F.col("__first") == F.col("__f")]
        here += [F.col("rank") >= F.col("__below"), F.col("rank") < F.col("__below") + F.col("__c")]
        narrowed = brackets.join(parts, here).select(
            *keys, "n", "name", "rank", BIN, F.col("__l").alias(LOW), F.col("__h").alias(HIGH), F.col("__below").alias("__first"),
            F.col("__c").alias(COUNT),
        )
        if most <= FEW:
            return add(narrowed)
        brackets = stage(narrowed)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], held: DataFrame | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per entry of ``probs``.

    Nulls are left out. With no keys the result is one row for the whole frame, nulls if it has no values.
    ``held`` may be the frame's ``histogram``, which then is not counted again.
    """
    def place(p: float, n: Column) -> Column:
        return F.lit(p) * (n - 1)

    picked = _at_ranks(
        df, keys, value,
        lambda n: [(f"{name}.{side}", to(place(p, n))) for name, p in probs.items() for side, to in (("lo", F.floor), ("hi", F.ceil))],
        held,
    )

    def at(name: str, side: str) -> Column:
        return F.max(F.when(F.col("name") == f"{name}.{side}", F.col("v")))

    columns = []
    for name, p in probs.items():
        share = place(p, F.max("n")) - F.floor(place(p, F.max("n")))
        columns.append((at(name, "lo") + (at(name, "hi") - at(name, "lo")) * share).alias(name))
    return picked.groupBy(*keys).agg(*columns)


def values_from_top(df: DataFrame, value: str, shares: dict[str, float]) -> dict[str, float]:
    """For each share q the value at index floor(q*n) of a descending order; empty for no rows."""
    picked = _at_ranks(df, [], value, lambda n: [(name, n - 1 - F.floor(n * F.lit(q))) for name, q in shares.items()])
    return {r.name: r.v for r in picked.collect()}  # one number per share


def with_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``df`` with its keys' quantiles as further columns; null for a key without values."""
    found = exact_quantiles(df, keys, value, probs).withColumnsRenamed({k: f"__of_{k}" for k in keys})
    return df.join(found, _same(keys), "left").drop(*[f"__of_{k}" for k in keys])


def mode_of(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, name): the most frequent value of each key, the smallest of several. Counted by value first."""
    counts = df.select(*keys, value.alias("__v")).filter(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.count("*").alias(COUNT))
    best = F.min_by("__v", F.struct(-F.col(COUNT), F.col("__v")))
    return counts.groupBy(*keys).agg(best.alias(name))
