"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every source queues its documents in a fixed shuffle. The finish time of a document in virtual time
is the number of its source's words up to and including it, divided by the source's target. Where a
target is above what the source holds, its queue starts over, up to ``most`` times. All queues
are merged by finish time and the merged order is cut where the total budget is used up.

Nothing is sorted in one task: words before a document are summed per slot of the shuffle first, and
only the range of virtual time in which the budget runs out is put in order row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricmill.llm.common import WORD, apart
from metricmill.session import stage

WEIGHTS = (5, 2, 1)
# Leading hex digits of the shuffle key that number the slots of a source's queue.
SLOT_DIGITS = 3
# Ranges per unit of virtual time.
RANGES = 1 << 16


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, source_no, target).

    Sources in order of code points, null last, get the weights in turn and share the sum of all
    sizes; a target stops at ``most`` times its source's size and the excess goes to the others by
    weight. The level all open targets stand at (target per weight) is found in one pass: with the
    sources in the order in which they fill up, it is the largest of what each would get if all
    before it were full.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    filled = Window.orderBy("fills_at", "source_no")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = (
        sizes.withColumn("source_no", number.cast("long"))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * most)
        .withColumn("fills_at", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn(
            "level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
        )
        .withColumn("level", F.max("level").over(everything))
    )
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return rows.select("source", "source_size", "source_no", target.alias("target"))


def mix(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: ident, source, size, source_size, target, copies, taken, finish.

    size counts words (null text: 0), copies says how often the mix takes the document (0 to
    ``most``), taken = copies * size; finish is the virtual finish time of its first copy (null in
    a source without words). Documents without words are never taken. A null source is a source of
    its own. The shuffle depends on seed and id alone, so reruns agree; of rows that repeat id and
    size it does not matter which is which. An empty table gives an empty result.
    """
    sized = stage(
        docs.select(
            F.col(ident).cast("long").alias("id"),
            F.col(source).cast("string").alias("source"),
            word_count(text).alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col(ident).cast("string"), F.lit("")))).alias("key"),
        )
    )
    plan = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    budget = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]

    named = plan.withColumnRenamed("source", "name")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("slot", F.substring("key", 1, SLOT_DIGITS))
    slots = rows.groupBy("source_no", "slot").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source_no").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("source_no", "slot", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source_no", "slot").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.join(slots, ["source_no", "slot"]).withColumn("upto", F.col("ahead") + F.sum("size").over(within))
    queued = stage(
        queued.select("id", "source", "source_no", "size", "source_size", "target", "key", "upto")
    )

    def place(copy):
        """Where a copy stands in the merged order."""
        finish = (copy * F.col("source_size") + F.col("upto")) / F.expr("nullif(target, 0)")
        return F.struct(finish.alias("finish"), "source_no", "key", F.coalesce("id", F.lit(0)).alias("id"), "size", copy.alias("copy"))

    copies = queued.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    copies = copies.select(place(F.col("copy")).alias("place"), "size")
    copies = copies.withColumn("span", F.floor(F.col("place.finish") * RANGES))
    # Copies that finish long after time 1 cannot be reached: all targets together are the budget.
    spans = copies.groupBy("span").agg(F.sum("size").alias("held"))
    upto = F.sum("held").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0))
    last = spans.withColumn("upto", upto).where(F.col("upto") > budget).orderBy("span").first()
    if last is None:
        cut = F.lit(True)
    else:
        order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        inside = copies.where(F.col("span") == last["span"])
        total = F.sum("size").over(order) + F.lit(last["upto"] - last["held"])
        first_out = inside.withColumn("total", total).where(F.col("total") > budget).orderBy("place").first()["place"]
        edge = F.struct(
            F.lit(first_out["finish"]).alias("finish"),
            F.lit(first_out["source_no"]).alias("source_no"),
            F.lit(first_out["key"]).alias("key"),
            F.lit(first_out["id"]).cast("long").alias("id"),
            F.lit(first_out["size"]).cast("long").alias("size"),
            F.lit(first_out["copy"]).cast("int").alias("copy"),
        )
        cut = None
    taken = F.lit(0)
    for copy in range(most):
        at = place(F.lit(copy))
        taken = taken + F.when((F.col("size") > 0) & (cut if cut is not None else at < edge), 1).otherwise(0)
    finish = F.col("upto") / F.expr("nullif(target, 0)")
    return queued.withColumn("copies", taken).select(
        F.col("id").alias(ident), "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), finish.alias("finish"),
    )


def mixed_documents(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, columns unchanged.

    Rows that share id, source and size share the number of copies, the largest of theirs. Documents without
    words (null and empty texts too) are never taken; null sources and ids are values like any other; texts are
    counted whole; an empty table gives an empty result.
    """
    names = docs.columns
    docs, (ident, text, source) = apart(docs, ident, text, source)
    plan = mix(docs, ident, text, source, **options).where("copies > 0")
    plan = plan.groupBy(
        F.col(ident).alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size")
    ).agg(F.max("copies").alias("__mix_copies"))
    rows = docs.withColumn("__mix_words", word_count(text))
    same = (
        rows[ident].cast("long").eqNullSafe(F.col("__mix_id"))
        & rows[source].eqNullSafe(F.col("__mix_source"))
        & (F.col("__mix_words") == F.col("__mix_size"))
    )
    found = rows.join(plan, same).withColumn("__mix_again", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    return found.select(*docs.columns).toDF(*names)
