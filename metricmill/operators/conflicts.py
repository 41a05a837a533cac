"""Opposing recommendations.

Whether two recommendations conflict depends only on which key words their titles
hold. Rows are therefore reduced to word profiles, one integer each (at most 2^13,
however many rows there are), and profiles are matched by an equi-join on the
opposing word. Counts and strongest opponents are exact for the whole table and no
pair of rows is ever formed; the pair list exists for a top-k report only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmill.functions.texts import CONFLICT_CLASSES, CONFLICT_OTHER, OPPOSING_WORDS, RESOLUTION
from metricmill.operators.recommend import ID, best
from metricmill.session import stage

# Bit 2i is the first and bit 2i+1 the second word of pair i; the subjects follow.
WORDS = [word for pair in OPPOSING_WORDS for word in pair]
SUBJECTS = [word for word, _ in CONFLICT_CLASSES]
OPPOSITE = [i ^ 1 for i in range(len(WORDS))]


def profiled(recommendations: DataFrame) -> DataFrame:
    """Adds ``profile``, a bit per key word of the title.

    Rows without an opposable word stay in: they match nothing later, and a filter here
    would be moved below and search every title twice.
    """
    text = F.lower("title")
    bits = [F.when(text.contains(word), 1 << i).otherwise(0) for i, word in enumerate(WORDS + SUBJECTS)]
    profile = bits[0]
    for bit in bits[1:]:
        profile = profile.bitwiseOR(bit)
    return recommendations.withColumn("profile", profile)


def conflict_class(profile: Column) -> Column:
    """First subject named by either side, in order of the class list."""
    named = [
        F.when(profile.bitwiseAND(1 << (len(WORDS) + i)) != 0, F.lit(name))
        for i, (_, name) in enumerate(CONFLICT_CLASSES)
    ]
    return F.coalesce(*named, F.lit(CONFLICT_OTHER))


def _words_of(profile: str, numbers: list[int]) -> Column:
    """The given number of each word bit that is set."""
    present = [F.when(F.col(profile).bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(numbers)]
    return F.filter(F.array(*present), lambda n: n.isNotNull())


def _matches(profiles: DataFrame) -> DataFrame:
    """Ordered pairs (mine, theirs) of opposing profiles, each once."""
    mine = profiles.select(
        F.col("profile").alias("mine"), F.col("size").alias("my_size"),
        F.explode(_words_of("profile", OPPOSITE)).alias("word"),
    )
    theirs = profiles.withColumnRenamed("profile", "theirs").withColumn(
        "word", F.explode(_words_of("theirs", list(range(len(WORDS)))))
    )
    return mine.join(theirs, "word").drop("word").dropDuplicates(["mine", "theirs"])


def conflict_summary(recommendations: DataFrame) -> DataFrame:
    """Exact number of conflicting pairs by class, over the whole table."""
    sizes = stage(profiled(recommendations).groupBy("profile").agg(F.count("*").alias("size")))
    mine, theirs = F.col("my_size").cast("decimal(19,0)"), F.col("size").cast("decimal(19,0)")
    # Ordered matches count every unordered pair twice, within a profile as well.
    ordered = F.when(F.col("mine") == F.col("theirs"), mine * (mine - 1)).otherwise(mine * theirs)
    kind = conflict_class(F.col("mine").bitwiseOR(F.col("theirs"))).alias("conflict_type")
    totals = _matches(sizes).groupBy(kind).agg((F.sum(ordered) / 2).cast("bigint").alias("pairs"))
    return totals.filter("pairs > 0")


def opponents(recommendations: DataFrame) -> DataFrame:
    """For every conflicting recommendation: opponents, the strongest one, class and resolution.

    A profile keeps its two strongest members, since the strongest cannot oppose itself.
    The joins back to the rows broadcast one row per profile, a size fixed by the words.
    """
    rows = profiled(recommendations).withColumn(
        "member", F.struct("composite_score", F.col(ID).alias("id"), F.col("source.agent_type").alias("agent"))
    )
    first = stage(rows.groupBy("profile").agg(F.count("*").alias("size"), F.max("member").alias("first")))
    second = (
        rows.select("profile", "member")
        .join(F.broadcast(first.select("profile", "first")), "profile")
        .filter(F.col("member") < F.col("first"))
        .groupBy("profile")
        .agg(F.max("member").alias("second"))
    )
    profiles = stage(first.join(second, "profile", "left"))
    own = F.col("mine") == F.col("theirs")
    facing = _matches(profiles).groupBy("mine").agg(
        F.sum("size").alias("rivals"),
        F.max(F.when(~own, F.struct(F.col("first").alias("member"), F.col("theirs").alias("profile")))).alias("other"),
        F.max(F.when(own, F.struct("first", "second"))).alias("own"),
    )
    joined = rows.join(F.broadcast(facing.withColumnRenamed("mine", "profile")), "profile")
    peer = F.when(F.col("own.first.id") == F.col(ID), F.col("own.second")).otherwise(F.col("own.first"))
    inside = F.when(peer.isNotNull(), F.struct(peer.alias("member"), F.col("profile")))
    return (
        joined.withColumn("opponents", F.col("rivals") - F.when(F.col("own").isNotNull(), 1).otherwise(0))
        .filter("opponents > 0")
        .withColumn("against", F.greatest("other", inside))
        .select(
            ID,
            "opponents",
            F.col("against.member.id").alias("strongest_opponent"),
            conflict_class(F.col("profile").bitwiseOR(F.col("against.profile"))).alias("conflict_type"),
            resolution(
                F.col("composite_score"), F.col("source.agent_type"),
                F.col("against.member.composite_score"), F.col("against.member.agent"),
            ).alias("resolution"),
        )
    )


def resolution(score_a: Column, agent_a: Column, score_b: Column, agent_b: Column) -> Column:
    """The higher score goes first; on equal scores the second."""
    winner = F.when(score_a > score_b, agent_a).otherwise(agent_b)
    return F.format_string(RESOLUTION, winner)


def top_conflicts(recommendations: DataFrame, top: int) -> DataFrame:
    """The conflicting pairs among the ``top`` best recommendations, a report of bounded size."""
    rows = stage(
        profiled(best(recommendations, top)).select(
            F.col(ID).alias("id"), "title", "composite_score", F.col("source.agent_type").alias("agent"), "profile"
        )
    )
    item = F.struct(*rows.columns)
    a = rows.select(item.alias("a"), F.explode(_words_of("profile", OPPOSITE)).alias("word"))
    b = rows.select(item.alias("b"), F.explode(_words_of("profile", list(range(len(WORDS))))).alias("word"))
    pairs = a.join(b, "word").filter("a.id < b.id").dropDuplicates(["a", "b"])
    return pairs.select(
        F.col("a.id").alias("id_1"), F.col("a.agent").alias("agent_1"), F.col("a.title").alias("title_1"),
        F.col("b.id").alias("id_2"), F.col("b.agent").alias("agent_2"), F.col("b.title").alias("title_2"),
        conflict_class(F.col("a.profile").bitwiseOR(F.col("b.profile"))).alias("conflict_type"),
        resolution(F.col("a.composite_score"), F.col("a.agent"), F.col("b.composite_score"), F.col("b.agent"))
        .alias("resolution"),
    )
