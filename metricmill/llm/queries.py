"""The registered query of each operator of this subpackage, with SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmill.llm import (
    alignment, bpe, collisions, columns, isolation, langid, mixing, simhash, suffixtree, surrogates, toxicity, variants,
    vptree,
)
from metricmill.llm.common import remainder, table
from metricmill.session import prepared, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(run):
        QUERIES[name] = lambda spark, root: run(prepared(spark), root)
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


@query("op5_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, root, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5('mix' || coalesce(doc_id::VARCHAR, '')) AS key
    FROM documents),
held AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
numbered AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no,
           [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM held),
levels AS (
    SELECT *, ((SELECT sum(source_size) FROM held) - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
              / (sum(weight) OVER after)::DOUBLE AS level
    FROM numbered
    WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           after AS (ORDER BY (3 * source_size)::DOUBLE / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
aims AS (
    SELECT source, source_no, source_size,
           least((3 * source_size)::DOUBLE, weight * (SELECT max(level) FROM levels)) AS target
    FROM levels),
queued AS (
    SELECT doc_id, size, source_size, target, source_no, key,
           (sum(size) OVER (PARTITION BY source_no ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
    FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source),
copies AS (
    SELECT doc_id, size, source_no, key, copy,
           (copy * source_size + upto)::DOUBLE / nullif(target, 0) AS finish
    FROM queued, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0),
merged AS (
    SELECT doc_id, sum(size) OVER (ORDER BY finish, source_no, key, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS total
    FROM copies),
kept AS (
    SELECT doc_id, count(*) AS copies FROM merged WHERE total <= (SELECT sum(source_size) FROM held) GROUP BY doc_id)
SELECT queued.doc_id, size, source_size, target, (coalesce(copies, 0) * size)::BIGINT AS taken
FROM queued LEFT JOIN kept USING (doc_id)
"""


@query("op6_mixing", MIX_SQL)
def mixing_sources(spark: SparkSession, root: str) -> DataFrame:
    mixed = mixing.mix(table(spark, root, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_byte_bpe")
def byte_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.digests(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op9_language_id")
def language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    model = langid.fit(docs.where(remainder("doc_id", 4) != 2), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.identify(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query("op3_pii_surrogates")
def pii_surrogates(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return surrogates.pseudonymize(docs, key="op3", marks=True)


@query("op4_toxicity")
def toxic_texts(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    labels = table(spark, root, "labels").where(remainder("doc_id", 5) != 0)
    found = toxicity.classify(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op1_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return collisions.near_duplicates(table(spark, root, "embeddings"), cosine=0.95)


NEAREST_SQL = """
WITH good AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
    FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op2_nearest_neighbours", NEAREST_SQL)
def nearest_neighbours(spark: SparkSession, root: str) -> DataFrame:
    base = table(spark, root, "embeddings")
    return vptree.nearest(base, base.where("vec_id % 50 = 0"), k=5, factor=1.0)


@query("op10_suffix_columns")
def suffix_columns(spark: SparkSession, root: str) -> DataFrame:
    found = columns.repeats(table(spark, root, "documents"), width=400)
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op7_suffix_tree")
def suffix_tree(spark: SparkSession, root: str) -> DataFrame:
    return suffixtree.score(table(spark, root, "documents"), remainder("doc_id", 5) == 1)


@query("op11_token_alignment")
def token_alignment(spark: SparkSession, root: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.link_scores(table(spark, root, "documents"), alignment.Vocabularies.read(*files))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_isolation_rules")
def isolation_rules(spark: SparkSession, root: str) -> DataFrame:
    stats = stage(isolation.statistics(table(spark, root, "documents")))
    forest = isolation.fit(stats, table(spark, root, "labels"))
    return isolation.judge(stats, forest).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


@query("op13_spelling_variants")
def spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    return variants.spellings(table(spark, root, "documents"), least=7, often=2, ratio=10)
