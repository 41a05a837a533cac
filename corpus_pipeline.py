"""From raw documents to token ids: language, near copies, personal data, mix, encoding.

Every stage reads what the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metricmill.llm import bpe, langid, mixing, simhash, surrogates
from metricmill.session import prepared, scratch

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Documents whose text has an identified language; texts without letters and undecided ones go.

    All stages take null and repeated ids, null, empty and very long texts, empty tables and further columns
    of any name; what becomes of them is said where the operators are.
    """
    prepared(spark)
    return langid.keep_identified(docs, langid.fit(docs, PIECES))


def near_copies(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """One document of each group of near copies: three-word shingles, at most two differing bits."""
    prepared(spark)
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def personal_data(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """The same documents with surrogates for personal data; n_chars follows the new text."""
    prepared(spark)
    new = surrogates.pseudonymize(docs, key="pipeline")
    if "n_chars" in new.columns:
        kind = new.schema["n_chars"].dataType
        new = new.selectExpr(*[f"cast(length(text) as {kind.simpleString()}) as n_chars" if c == "n_chars" else f"`{c}`" for c in new.columns])
    return new


def mix(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 in turn over the sources."""
    prepared(spark)
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Digests of the token ids and of the decoded bytes, one row per document taken."""
    prepared(spark)
    return bpe.digests(docs, RANKS)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_copies),
    ("pii_surrogates", personal_data),
    ("mixing", mix),
    ("byte_bpe", encoded),
]
# Fingerprints, learned probabilities and merges are beyond SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, root: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = prepared(spark).read.parquet(f"{root}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, root).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, root)
