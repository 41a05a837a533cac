"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmill.session import stage

# What separates words: the space and the characters 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def remainder(ident: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text (0)."""
    return F.coalesce(F.crc32(F.col(ident).cast("string")), F.lit(0)) % modulus


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns called c0, c1, ..., so that no name of the caller's meets one of ours.

    Also what the given columns are called there. ``toDF(*docs.columns)`` gives the names back.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*own), [own[docs.columns.index(name)] for name in names]


def told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``__row``, struct(file, row), that no two rows share and that stays however it is read again.

    Rows that come from files by projections and filters alone are known by the file (a 64-bit hash of its
    path) and the row's number in it, which do not depend on how a scan is split. All others are
    checkpointed first and known by their place in the checkpoint.
    """
    nodes, simple = [docs._jdf.queryExecution().analyzed()], "_metadata" not in docs.columns
    while nodes and simple:
        node = nodes.pop()
        children = node.children()
        if children.isEmpty():
            simple = node.nodeName().startswith("LogicalRelation") and len(docs.inputFiles()) == len(set(docs.inputFiles()))
        simple = simple and (children.isEmpty() or node.nodeName() in ("Project", "Filter", "SubqueryAlias"))
        nodes += [children.apply(i) for i in range(children.size())]
    if simple:
        try:
            file, row = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").cast("long").alias("row")
            return docs.select("*", F.struct(file, row).alias("__row"))
        except AnalysisException:  # a format whose rows have no number
            pass
    here = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    return stage(docs).withColumn("__row", here)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one slice hold about ``limit`` bytes.

    A longer single text is a slice of its own. Nulls in ``column`` become empty texts.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        texts = batch.column(at)
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
        batch = batch.set_column(at, column, texts)
        part = pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum() // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(start, stop - start)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of several runs, one run after the other."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - before, lengths)
