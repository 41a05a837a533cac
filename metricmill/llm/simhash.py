"""SimHash fingerprints of word shingles and their links by multi-index hashing.

A fingerprint is 64 bits. For the index it is cut into four blocks of 16 bits; table t is keyed by
the 48-bit segment that leaves block t out. Two fingerprints that differ in at most two bits differ

* in one block t at most: then their segments t are equal, or
* in one bit each of two blocks i < t: then their segments t differ in one bit, of block i.

So every fingerprint looks up its own four segments, and in table t the ball of radius one over the
bits of the blocks before t. Only bits that are zero are flipped: of two fingerprints that differ in
a bit, the one holding the zero looks up the other. Each link is therefore met exactly once, and
every match is verified on all 64 bits inside the join. With 48-bit keys over distinct
fingerprints a bucket stays small even when one text has very many near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmill.llm.common import apart, slices
from metricmill.llm.components import components
from metricmill.session import stage

BLOCKS, WIDTH = 4, 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of UTF-8 bytes: a bit is set if more than half of the shingle hashes set it."""
    words = text.lower().split()  # on bytes: lowers A-Z only, splits at 0x20 and 0x09 to 0x0D only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    hashes = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at: at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 3, row: Column | None = None) -> DataFrame:
    """One row (ident, fp) per row of ``docs``; fp is the fingerprint as a signed 64-bit number.

    With ``row``, a text, it is (ident, fp, row).
    Null and wordless texts have fingerprint zero. Texts are read whole; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = [fingerprint(x, shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            values = np.array(found, dtype=np.uint64).view(np.int64)
            made = [batch.column(0), pa.array(values), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(made, names=["__id", "fp", "row"][: len(made)])

    more = [] if row is None else [row.cast("string").alias("row")]
    rows = docs.select(F.col(ident).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"), *more)
    return rows.mapInArrow(run, "__id long, fp long" + ", row string" * len(more)).withColumnRenamed("__id", ident)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _keys(block: int) -> str:
    """SQL for the segment of ``x`` that leaves a block out; the block's place holds its number."""
    keep = _signed((1 << 64) - 1 - (((1 << WIDTH) - 1) << (block * WIDTH)))
    return f"((x & {keep}L) | {_signed(block << (block * WIDTH))}L)"


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b) of ids whose fingerprints differ in 1 to ``max_bits`` bits, each pair once.

    ``prints`` holds one row (id, fp) per distinct fingerprint. ``max_bits`` is 0, 1 or 2.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("the tables find fingerprints up to two bits apart")
    name = prints.columns[0]
    base = prints.select(F.col(name).alias("id"), F.col("fp").alias("x"))
    exact = "array(" + ", ".join(_keys(t) for t in range(BLOCKS)) + ")"
    segments = base.selectExpr("id", "x", f"explode({exact}) as key")
    looked_up = base.selectExpr("id as a", "x as p", f"explode({exact}) as key", "false as flipped")
    if max_bits == 2:
        for t in range(1, BLOCKS):
            flips = (
                f"transform(filter(sequence(0, {t * WIDTH - 1}), i -> (shiftright(x, i) & 1L) = 0), "
                f"i -> {_keys(t)} | shiftleft(1L, i))"
            )
            looked_up = looked_up.union(base.selectExpr("id", "x", f"explode({flips})", "true"))
    met = looked_up.join(segments, "key").where(
        f"if(flipped, bit_count(p ^ x) = 2, bit_count(p ^ x) between 1 and {max_bits} and p < x)"
    )
    return met.select("a", F.col("id").alias("b"))


def near_duplicates(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """One row (ident, fp, component_id) per row of ``docs``.

    component_id is the smallest id whose fingerprint can be reached through links of at most
    ``max_bits`` bits, the document's own included. Equal texts share a fingerprint; documents
    without words share fingerprint zero and are linked like any other. Rows with a null id are
    returned with the component their fingerprint has, null if only null ids have it. Repeated ids
    keep a row each. An empty table gives an empty result.
    """
    prints = stage(fingerprints(docs, ident, text, shingle))
    first = prints.groupBy("fp").agg(F.min(ident).alias("__first"))
    found = components(links(first.where("__first is not null").select("__first", "fp"), max_bits))
    merged = first.join(found.withColumnRenamed("node", "__first"), "__first", "left").select(
        F.col("fp").alias("__fp"), F.coalesce("component", "__first").alias("component_id")
    )
    return prints.join(merged, F.col("fp") == F.col("__fp"), "left").drop("__fp")


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Every row is decided by its own fingerprint, so an id that stands with several texts is as many
    documents. Null ids come after all others; a component that has only such keeps one of them. Among rows of one
    component and id that differ in text, the one with the smallest digest of both stays; rows that repeat both
    are kept once. Null and empty texts are documents without words; an empty table gives an empty result.
    """
    names = docs.columns
    docs, (ident, text) = apart(docs, ident, text)
    # Id and text as one key; the sign before each tells null from empty.
    own, whole = F.col(f"`{ident}`").cast("string"), F.col(f"`{text}`").cast("string")
    row = F.md5(F.concat(F.coalesce(own, F.lit("-")), F.when(whole.isNull(), "-").otherwise(F.concat(F.lit("+"), whole))))
    prints = fingerprints(docs, ident, text, shingle, row).withColumnRenamed(ident, "__id")
    prints = stage(prints.groupBy(F.col("__id").alias("id"), "fp", "row").agg(F.count("*").alias("n")))
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first"))
    found = components(links(first.select(F.col("fp").alias("node"), "fp"), max_bits))
    merged = stage(first.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    stays = merged.groupBy("component").agg(F.min("first")["row"].alias("stays"))
    stays = merged.join(stays, "component").select(F.col("fp").alias("own_fp"), "stays")
    decided = prints.join(stays, F.col("fp") == F.col("own_fp"))
    gone = decided.where("row <> stays").select(F.col("row").alias("__gone"))
    again = decided.where("row = stays and n > 1").select(F.col("row").alias("__again"))
    kept = docs.withColumn("__row", row)
    kept = kept.join(gone, F.col("__row") == F.col("__gone"), "left_anti")
    once = kept.join(again, F.col("__row") == F.col("__again"), "left_anti")
    repeated = kept.join(again, F.col("__row") == F.col("__again"), "left_semi").dropDuplicates(["__row"])
    return once.union(repeated).drop("__row").toDF(*names)
