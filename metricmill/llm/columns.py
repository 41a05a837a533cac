"""Removing byte strings of a fixed width that occur more than once, documents' suffixes sorted column by column.

Sorting all suffixes of a corpus in one place does not scale, and only suffixes that share ``width`` bytes
matter. So every window of ``width`` bytes is given to an anchor: the place in it whose short gram has the
smallest hash, the leftmost of equals. Equal windows have their anchors at the same offset and of the same
hash. A segment is the stretch of the windows that one anchor owns in one document.

* Segments that are equal as a whole are repeats outright; copies of documents end here.
* Different segments around equal anchors are laid under each other, anchor on anchor, and their suffixes
  are sorted by inserting one symbol per segment each round, from the last column to the first: the order
  of the suffixes one symbol shorter, stably sorted by the new symbol, is the new order, and the common
  prefixes follow from those between the old neighbours. Because windows that own different offsets cannot be
  equal, the collection's Burrows-Wheeler transform falls apart into these columns and no round touches
  more than one. Columns are read from, and orders and common prefixes written to, external files, all
  in sequence. A window is a repeat if its suffix shares ``width`` bytes with a neighbour.
* Anchors with more than CROWD different segments (a short line in a third of all documents, say) would
  not fit one task. The windows they own are counted by two 64-bit hashes instead.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmill.llm.common import runs, slices, told_apart
from metricmill.llm.hashing import Spans
from metricmill.session import scratch, stage

GRAM = 16
ROW, ROW_TYPE = "rid struct<file: long, row: long>", pa.struct([("file", pa.int64()), ("row", pa.int64())])
CROWD = 3000
# Different segments that one task sorts, about.
SHARD = 8192
# Bytes of text that a task hashes at a time, each some 100 bytes of arrays meanwhile, and segments that it lays
# out at a time.
SLICE, LAID = 250_000, 512


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1: n])


def segments(data: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Segments of documents laid in a row: (first window, last window, anchor, anchor's hash, segment's hash)."""
    grams = len(data) - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none, none
    spans = Spans(data)
    at = np.arange(grams)
    hashes = spans(at, at + GRAM)
    keys = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    anchor = (sliding_minimum(keys, width - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.maximum(np.diff(docs) - width + 1, 0)
    windows = runs(docs[:-1], lengths)
    if not len(windows):
        return none, none, none, none, none
    anchor = anchor[windows]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(windows) != 1) | (np.diff(anchor) != 0))))
    first, last, anchor = windows[new], windows[np.append(new[1:], len(windows)) - 1], anchor[new]
    whole = spans(first, last + width) + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return first, last, anchor, hashes[anchor].view(np.int64), whole.view(np.int64)


def sort_columns(groups: np.ndarray, texts: list[bytes], offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of the windows of ``width`` bytes that two segments of a group share.

    Segment i has its anchor at ``offsets[i]``; groups are numbered 0, 1, ...
    """
    n = len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    left = int(offsets.max())
    total = left + int((lengths - offsets).max())
    hits: list = []
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as sorted_:
        # Symbols are bytes plus one; zero is past the end of a segment and equals nothing.
        store = np.memmap(columns, np.uint16, "w+", shape=(total, n))
        for at in range(0, n, LAID):
            some = slice(at, at + LAID)
            data = np.frombuffer(b"".join(texts[some]), np.uint8)
            row = np.repeat(np.arange(n)[some], lengths[some])
            store[runs(left - offsets[some], lengths[some]), row] = data.astype(np.uint16) + 1
        order = np.argsort(groups, kind="stable")
        common = np.zeros(n, np.int64)  # of each suffix with the one before it in the order
        for column in range(total - 1, -1, -1):
            symbols = store[column][order]
            key = groups[order] * 512 + symbols
            turn = np.argsort(key, kind="stable")
            key = key[turn]
            same = np.concatenate(([False], key[1:] == key[:-1])) & (symbols[turn] > 0)
            after = np.flatnonzero(same)
            new = np.zeros(n, np.int64)
            new[after] = np.minimum(_least(common, turn[after - 1] + 1, turn[after]) + 1, width)
            order, common = order[turn], new
            long = np.flatnonzero(common >= width)
            np.array([len(long)]).tofile(sorted_)
            order[long - 1].tofile(sorted_)
            order[long].tofile(sorted_)
        del store
        sorted_.seek(0)
        for column in range(total - 1, -1, -1):
            count = int(np.frombuffer(sorted_.read(8), np.int64)[0])
            both = np.unique(np.frombuffer(sorted_.read(16 * count), np.int64))
            hits.append((both, np.full(len(both), column - left)))
    found, start = (np.concatenate(x) for x in zip(*hits))
    return found, start + offsets[found]


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last] for each pair."""
    if not len(first):
        return first
    size = last - first + 1
    level = np.frexp(size.astype(float))[1] - 1
    out = np.empty(len(first), np.int64)
    table = values
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
        step = 1 << k
        if len(table) > step:
            table = np.minimum(table[:-step], table[step:])
    return out


def anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(rid, h, seg, first, more, off) of the segments of (rid, data): where each starts, its windows after the first, its anchor's offset."""
    for batch in slices(batches, "data", SLICE):
        data = batch.column(1)
        lengths = data.to_pylist()
        docs_at = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, lengths), np.int64, len(lengths)))))
        flat = np.frombuffer(b"".join(lengths), np.uint8)
        first, last, anchor, h, seg = segments(flat, docs_at, width)
        doc = np.searchsorted(docs_at, first, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(doc)), pa.array(h), pa.array(seg),
                pa.array((first - docs_at[doc]).astype(np.int32)), pa.array((last - first).astype(np.int32)),
                pa.array((anchor - first).astype(np.int32)),
            ],
            names=["rid", "h", "seg", "first", "more", "off"],
        )


def windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(rid, start, x, y) of the windows of (rid, id, first, data): where each starts in its text, and two hashes of it."""
    for batch in slices(batches, "data", SLICE):
        texts = batch.column(3).to_pylist()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum(lengths) - lengths
        at = runs(begins, lengths - width + 1)
        own = np.repeat(np.arange(len(texts)), lengths - width + 1)
        other = Spans(data.astype(np.uint64) ^ np.uint64(0x5A5A5A5A))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(own)),
                pa.array(batch.column(2).to_numpy().astype(np.int64)[own] + at - begins[own]),
                pa.array(Spans(data)(at, at + width).view(np.int64)), pa.array(other(at, at + width).view(np.int64)),
            ],
            names=["rid", "start", "x", "y"],
        )


def repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 400) -> DataFrame:
    """One row (ident, n_bytes, spans, kept) per row of ``docs``.

    spans are the maximal runs (start, stop) of UTF-8 bytes covered by strings of ``width`` bytes that also
    start anywhere else in the table, the same text included; kept are the remaining bytes. Null counts as
    empty text; texts shorter than ``width`` have no spans; repeated rows and null ids are documents like any
    other. Rows are told apart by file and row number; a table that is not read from files is
    checkpointed first. An empty table gives an empty result.
    """
    rows = told_apart(docs.select(F.col(f"`{ident}`").alias("__id"), F.col(f"`{text}`").alias("__text"))).select(
        F.col("__row").alias("rid"),
        F.col("__id").alias("id"),
        F.coalesce(F.col("__text").cast("string"), F.lit("")).cast("binary").alias("data"),
    )
    long = rows.where(F.length("data") >= width).select("rid", "data")

    kinds = f"{ROW}, h long, seg long, first int, more int, off int"
    path = scratch(docs.sparkSession, "anchors")
    long.mapInArrow(lambda batches: anchors(batches, width), kinds).write.parquet(path)
    found = docs.sparkSession.read.schema(kinds).parquet(path)
    different = found.groupBy("h", "seg").agg(
        F.count("*").alias("n"), F.min(F.struct("rid", "first", "more", "off")).alias("one")
    )
    shared = different.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    shared = shared.where("kinds > 1 and least = 1").select("h", "kinds")
    compared = different.join(shared, "h").select("h", "kinds", "n", "one.*")
    compared = stage(compared)
    # Texts are dealt out by row once: the id is carried along, so that this join and the last read one shuffle.
    segment = rows.join(compared, "rid").select(
        "rid", "id", "h", "kinds", "n", "first", "off", F.expr(f"substring(data, first + 1, more + {width})").alias("data")
    )
    total = compared.count()
    shards = max(1, -(-total // SHARD))

    def sort(table: pa.Table) -> pa.Table:
        _, groups = np.unique(table["h"].to_numpy(), return_inverse=True)
        which, start = sort_columns(groups, table["data"].to_pylist(), table["off"].to_numpy().astype(np.int64), width)
        order = np.lexsort((start, which))
        which, start = which[order], start[order]
        new = np.ones(len(which), bool)
        new[1:] = (np.diff(which) != 0) | (np.diff(start) != 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(which)) - 1 if len(begin) else begin
        at = table["first"].to_numpy().astype(np.int64)[which[begin]]
        return pa.table(
            {"rid": table["rid"].take(pa.array(which[begin])).cast(ROW_TYPE), "start": at + start[begin], "stop": at + start[end] + width}
        )

    spread = segment.where(f"kinds <= {CROWD}").withColumn("shard", F.pmod("h", F.lit(shards)))
    sorted_ = spread.groupBy("shard").applyInArrow(sort, f"{ROW}, start long, stop long")

    crowded = segment.where(f"kinds > {CROWD}").select("rid", "id", "first", "data")
    counted = crowded.mapInArrow(lambda batches: windows(batches, width), f"{ROW}, start long, x long, y long")
    twice = counted.groupBy("x", "y").count().where("count > 1").select("x", "y")
    counted = counted.join(twice, ["x", "y"]).select("rid", "start", (F.col("start") + width).alias("stop"))

    copies = different.where("n > 1").select("h", "seg")
    copied = found.join(copies, ["h", "seg"]).select(
        "rid", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("more") + width).cast("long").alias("stop")
    )
    # The list of a document is no longer than its text.
    gone = copied.union(sorted_).union(counted).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone"))
    joined = rows.join(gone, "rid", "left").select("id", "data", "gone.start", "gone.stop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, "data", 4 * SLICE):
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                spans, kept = [], []
                for data, start, stop in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                    if not start:
                        spans.append([])
                        kept.append(data)
                        continue
                    start, reach = np.array(start), np.maximum.accumulate(stop)
                    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
                    pairs = list(zip(start[new].tolist(), reach[np.append(new[1:], len(start)) - 1].tolist()))
                    spans.append([{"start": a, "stop": b} for a, b in pairs])
                    edges = [0, *(x for pair in pairs for x in pair), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                lengths = pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), lengths, pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(cut, f"id {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
    return out.withColumnRenamed("id", ident)
