"""Language-model scores from a probabilistic suffix tree over the bytes of normalised words.

A text is its words, lower-cased in A-Z, joined by one space and closed by an end symbol. The tree's states
are contexts of up to DEPTH preceding symbols. A context becomes a state if it makes up at least ``least`` of
all training symbols, so that there are at most 1 / least states of each length whatever the corpus, and if its
next symbols diverge from those of the next shorter context by more than ``gain``; suffixes of states are
states. Each state's distribution is its counts smoothed with its parent's distribution. A symbol is
predicted by the longest suffix of what comes before it that is a state. The probability of a whole word,
with the space or end that closes it, is then smoothed with the word's share of the training words.

Counts are taken over all training texts. A task sums what it has read before anything is shuffled. The counts
of whole words, which the base score asks for, are looked up by chunk of texts: a chunk asks once for each of
its different words, known by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmill.llm.common import slices, told_apart
from metricmill.llm.hashing import Spans
from metricmill.session import scratch, stage

DEPTH = 5
END, START, SYMBOLS, BITS = 256, 257, 258, 9
# Rows of the input, in a row, that look up their words together (log2).
CHUNK = 13
# Different n-grams a task holds before it hands them on.
HELD = 3_000_000
WORDS, GRAMS = 0, 1


def normal(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes of all texts in a row, and where each starts (with the end as last entry)."""
    made = [b" ".join(x.lower().split()) for x in texts]
    lengths = np.fromiter(map(len, made), np.int64, len(made))
    return np.frombuffer(b"".join(made), np.uint8), np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))


def words(flat: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every running word, and the text it is in."""
    space = flat == 0x20
    edge = np.zeros(len(flat) + 1, bool)
    edge[docs] = True
    starts = np.flatnonzero(~space & (edge[:-1] | np.concatenate(([True], space[:-1]))))
    stops = np.flatnonzero(~space & (edge[1:] | np.concatenate((space[1:], [True])))) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return Spans(flat)(starts, stops), np.searchsorted(docs, starts, side="right") - 1


def sequence(flat: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols, each text after DEPTH start symbols; the places that are predicted, and their texts."""
    n = len(docs) - 1
    lengths = np.diff(docs)
    symbols = np.full(len(flat) + n * (DEPTH + 1), START, np.uint16)
    text = np.repeat(np.arange(n), lengths + 1)
    places = np.arange(len(flat) + n) + (text + 1) * DEPTH
    ends = docs[1:] + np.arange(n)
    inner = np.ones(len(places), bool)
    inner[ends] = False
    symbols[places[inner]] = flat
    symbols[places[ends]] = END
    return symbols, places, text


def grams(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Context and next symbol as one number: the nearest symbol first, the predicted one last."""
    key = np.zeros(len(places), np.int64)
    for back in range(1, DEPTH + 1):
        key = key << BITS | symbols[places - back]
    return key << BITS | symbols[places]


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


class Tree:
    """States of the tree and the log10 probabilities of all symbols in them."""

    def __init__(self, levels: list[pd.DataFrame], gain: float, weight: float):
        """``levels[d]`` holds (ctx, sym, n) for the frequent contexts of d symbols."""
        # A column for each symbol that occurs and for the start, and one that stands for every other symbol.
        seen = np.zeros(SYMBOLS, bool)
        seen[START] = True
        if len(levels[0]):
            seen[levels[0]["sym"].to_numpy()] = True
        width = int(seen.sum())
        self.column = np.full(SYMBOLS, width)
        self.column[seen] = np.arange(width)
        root = np.full(width + 1, 0.5)
        root[self.column[START]] = 0  # never predicted
        np.add.at(root, self.column[levels[0]["sym"].to_numpy(int)], levels[0]["n"].to_numpy(float))
        root /= root.sum() + 0.5 * (SYMBOLS - width - 1)
        # Smoothed distributions of all frequent contexts, level by level, and how far they diverge.
        keys, plain = [np.zeros(1, np.int64)], [root[None].astype(np.float32)]
        gains, above = [np.zeros(1)], [np.zeros(1, np.int64)]
        for level in levels[1:]:
            order = np.argsort(level["ctx"].to_numpy(), kind="stable")
            all_ctx, sym, n = (level[c].to_numpy()[order] for c in ("ctx", "sym", "n"))
            ctx, first = np.unique(all_ctx, return_index=True)
            first = np.append(first, len(all_ctx))
            up = np.minimum(np.searchsorted(keys[-1], ctx >> BITS), len(keys[-1]) - 1)
            rows, diverge = np.zeros((len(ctx), width + 1), np.float32), np.zeros(len(ctx))
            for at in range(0, len(ctx), 4096):
                part = slice(first[at], first[min(at + 4096, len(ctx))])
                table = np.zeros((len(ctx[at: at + 4096]), width + 1))
                np.add.at(table, (np.searchsorted(ctx[at: at + 4096], all_ctx[part]), self.column[sym[part]]), n[part])
                total = table.sum(axis=1, keepdims=True)
                parent = plain[-1][up[at: at + 4096]].astype(float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    diverge[at: at + 4096] = np.where(table > 0, table * np.log(table / total / parent), 0).sum(axis=1)
                rows[at: at + 4096] = (table + weight * parent) / (total + weight)
            plain.append(rows)
            gains.append(np.where(keys[-1][up] == ctx >> BITS, diverge, -1))
            keys.append(ctx)
            above.append(up)
        # A context stays if it or a longer one below it diverges enough.
        stays = [g > gain for g in gains]
        for d in range(len(keys) - 1, 1, -1):
            stays[d - 1][above[d][stays[d]]] = True
        stays[0][:] = True
        # Only these travel to the tasks: each state's key, and its row of probabilities.
        self.keys = [k[s] for k, s in zip(keys, stays)]
        self.logs = np.log10(np.maximum(np.concatenate([p[s] for p, s in zip(plain, stays)]), np.float32(1e-35)))

    def children(self) -> np.ndarray:
        """(state, column): the state one symbol longer, 0 if there is none."""
        offset = np.cumsum([0, *map(len, self.keys)])
        child = np.zeros(self.logs.shape, np.int32)
        for d in range(1, len(self.keys)):
            ctx = self.keys[d]
            up = np.searchsorted(self.keys[d - 1], ctx >> BITS)
            child[offset[d - 1] + up, self.column[ctx & (1 << BITS) - 1]] = offset[d] + np.arange(len(ctx))
        return child

    def score(self, symbols: np.ndarray, places: np.ndarray, child: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol at each place."""
        symbols = self.column[symbols]
        state = np.zeros(len(places), np.int64)
        alive = np.arange(len(places))
        flat, wide = child.ravel(), child.shape[1]
        for back in range(1, len(self.keys)):
            below = flat[state[alive] * wide + symbols[places[alive] - back]]
            on = below > 0
            alive = alive[on]
            state[alive] = below[on]
        return self.logs.ravel()[state * wide + symbols[places]]


def score(
    docs: DataFrame,
    held_out: Column,
    ident: str = "doc_id",
    text: str = "text",
    least: float = 5e-6,
    gain: float = 10.0,
    weight: float = 30.0,
    unigram: float = 0.1,
) -> DataFrame:
    """One row (ident, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    The model is learned from the rows where ``held_out`` is not true; all are scored. n_tokens counts words
    and one end; n_known those that occur in training texts; base_score is the log10 probability of the
    tokens under smoothed unigrams, score that of the text under the tree, of which a share ``unigram`` is given
    to the words' shares. Null counts as empty text (one
    token, the end); null and repeated ids keep their rows. Without training texts all symbols are equally
    likely. Chunks are rows of a file in a row; a table that is not read from files is checkpointed
    first. Other columns are not read; an empty table gives an empty result.
    """
    own = F.col(f"`{ident}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text")
    rows = told_apart(docs.select(*own, F.coalesce(held_out, F.lit(False)).alias("held_out"))).select(
        F.xxhash64("__row.file", F.shiftright("__row.row", CHUNK)).alias("chunk"),
        F.col("__id").alias("id"),
        "held_out",
        F.coalesce("__text", F.lit("")).cast("binary").alias("data"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Word counts by chunk (0 for words of held-out texts only) and n-gram counts by task."""

        def out(kind, chunk, keys, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(np.full(len(keys), chunk, np.int64)), pa.array(keys), pa.array(n.astype(np.int64))],
                names=["kind", "chunk", "key", "n"],
            )

        seen: list = []
        held: list = []
        here = None
        for batch in slices(batches, "data"):
            chunks = batch.column(0).to_numpy()
            train = ~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            flat, at = normal(batch.column(2).to_pylist())
            hashes, doc = words(flat, at)
            chunk = chunks[doc]
            for c in dict.fromkeys(chunk.tolist()):
                if c != here:
                    if seen:
                        yield out(WORDS, here, *tally(*(np.concatenate(x) for x in zip(*seen))))
                    seen, here = [], c
                own = chunk == c
                keys, which = np.unique(hashes[own], return_inverse=True)
                seen.append((keys.view(np.int64), np.bincount(which, train[doc[own]], len(keys))))
            symbols, places, text = sequence(flat, at)
            held.append(tally(grams(symbols, places[train[text]])))
            if sum(len(x[0]) for x in held) > HELD:
                held = [tally(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > HELD // 2:
                    yield out(GRAMS, -1, *held.pop())
        if seen:
            yield out(WORDS, here, *tally(*(np.concatenate(x) for x in zip(*seen))))
        if held:
            yield out(GRAMS, -1, *tally(*(np.concatenate(x) for x in zip(*held))))

    spark = docs.sparkSession
    path = scratch(spark, "suffix-tree")
    kinds = "kind int, chunk long, key long, n long"
    rows.select("chunk", "held_out", "data").mapInArrow(count, kinds).write.parquet(path)
    counted = spark.read.schema(kinds).parquet(path)

    every = stage(counted.where(F.col("kind") == GRAMS).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0"))
    total = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    floor = max(2, least * total)
    levels = []
    for depth in range(DEPTH + 1):
        level = every.groupBy(F.shiftright("key", BITS * (DEPTH + 1 - depth)).alias("ctx"), F.col("key").bitwiseAND((1 << BITS) - 1).alias("sym")).agg(F.sum("n").alias("n"))
        often = level.groupBy("ctx").agg(F.sum("n").alias("all")).where(F.col("all") >= (floor if depth else 1))
        levels.append(level.join(often, "ctx").select("ctx", "sym", "n").toPandas())  # at most 1 / least contexts
    tree = Tree(levels, gain, weight)

    asked = counted.where(F.col("kind") == WORDS)
    vocabulary = asked.groupBy("key").agg(F.sum("n").alias("c")).where("c > 0")
    vocabulary = stage(vocabulary)
    ends, running, kinds_ = (
        rows.where("not held_out").count(),
        *vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first(),
    )
    tokens, size = running + ends, kinds_ + (ends > 0)
    answered = asked.select("key", F.col("chunk").alias("for_chunk")).join(vocabulary, "key").select("for_chunk", "key", "c")

    def rate(key, texts: pa.Table, known: pa.Table) -> pa.Table:
        child = tree.children()
        order = np.argsort(known["key"].to_numpy())
        names, counts = known["key"].to_numpy()[order], known["c"].to_numpy()[order]
        bottom = np.log10(tokens + 0.5 * (size + 1)) if tokens else np.log10(0.5)
        made = []
        texts = texts.combine_chunks()
        for batch in slices(texts.to_batches(), "data", 2_000_000):
            n = batch.num_rows
            flat, at = normal(batch.column(3).to_pylist())
            hashes, doc = words(flat, at)
            near = np.searchsorted(names, hashes.view(np.int64))
            near = np.minimum(near, max(0, len(names) - 1))
            c = np.where(names[near] == hashes.view(np.int64), counts[near], 0) if len(names) else np.zeros(len(hashes), np.int64)
            n_tokens = np.bincount(doc, minlength=n) + 1
            n_known = np.bincount(doc, c > 0, n).astype(np.int64) + (ends > 0)
            base = np.bincount(doc, np.log10(c + 0.5), n) + np.log10(ends + 0.5) - n_tokens * bottom
            symbols, places, text = sequence(flat, at)
            logs = tree.score(symbols, places, child)
            # Words with what closes them; a text without words is one end.
            last = symbols[places]
            close = np.flatnonzero((last == 0x20) | (last == END))
            event = np.searchsorted(close, np.arange(len(places)))
            spelled = np.bincount(event, logs, len(close))
            whole = np.zeros(len(close))
            whole[np.diff(at)[text[close]] > 0] = np.where(c > 0, (c + 0.5) / 10**bottom, 0)
            ending = (ends + 0.5) / 10**bottom
            whole[last[close] == END] *= ending / max(1 - ending, ending)
            whole[np.diff(at)[text[close]] == 0] = ending
            scores = np.bincount(text[close], np.log10(unigram * whole + (1 - unigram) * 10**spelled), n)
            made.append(
                pa.RecordBatch.from_arrays(
                    [batch.column(1), batch.column(2), pa.array(n_tokens.astype(np.int64)), pa.array(n_known), pa.array(np.full(n, tokens, np.int64)), pa.array(base), pa.array(scores)],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.Table.from_batches(made, made[0].schema) if made else out_schema.empty_table()

    kind = rows.schema["id"].dataType.simpleString()
    out_schema = pa.schema([("id", texts_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    rated = rows.groupBy("chunk").cogroup(answered.groupBy("for_chunk")).applyInArrow(
        rate, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return rated.withColumnRenamed("id", ident)


def texts_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.string())
