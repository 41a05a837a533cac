"""Quality rules: statistics of each text, judged by an isolation forest calibrated on labelled rows.

One pass over the texts leaves a short row of counts per document. The forest is grown on a bounded
sample of labelled rows; its threshold comes from the scores of all labelled rows; every document is
scored. Windows and lines are compared by their words, not by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmill.llm.common import slices

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
# Scores are binned this finely where the threshold is looked for.
BINS = 1_000


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window standing twice or more among ``words``."""
    n = len(words)
    if n < 4 or n < 5_000 and len(set(zip(words, words[1:], words[2:]))) == n - 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift: n - 2 + shift] |= twice
    return int(inside.sum())


def counted(text: str) -> tuple[int, ...]:
    """The COUNTS of one text."""
    words = text.encode().split()  # of bytes, at 0x20 and 0x09 to 0x0D only
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def statistics(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), one row per row of ``docs``.

    Lines without a word do not count. Null and empty texts have zeros; texts are read whole, a very long
    one by itself; null and repeated ids keep their rows; other columns are not read. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            rows = np.array([counted(t) for t in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T)], names=["__id", *COUNTS])

    rows = docs.select(F.col(ident).alias("__id"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"__id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    return made.withColumnRenamed("__id", ident)


def rates(counts: dict[str, np.ndarray]) -> np.ndarray:
    """What the trees split on, one row per document: shares that do not depend on a text's length.

    Roots spread the small values, where most documents lie.
    """
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    return np.stack((
        counts["word_chars"] / words,
        np.sqrt(counts["n_symbols"] / words),
        np.sqrt(counts["n_symbols"] / chars),
        np.sqrt(counts["n_dup_lines"] / words),
        np.sqrt(counts["n_repeat_words"] / words),
    ), axis=1)


def usual_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n entries."""
    n = np.asarray(n, float)
    more = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(more) + np.euler_gamma) - 2 * more / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """A random tree as arrays; a leaf points to itself and knows its path length."""

    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    length: np.ndarray
    depth: int

    def paths(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        every = np.arange(len(rows))
        for _ in range(self.depth):
            at = np.where(rows[every, self.feature[at]] < self.cut[at], self.below[at], self.above[at])
        return self.length[at]


def grow(rows: np.ndarray, depth: int, random: np.random.Generator) -> Tree:
    """Split at a uniform value of a random column that still varies, until rows are alone or ``depth`` is reached."""
    nodes: list[list] = []

    def add(part: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([0, 0.0, at, at, level + float(usual_path(len(part)))])
        low, high = part.min(axis=0), part.max(axis=0)
        vary = np.flatnonzero(high > low)
        if level < depth and len(vary):
            column = random.choice(vary)
            cut = random.uniform(low[column], high[column])
            cut = high[column] if cut <= low[column] else cut
            left = part[:, column] < cut
            nodes[at][:4] = column, cut, add(part[left], level + 1), add(part[~left], level + 1)
        return at

    add(rows, 0)
    columns = list(zip(*nodes))
    return Tree(*(np.array(c) for c in columns), depth)


@dataclass
class Forest:
    """Trees, the sample size their path lengths are measured by, and the score from which a document is odd."""

    trees: list[Tree]
    size: int
    threshold: float = np.inf

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): towards 1 for rows that few splits set apart."""
        if not self.trees:
            return np.zeros(len(rows))
        mean = sum(tree.paths(rows) for tree in self.trees) / len(self.trees)
        return 2.0 ** (-mean / float(usual_path(self.size)))


def scored(stats: DataFrame, forest: Forest, ident: str, carry: list[str]) -> DataFrame:
    """(ident, counts, carried columns, score)."""
    rows = stats.select(F.col(ident).alias("__id"), *COUNTS, *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {c: batch.column(i + 1).to_numpy(zero_copy_only=False) for i, c in enumerate(COUNTS)}
            found = pa.array(forest.scores(rates(counts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, score double")


def failed() -> F.Column:
    """The plain rules: under 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(
    stats: DataFrame, labels: DataFrame, ident: str = "doc_id", label: str = "quality", trees: int = 200,
    size: int = 512, odd: float = 0.01, sample: int = 8_192, loss: float = 0.01, seed: int = 12,
) -> Forest:
    """A forest grown on labelled rows that pass the plain rules, and its threshold.

    ``stats`` are the rows of ``statistics``; ``labels`` has (ident, label) with 1 for good and 0 for bad.
    At most ``sample`` rows of each label (those with the smallest hashes) are the pool that every tree
    draws ``size`` rows from, the share ``odd`` of them bad, as anomalies must be rare to stand alone. The
    threshold comes from all labelled rows: of the scores that lose at most the share ``loss`` of the good
    rows, the one that tells the labels apart best (largest difference between the shares of bad and of good
    rows at or above it). Null labels and ids do not count; a row labelled twice counts twice; without rows
    of either label nothing is odd.
    """
    known = labels.where(f"`{label}` in (0, 1)").select(F.col(ident).alias("__key"), F.col(label).cast("int").alias("__label"))
    rows = stats.where(~failed()).join(known, stats[ident] == known["__key"]).drop("__key")
    pools = []
    for value in (1, 0):
        drawn = rows.where(F.col("__label") == value).orderBy(F.xxhash64(ident, *COUNTS), ident).limit(sample).toPandas()
        pools.append(rates({c: drawn[c].to_numpy() for c in COUNTS}))
    good, bad = pools
    few = min(len(bad), max(1, round(odd * min(size, len(good)))))
    forest = Forest([], few + min(len(good), size - few))
    if not len(good) or not few:
        return forest
    random = np.random.default_rng(seed)
    depth = max(1, int(np.ceil(np.log2(forest.size))))
    for _ in range(trees):
        mixed = [part[random.choice(len(part), n, replace=False)] for part, n in ((good, forest.size - few), (bad, few))]
        forest.trees.append(grow(np.concatenate(mixed), depth, random))
    binned = scored(rows, forest, ident, ["__label"]).groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"))
    held = binned.agg(F.sum("__label").alias("good"), F.count("*").alias("all")).toPandas().sort_values("bin", ascending=False)
    right, wrong = held["good"].cumsum().to_numpy(float), (held["all"] - held["good"]).cumsum().to_numpy(float)
    right, wrong = right / right[-1], wrong / wrong[-1]
    gain = np.where(right <= loss, wrong - right, -1.0)
    if gain.max() > 0:
        forest.threshold = held["bin"].to_numpy()[gain.argmax()] / BINS
    return forest


def judge(stats: DataFrame, forest: Forest, ident: str = "doc_id") -> DataFrame:
    """``stats`` with score, base_failed and kept: neither failed by the plain rules nor odd to the forest.

    One row per row of ``stats``, in every case: null ids and documents without words (which fail) too.
    """
    found = scored(stats, forest, ident, []).withColumnRenamed("__id", ident)
    return found.withColumn("base_failed", failed()).withColumn("kept", ~failed() & (F.col("score") < F.lit(float(forest.threshold))))


def keep_good(docs: DataFrame, forest: Forest, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept.

    Decided row by row from the row's own text, so repeated and null ids do not mix. Null and empty texts go.
    """
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = np.array([counted(t) for t in batch.column(at).to_pylist()], np.int64)
            counts = dict(zip(COUNTS, rows.T))
            plain = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            yield batch.filter(pa.array(~plain & (forest.scores(rates(counts)) < forest.threshold)))

    return docs.mapInArrow(run, schema)
