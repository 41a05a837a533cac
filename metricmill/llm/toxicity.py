"""Toxicity by a linear classifier over character n-grams scaled with naive Bayes log-count ratios.

A feature is the presence of a character n-gram in the lower-cased text. Its value is the log ratio of
how often toxic and other training texts hold it; a logistic regression learns a weight per feature on
top. n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmill.llm import letters
from metricmill.llm.common import slices
from metricmill.llm.hashing import powers, scatter
from metricmill.session import stage

ORDERS = (3, 4, 5)
# log2 of the size of the table that tells which n-grams cannot be features.
FILTER_BITS = 20


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the n-gram hashes of all texts in a row, and the place of each text's first (with the end)."""
    codes, docs = letters.points([x.lower() for x in texts])
    factors = powers(np.uint64(0xD6E8FEB86659FD93), max(ORDERS) + 1)
    codes = codes.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(codes), np.uint64)
    for k in range(max(ORDERS)):
        total[: len(codes) - k] += codes[k:] * factors[k + 1]
        if k + 1 in ORDERS:
            places = np.flatnonzero(_whole(docs, len(codes), k + 1))
            yield scatter(total[places] + np.uint64(k + 1)), np.searchsorted(places, docs)


def _whole(docs: np.ndarray, n: int, width: int) -> np.ndarray:
    """Whether an n-gram of the width that starts at a place stays in its text."""
    step = np.zeros(n + 1, np.int32)
    starts, stops = docs[:-1], np.maximum(docs[1:] - width + 1, docs[:-1])
    np.add.at(step, starts, 1)
    np.add.at(step, stops, -1)
    return np.cumsum(step[:n]) > 0


class Classifier:
    """Selected n-grams (sorted hashes), their weights, and the intercept."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, intercept: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.intercept = hashes[order], weights[order], intercept
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of every selected n-gram that a text holds, each once."""
        found = []
        for hashes, first in grams(texts):
            at = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - FILTER_BITS)])
            near = np.searchsorted(self.hashes, hashes[at])
            hit = near < len(self.hashes)
            hit[hit] = self.hashes[near[hit]] == hashes[at[hit]]
            doc = np.searchsorted(first, at[hit], side="right") - 1
            found.append(doc * len(self.hashes) + near[hit])
        pairs = np.unique(np.concatenate(found))
        return np.divmod(pairs, max(1, len(self.hashes)))

    def score(self, texts: list[str]) -> np.ndarray:
        doc, feature = self.present(texts)
        total = self.intercept + np.bincount(doc, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def regression(doc: np.ndarray, value: np.ndarray, feature: np.ndarray, label: np.ndarray, width: int, penalty: float, rounds: int) -> tuple:
    """Logistic regression with an L2 penalty by accelerated gradient descent; (weights, intercept)."""
    n = len(label)
    # An upper bound of the curvature: the largest eigenvalue of X'X by power iteration.
    x = np.ones(width + 1)
    for _ in range(12):
        z = np.bincount(doc, value * x[feature], n) + x[-1]
        y = np.append(np.bincount(feature, value * z[doc], width), z.sum())
        top = np.linalg.norm(y) / np.linalg.norm(x)
        x = y / np.linalg.norm(y)
    step = 1 / (0.3 * top + penalty)
    w = ahead = np.zeros(width + 1)
    for t in range(rounds):
        z = np.bincount(doc, value * ahead[feature], n) + ahead[-1]
        rest = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label
        slope = np.append(np.bincount(feature, value * rest[doc], width) + penalty * ahead[:-1], rest.sum())
        new = ahead - step * slope
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], w[-1]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = 8_000,
    features: int = 3_000,
    least: int = 5,
    penalty: float = 0.3,
    rounds: int = 300,
) -> Classifier:
    """Learn from the rows of ``docs`` that ``labels`` (ident, label 0 or 1) has a label for.

    The fit uses a sample of about ``sample`` labelled rows, chosen by the hash of the id. Spark counts in
    how many toxic and other texts each n-gram occurs; of those in at least ``least`` texts the ``features``
    with the largest chi-square statistic are kept. A text labelled twice counts as toxic if one label says
    so; rows with a null id, label or text are not learned from. Without both classes every text gets the
    share of toxic labels (0 without labels).
    """
    marks = labels.where(F.col(ident).isNotNull() & F.col(label).isNotNull())
    marks = marks.groupBy(F.col(ident).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    held = marks.count()
    draw = F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1 << 30))
    marks = marks.where(draw < min(1.0, sample / max(1, held)) * (1 << 30))
    # About ``sample`` rows whatever the size of the input, so they can be sent to every executor.
    rows = docs.select(F.col(ident).alias("__id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = stage(rows.join(F.broadcast(marks), "__id").select("label", "text"))
    sums = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    n, toxic = int(sums[0]), int(sums[1])
    none = np.zeros(0, np.uint64)
    if not 0 < toxic < n:
        share = toxic / n if n else 0.0
        return Classifier(none, np.zeros(0), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            marked = np.asarray(batch.column(0)).astype(bool)
            for hashes, first in grams(batch.column(1).to_pylist()):
                own = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
                flags = np.repeat(marked, [len(x) for x in own])
                keys, at = np.unique(np.concatenate(own), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.bincount(at, flags, len(keys))), pa.array(np.bincount(at, ~flags, len(keys)))],
                    names=["gram", "p", "q"],
                )

    counts = rows.mapInArrow(count, "gram long, p double, q double").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    clean = n - toxic
    gap = (F.col("p") / toxic - F.col("q") / clean) ** 2
    share = (F.col("p") + F.col("q")) / n
    kept = counts.where(F.col("p") + F.col("q") >= least).withColumn("chi", gap / (share * (1 - share) + 1e-9))
    chosen = kept.orderBy(F.col("chi").desc(), "gram").limit(features).toPandas()
    ratio = np.log((chosen["p"].to_numpy() + 1) / (toxic + 2)) - np.log((chosen["q"].to_numpy() + 1) / (clean + 2))
    start = Classifier(chosen["gram"].to_numpy(np.int64).view(np.uint64), ratio, 0.0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, feature = start.present(batch.column(1).to_pylist())
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["label", "features"])

    seen = rows.mapInArrow(look, "label int, features array<int>").toArrow()
    label_of = seen["label"].to_numpy().astype(float)
    lists = seen["features"].combine_chunks()
    doc = np.repeat(np.arange(len(label_of)), lists.value_lengths().to_numpy(zero_copy_only=False))
    feature = lists.flatten().to_numpy(zero_copy_only=False)
    weights, intercept = regression(doc, start.weights[feature], feature, label_of, len(start.weights), penalty, rounds)
    return Classifier(start.hashes, start.weights * weights, float(intercept))


def classify(docs: DataFrame, model: Classifier, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (ident, score, predicted) per row of ``docs``, from its whole text alone.

    score is the probability that the text is toxic, predicted 1 from 0.5 on. Null counts as empty text,
    which scores by the intercept. Null and repeated ids keep their rows; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            scores = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["__id", "score", "predicted"]
            )

    rows = docs.select(F.col(ident).alias("__id"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, score double, predicted int").withColumnRenamed("__id", ident)
