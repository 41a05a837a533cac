"""Nearest neighbours by vantage-point trees, one per shard.

The base is dealt into shards of bounded size. In each a tree is built over the unit vectors, whose
distance, sqrt(2 - 2 cosine), obeys the triangle inequality: an inner node has a vantage point and the median
distance to it, and splits its points there. All queries of a block go down a tree together, each first to
the side its distance points to. The other side is left out if it lies further away than the query's worst
hit, that gap multiplied by ``factor`` first: with factor one the search is exact, larger factors leave out
more. A second descent gathers every point that is no further than the k-th within rounding, so that ties
are settled by id and not by the last bit. The shards' nearest are then merged per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricmill.llm.vectors import balanced, matrix, unit, usable
from metricmill.session import stage

LEAF = 256
# Pairs that a task scores at a time.
PAIRS = 200_000


class Tree:
    def __init__(self, points: np.ndarray, seed: int = 3):
        self.points, self.draw = points.astype(np.float64), np.random.default_rng(seed)
        # Room for rounding: squared distances are sums of products of components up to 1.
        self.slack = 2 * np.sqrt(8 * points.shape[1] * np.finfo(np.float64).eps)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= LEAF:
            return (rows,)
        top = rows[self.draw.integers(len(rows))]
        away = distance(self.points[rows], self.points[top][None])[:, 0]
        middle = np.median(away)
        near = away <= middle
        if near.all():  # all equally far: nothing to split
            return (rows,)
        return top, middle, self._build(rows[near]), self._build(rows[~near])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and rows of the k nearest points of each query, unsorted; row -1 where there are fewer."""
        self.far = np.full((len(queries), k), np.inf)
        self.row = np.full((len(queries), k), -1)
        self.queries, self.factor = queries.astype(np.float64), factor
        self._visit(self.root, np.arange(len(queries)))
        return self.far, self.row

    def within(self, queries: np.ndarray, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all points no further than ``reach`` from their query, within rounding."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        queries, reach = queries.astype(np.float64), reach + self.slack
        open_ = [(self.root, np.arange(len(queries)))]
        while open_:
            node, active = open_.pop()
            if len(node) == 1:
                at, row = np.nonzero(distance(queries[active], self.points[node[0]]) <= reach[active][:, None])
                found.append((active[at], node[0][row]))
                continue
            top, middle, near, far = node
            gap = distance(queries[active], self.points[top][None])[:, 0] - middle
            beside = np.abs(gap) * factor <= reach[active]
            open_ += [(side, active[own]) for side, own in ((near, (gap <= 0) | beside), (far, (gap > 0) | beside)) if own.any()]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _visit(self, node: tuple, active: np.ndarray) -> None:
        if not len(active):
            return
        if len(node) == 1:
            away = distance(self.queries[active], self.points[node[0]])
            k = self.far.shape[1]
            far = np.concatenate((self.far[active], away), axis=1)
            row = np.concatenate((self.row[active], np.broadcast_to(node[0], away.shape)), axis=1)
            best = np.argpartition(far, k - 1, axis=1)[:, :k]
            self.far[active] = np.take_along_axis(far, best, axis=1)
            self.row[active] = np.take_along_axis(row, best, axis=1)
            return
        top, middle, near, far = node
        gap = distance(self.queries[active], self.points[top][None])[:, 0] - middle
        inside = gap <= 0
        for side, other, own in ((near, far, inside), (far, near, ~inside)):
            self._visit(side, active[own])
            worst = self.far[active[own]].max(axis=1)
            self._visit(other, active[own][np.abs(gap[own]) * self.factor <= worst + self.slack])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def best_of(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: largest score, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    new = np.concatenate(([True], np.diff(query[order]) != 0))
    first = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def nearest(
    base: DataFrame,
    queries: DataFrame,
    k: int = 5,
    factor: float = 1.0,
    ident: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 8192,
    query_rows: int = 2048,
    query_block: int = 65_536,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows of ``base`` but those with its own id.

    score is the cosine of the original vectors in double precision; ranks count from 1, ties go to the
    smaller id. Vectors that are null or zero or hold null or non-finite components and rows with a null id
    take no part, on either side; vectors of another length than the query's are not compared. A base row that is repeated
    is one candidate, a repeated query one query. With fewer candidates than ``k`` all are returned, without any the query has no row. ``shard_rows``
    bounds what one tree holds, ``query_block`` the queries that a task gets with it, ``query_rows`` those that go
    down it at a time (both sides are dealt out by hash, so these are averages).
    """
    rows = F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")
    left = stage(base.select(*rows).where(usable("v") & F.col("id").isNotNull()))
    right = queries.select(*rows).where(usable("v") & F.col("id").isNotNull())
    right = stage(right)
    blocks = right.groupBy(F.size("v").alias("width")).agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
    widths = left.groupBy(F.size("v").alias("width")).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    # The joins are with tables of one row per vector length.
    sizes = widths.join(blocks, "width")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(sizes, F.size("v") == F.col("width")).select(
        "id", "v", "width", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), every("blocks").alias("block")
    )
    right = right.join(sizes, F.size("v") == F.col("width")).select(
        F.col("id").alias("asked_id"), F.col("v").alias("asked"), F.col("width").alias("asked_width"),
        F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("asked_block"), every("shards").alias("asked_shard"),
    )

    def search(key, held: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not held.num_rows or not asked.num_rows:
            return empty
        width = key[0].as_py()
        x, ids = matrix(held["v"], width), held["id"].to_numpy()
        order = np.lexsort((ids,))
        x, ids = x[order], ids[order]
        x = balanced(x)
        # Vectors of one direction stand once in the tree; each stands for its k + 1 smallest ids.
        units = unit(x)
        _, first, which = np.unique(units, axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        grouped = np.argsort(which, kind="stable")
        once = np.ones(len(grouped), bool)
        once[1:] = (np.diff(which[grouped]) != 0) | (np.diff(ids[grouped]) != 0)
        grouped = grouped[once]
        begins = np.searchsorted(which[grouped], np.arange(len(first) + 1))
        tree = Tree(units[first])
        q, names = balanced(matrix(asked["asked"], width)), asked["asked_id"].to_numpy()
        out = []
        for at in range(0, len(q), query_rows):
            part, own = q[at: at + query_rows], names[at: at + query_rows]
            away, _ = tree.search(unit(part), min(k + 1, len(first)), factor)
            asked_row, group = tree.within(unit(part), away.max(axis=1), factor)
            order = np.argsort(asked_row, kind="stable")
            asked_row, group = asked_row[order], group[order]
            held_best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            sizes = np.minimum(begins[group + 1] - begins[group], k + 1)
            for low in range(0, len(group), PAIRS):
                some, size = group[low: low + PAIRS], sizes[low: low + PAIRS]
                member = grouped[np.repeat(begins[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                row = np.repeat(asked_row[low: low + PAIRS], size)
                other = ids[member] != own[row]
                member, row = member[other], row[other]
                a, b = part[row], x[member]
                score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                best = best_of(row, score, ids[member], k)
                held_best.append((row[best], ids[member[best]], score[best]))
            row, near, score = (np.concatenate(c) for c in zip(*held_best))
            best = best_of(row, score, near, k)
            out.append((own[row[best]], near[best], score[best]))
        query_id, vec_id, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query_id": query_id, "vec_id": vec_id, "score": score})

    met = left.groupBy("width", "shard", "block").cogroup(right.groupBy("asked_width", "asked_shard", "asked_block"))
    hits = met.applyInArrow(search, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])
    # A query has at most k rows from each shard here.
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
