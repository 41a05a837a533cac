"""Near-duplicate vectors by counting collisions on one-dimensional projections.

Two unit vectors whose cosine is at least c lie within sqrt(2 - 2 c) of each other, so on a Gaussian
projection they differ by a normal deviate of at most that size. A window around the query's value that
holds such a neighbour with probability HIT is used on COUNTED projections; a pair is verified if it
collides on so many of them that a pair at exactly the threshold is missed with probability MISS at most.

Counting all pairs would be quadratic, so pairs are counted where they meet in one of several tables.
A table sorts the vectors by a few coarse projection values (cells); their number grows with the logarithm of
the table's length, and so many tables are kept that a pair at the threshold shares a cell in one of them
with probability 1 - MISS. A cell is processed in blocks of BLOCK rows, block against block, so a cell
that holds a third of all rows is many small tasks. Vectors that are equal are counted once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmill.llm.components import components
from metricmill.llm.hashing import BASE, scatter
from metricmill.llm.vectors import balanced, matrix, unit, usable
from metricmill.session import stage

COUNTED, HIT, MISS = 32, 0.9, 1e-4
CELL = 1.5  # width of a cell, in units of a projection's spread
CROWD = 512  # rows of unrelated vectors that a cell may hold on average
BLOCK = 2048
PAIRS = 65_536  # pairs that are verified at a time


class Plan:
    """Projections, windows, and the calibrated numbers for one threshold, dimension and table length."""

    def __init__(self, cosine: float, width: int, rows: int, seed: int = 7):
        spread = math.sqrt(max(2 - 2 * cosine, 1e-12))
        self.cosine, self.width, self.spread = cosine, width, spread
        # The window: two-sided normal quantile for HIT, by bisection.
        low, high = 0.0, 10.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if math.erf(middle / math.sqrt(2)) < HIT else (low, middle)
        self.window = high * spread
        # The largest count that a pair at the threshold reaches with probability 1 - MISS.
        self.count, tail = 0, 1.0
        while tail >= 1 - MISS and self.count <= COUNTED:
            tail -= math.comb(COUNTED, self.count) * HIT**self.count * (1 - HIT) ** (COUNTED - self.count)
            self.count += 1
        self.count -= 1
        # Chances of one shared cell coordinate: for a pair at the threshold, and for unrelated vectors.
        steps = (np.arange(4000) + 0.5) / 4000 * CELL
        near = np.exp(-0.5 * (steps / spread) ** 2) / (spread * math.sqrt(2 * math.pi)) * 2
        far = np.exp(-0.25 * steps**2) / math.sqrt(4 * math.pi) * 2
        share = 1 - steps / CELL
        near, far = float((near * share).mean() * CELL), float((far * share).mean() * CELL)
        if spread < 0.01:
            near = 1 - spread * math.sqrt(2 / math.pi) / CELL
        self.depth = max(1, math.ceil(math.log(max(rows, 1) / CROWD) / -math.log(far))) if rows > CROWD else 1
        self.tables = math.ceil(math.log(MISS) / math.log(1 - min(near**self.depth, 1 - MISS)))
        draw = np.random.default_rng(seed)
        self.counted = draw.standard_normal((width, COUNTED))
        self.coarse = draw.standard_normal((width, self.tables * self.depth))
        self.shift = draw.uniform(0, CELL, self.tables * self.depth)

    def cells(self, units: np.ndarray) -> np.ndarray:
        """(rows, tables): a number for the cell of each row in each table."""
        places = np.floor((units @ self.coarse + self.shift) / CELL).astype(np.int64).view(np.uint64)
        places = places.reshape(len(units), self.tables, self.depth)
        out = np.broadcast_to(scatter(np.arange(self.tables, dtype=np.uint64)), places.shape[:2]).copy()
        for k in range(self.depth):
            out = scatter(out * BASE + places[:, :, k])
        return out.view(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of two blocks of unit vectors that collide often enough and pass the exact test."""
        a, b = left @ self.counted, right @ self.counted
        order = np.argsort(b[:, 0], kind="stable")
        b = b[order]
        found = []
        rows = np.argsort(a[:, 0], kind="stable")
        for at in range(0, len(rows), 128):
            own = rows[at: at + 128]
            # A pair may miss on the first projection and pass the count; no pair at the threshold is six
            # spreads apart. Rows are sorted there, so a run of queries shares one stretch of candidates.
            low = np.searchsorted(b[:, 0], a[own[0], 0] - 6 * self.spread)
            high = np.searchsorted(b[:, 0], a[own[-1], 0] + 6 * self.spread, side="right")
            if low == high:
                continue
            seen = np.zeros((len(own), high - low), np.uint8)
            for k in range(COUNTED):
                seen += np.abs(a[own, k][:, None] - b[low:high, k][None, :]) <= self.window
            i, j = np.nonzero(seen >= self.count)
            i, j = own[i], order[low + j]
            if same:
                i, j = i[i < j], j[i < j]
            good = np.einsum("ij,ij->i", left[i], right[j]) >= self.cosine - 1e-9
            found.append((i[good], j[good]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of row pairs of the original vectors (or of ``balanced`` ones), in double precision."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable by the links a to b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def links(distinct: DataFrame, plan: Plan) -> DataFrame:
    """(id, linked, root): what the meetings of blocks found out about each of their vectors that has a link there.

    linked counts the rows whose vectors reach the cosine, each pair in one meeting only; root is the smallest
    id that links of the meeting reach. So a meeting writes a row per vector however many pairs it has.
    ``distinct`` holds (id, n, v): an id, how many rows share the vector, and the vector as doubles.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                if batch.num_rows:
                    x = matrix(batch.column(2), plan.width)
                    cells = pa.ListArray.from_arrays(
                        np.arange(len(x) + 1, dtype=np.int32) * plan.tables, plan.cells(unit(x)).ravel()
                    )
                    yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=["id", "n", "v", "cells"])

    placed = stage(distinct.mapInArrow(place, "id long, n long, v array<double>, cells array<long>"))
    single = placed.select("id", F.posexplode("cells").alias("no", "cell"))
    full = single.groupBy("cell").count()
    full = full.where("count > 1").select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # Each row goes to its block's meeting with every block of the cell.
    rows = single.join(full, "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "id", "no", "cell", "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second")
    )
    rows = rows.join(placed.select("id", "n", "v"), "id")

    def meet(table: pa.Table) -> pa.Table:
        ids, n = table["id"].to_numpy(), table["n"].to_numpy()
        x = balanced(matrix(table["v"], plan.width))
        units = unit(x)
        no = table["no"][0].as_py()
        own, low, high = table["own"].to_numpy(), table["first"][0].as_py(), table["second"][0].as_py()
        p, q = np.flatnonzero(own == low), np.flatnonzero(own == high)
        i, j = plan.pairs(units[p], units[q], low == high)
        i, j = p[i], q[j]
        keep = [exact(x[i[at: at + PAIRS]], x[j[at: at + PAIRS]]) >= plan.cosine for at in range(0, len(i), PAIRS)]
        keep = np.concatenate([np.zeros(0, bool), *keep])
        i, j = i[keep], j[keep]
        keep = keep[keep]
        # A pair that shares several cells counts in the first table only.
        for at in range(0, len(i), 8192):
            a, b = i[at: at + 8192], j[at: at + 8192]
            rows, back = np.unique(np.concatenate((a, b)), return_inverse=True)
            cells = plan.cells(units[rows])
            keep[at: at + len(a)] = (cells[back[: len(a)]] == cells[back[len(a):]]).argmax(axis=1) == no
        keep = keep[: len(i)]
        i, j = i[keep], j[keep]
        linked = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = ids[order][smallest_reachable(len(ids), place[i], place[j])[place]]
        some = linked > 0
        return pa.table({"id": ids[some], "linked": linked[some].astype(np.int64), "root": root[some]})

    return rows.groupBy("cell", "first", "second").applyInArrow(meet, "id long, linked long, root long")


def near_duplicates(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row (ident, n_links, component_id, kept) per row of ``vectors``.

    n_links counts the other rows whose vector has at least the cosine, equal vectors included; component_id
    is the smallest id reachable by links, kept says whether it is the row's own. Vectors that are null or
    zero or hold null or non-finite components link with nothing, as do vectors of different length. Null
    ids give a row without links and with null component. Rows that repeat an id count as vectors of their
    own. An empty table gives an empty result.
    """
    name = F.col(f"`{ident}`").cast("long")
    rows = vectors.select(name.alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.withColumn("good", usable("v") & F.col("id").isNotNull())
    good = rows.where("good").select("id", "v")
    distinct = stage(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "v"))
    found = None
    for width, count in distinct.groupBy(F.size("v")).count().collect():  # a table has one or few dimensions
        met = links(distinct.where(F.size("v") == width), Plan(cosine, width, count))
        found = met if found is None else found.union(met)
    if found is None:
        return rows.select(F.col("id").alias(ident), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = stage(found)
    degree = found.groupBy("id").agg(F.sum("linked").alias("linked"))
    whole = (
        distinct.join(degree, "id", "left")
        .join(components(found, "id", "root").withColumnRenamed("node", "id"), "id", "left")
        .select("v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked = good.join(whole, "v").select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(ident), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
