"""Isolation forest over series values.

Scoring is relational. Only growing the trees of a series on sampled values is a Python
helper. In one dimension a tree is a step function of the value, so the forest is one
sorted list of steps and scoring is a running sum over it.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricmill.functions.quantiles import with_quantiles
from metricmill.operators.anomalies import anomaly_rows, severity
from metricmill.operators.series import KEY, indexed
from metricmill.session import stage

EULER = 0.5772156649015329


def usual_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow_tree(values: np.ndarray, seed: int) -> tuple[list[float], list[float]]:
    """Starts (exclusive) and path lengths of the leaves, from left to right."""
    rng = np.random.default_rng(seed)
    values = np.sort(values)
    limit = math.ceil(math.log2(max(len(values), 2)))
    starts, depths = [], []
    stack = [(0, len(values), 0, -math.inf)]
    while stack:
        low, high, depth, start = stack.pop()
        size = high - low
        if depth >= limit or size <= 1 or values[low] == values[high - 1]:
            starts.append(start)
            depths.append(depth + usual_depth(size))
            continue
        cut = rng.uniform(values[low], values[high - 1])
        middle = min(max(low + int(np.searchsorted(values[low:high], cut, side="right")), low + 1), high - 1)
        stack.append((middle, high, depth + 1, cut))
        stack.append((low, middle, depth + 1, start))
    return starts, depths


def isolation_forest(
    series: DataFrame, contamination: float = 0.1, seed: int = 42, trees: int = 100, sample: int = 256
) -> DataFrame:
    """Points in the highest ``contamination`` share of isolation scores, per series.

    Each of ``trees`` trees is grown on ``sample`` values drawn from the series, as the algorithm has it; a
    series is a roll-up, bounded by its calendar slots, so its trees are grown together.
    """
    rows = indexed(series).filter("n >= 4")

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        key = group[KEY].iloc[0]
        values = group.sort_values("idx")["value"].to_numpy(dtype=float)
        found = []
        for tree in range(trees):
            mark = zlib.crc32(f"{seed}|{key}|{tree}".encode())
            drawn = np.random.default_rng([mark, 1]).permutation(len(values))[:sample]
            starts, depths = grow_tree(values[drawn], mark)
            # A step holds the change of path length at its start; the first leaf starts at -inf.
            found.append(pd.DataFrame({KEY: key, "value": starts, "step": np.diff(depths, prepend=0.0)}))
        return pd.concat(found)

    steps = rows.select(KEY, "idx", "value").groupBy(KEY).applyInPandas(grow, f"{KEY} string, value double, step double")

    # A value on a cut belongs to the left leaf, so rows precede the steps of equal value.
    running = Window.partitionBy(KEY).orderBy("value", "is_step").rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.select(
        KEY, "idx", "n", "ts", "value", F.lit(0.0).alias("step"), F.lit(0).alias("is_step")
    ).unionByName(steps.withColumn("is_step", F.lit(1)), allowMissingColumns=True)
    psi = F.least(F.lit(sample), F.col("n"))
    usual = 2.0 * (F.log(psi - 1.0) + EULER) - 2.0 * (psi - 1.0) / psi
    scored = (
        merged.withColumn("path", F.sum("step").over(running) / trees)
        .filter("is_step = 0")
        .withColumn("score", F.pow(F.lit(2.0), -F.col("path") / usual))
    )
    scored = with_quantiles(stage(scored), [KEY], "score", {"cut": 1.0 - contamination}).filter("score > cut")
    score = F.col("score")
    return anomaly_rows(scored, "isolation_forest", F.lit(0.0), score, score, severity(score * 10))
