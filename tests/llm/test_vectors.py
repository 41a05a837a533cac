"""Vector links and nearest neighbours against all pairs."""

import math

import numpy as np
import pytest
from conftest_llm import classes

from metricmill.llm import collisions, vptree

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def crowd(n, width, near, seed):
    """Random vectors, and for each of some of them a few around it."""
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, width))
    parts = [x]
    for spread in near:
        base = x[draw.choice(n, n // 4)]
        parts.append(base + spread * np.linalg.norm(base, axis=1)[:, None] * draw.standard_normal(base.shape) / math.sqrt(width))
    return np.concatenate(parts).astype(np.float32)


def frame(spark, x, more=()):
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def cosines(x):
    x = x.astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1))
    return (x @ x.T) / np.outer(length, length)


@pytest.mark.parametrize("block, crowded", [(2048, 512), (64, 8)])
def test_links(spark, monkeypatch, block, crowded):
    monkeypatch.setattr(collisions, "BLOCK", block)
    monkeypatch.setattr(collisions, "CROWD", crowded)
    x = crowd(400, 24, (0.05, 0.2, 0.3, 0.33, 0.36), 4)
    x = np.concatenate((x, x[:30], x[:30]))
    got = {r["vec_id"]: r for r in collisions.near_duplicates(frame(spark, x)).collect()}
    near = cosines(x) >= 0.95
    np.fill_diagonal(near, False)
    pairs = np.argwhere(near)
    want = classes(range(len(x)), pairs.tolist())
    found, true = sum(r["n_links"] for r in got.values()), near.sum()
    assert 0.995 * true <= found <= true
    assert all(got[i]["n_links"] <= near[i].sum() for i in got)
    assert np.mean([got[i]["component_id"] == want[i] for i in got]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_unusable_vectors_link_with_nothing(spark):
    odd = [(100, None, 0), (101, [0.0] * 3, 0), (102, [1.0, NAN, 0.0], 0), (103, [1.0, INF, 0.0], 0), (104, [1.0, None, 0.0], 0), (105, [], 0),
           (106, [1.0, 0.0], 0), (None, [1.0, 0.0, 0.0], 0), (7, [2.0, 0.0, 0.0], 0), (7, [2.0, 0.0, 0.0], 0), (5, [1.0, 0.0, 0.0], 0), (9, [1e-30, 0.0, 0.0], 0), (10, [3e38, 1e37, 0.0], 0)]
    df = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "1 as n", "2 as id", "3 as v")
    got = [tuple(r) for r in collisions.near_duplicates(df).collect()]
    by = {r[0]: r for r in got if r[0] != 7}
    assert len(got) == len(odd)
    assert all(by[i][1:] == (0, i, True) for i in range(100, 107))
    assert by[None][1:] == (0, None, False)
    assert [r for r in got if r[0] == 7] == [(7, 4, 5, False)] * 2
    assert by[5][1:] == (4, 5, True) and by[9][1:] == (4, 5, False) and by[10][1:] == (4, 5, False)
    assert collisions.near_duplicates(df.limit(0)).count() == 0
    assert collisions.near_duplicates(df.where("vec_id >= 100 and vec_id <> 106")).count() == 6


def nearest(x, ids, queries, k):
    c = cosines(x)
    out = set()
    for q in queries:
        order = sorted((j for j in range(len(x)) if ids[j] != ids[q]), key=lambda j: (-round(c[q, j], 12), ids[j]))[:k]
        out |= {(ids[q], rank + 1, ids[j]) for rank, j in enumerate(order)}
    return out


def test_factor_one_is_exact(spark):
    x = crowd(900, 6, (0.02, 0.1), 8)
    df = frame(spark, x)
    got = vptree.nearest(df, df.where("vec_id % 50 = 0"), k=5, factor=1.0, shard_rows=400, query_rows=10).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == nearest(x, range(len(x)), range(0, len(x), 50), 5)
    c = cosines(x)
    assert all(math.isclose(r["score"], c[r["query_id"], r["vec_id"]], rel_tol=1e-12) for r in got)


def test_larger_factors_visit_less(spark):
    x = crowd(3000, 5, (0.02, 0.1), 8)
    units = x / np.linalg.norm(x, axis=1)[:, None]
    tree = vptree.Tree(units)
    want = np.sort(vptree.distance(units[:100], units), axis=1)[:, :6]
    seen = []
    for factor in (1.0, 1.5, 4.0):
        visits = []
        inner = tree._visit
        tree._visit = lambda node, active, inner=inner: (visits.append(len(active) * (len(node) == 1)), inner(node, active))
        far, _ = tree.search(units[:100], 6, factor)
        tree._visit = inner
        seen.append((np.isclose(np.sort(far, axis=1), want, atol=1e-6).mean(), sum(visits)))
    recalls, leaves = zip(*seen)
    assert recalls[0] == 1 and recalls[1] > 0.9
    assert leaves[0] > leaves[1] > leaves[2]


def test_ties_and_unusable_vectors(spark):
    same = [(i, [1.0, 1.0], 0) for i in range(12)]
    odd = [(50, None, 0), (100, [0.0, 0.0], 0), (None, [1.0, 1.0], 0), (150, [NAN, 1.0], 0), (200, [1.0, 1.0, 1.0], 0), (0, [1.0, 1.0], 0)]
    df = spark.createDataFrame(same + odd, SCHEMA)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in vptree.nearest(df, df.where("vec_id % 50 = 0")).collect()]
    assert sorted(got) == [(0, r, r) for r in range(1, 6)]
    few = vptree.nearest(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in few) == [(1, 1), (2, 2)]
    assert vptree.nearest(df.limit(0), df).count() == 0 and vptree.nearest(df, df.limit(0)).count() == 0


def test_scaled_copies_tie_and_go_to_the_smaller_id(spark):
    draw = np.random.default_rng(5)
    one = draw.standard_normal(6)
    rows = [(i, [float(c) for c in one * 2.0 ** ((7 * i) % 40 - 20)], 0) for i in range(60)]
    rows += [(100 + i, [float(c) for c in draw.standard_normal(6)], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for shard in (8192, 10):
        got = vptree.nearest(df, df.where("vec_id in (0, 3, 50)"), shard_rows=shard).collect()
        by = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 3, 50)}
        assert by == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 50: [0, 1, 2, 3, 4]}


def test_extreme_magnitudes(spark):
    rows = [(0, [1e200, 1e200], 0), (1, [2e200, 2e200], 0), (2, [1e-200, -1e-200], 0), (3, [1e-310, 1e-310], 0), (4, [1.0, 0.9], 0), (5, [-3e307, 3e307], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in collisions.near_duplicates(df).collect()}
    assert [found[i]["n_links"] for i in range(6)] == [3, 3, 0, 3, 3, 0]
    got = vptree.nearest(df, df.where("vec_id = 0")).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 3, 4, 2, 5]
    assert all(abs(r["score"]) <= 1 + 1e-12 for r in got)


def test_blocks_of_queries_change_nothing(spark):
    df = frame(spark, crowd(300, 6, (0.05,), 2))
    asked = df.where("vec_id % 3 = 0")
    whole, blocks = (sorted(map(tuple, vptree.nearest(df, asked, shard_rows=90, query_block=n).collect())) for n in (65_536, 25))
    assert whole == blocks and len(whole) == asked.count() * 5


def test_smallest_reachable_against_classes():
    draw = np.random.default_rng(9)
    for n in (1, 5, 60):
        for m in (0, n // 2, 3 * n):
            a, b = draw.integers(0, n, m), draw.integers(0, n, m)
            want = classes(range(n), zip(a.tolist(), b.tolist()))
            assert collisions.smallest_reachable(n, a, b).tolist() == [want[i] for i in range(n)]
