import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metricmill.functions.quantiles import exact_quantiles, values_from_top
from metricmill.functions.scalars import composite_score, first_json, rupiah, rupiah_short, shortened
from metricmill.functions.tdist import two_sided
from metricmill.functions.timeparts import bucket_start, elapsed_days, in_period, parse_period


@pytest.mark.parametrize(
    "text, days",
    [
        ("last 30 days", 30), ("last 7 days", 7), ("12 hours", 0.5), ("last_24h", 1), ("last_7d", 7), ("2 weeks", 14),
        ("3w", 21), ("last 3 months", 90), ("hour", 1 / 24), ("yesterday or so", 1), ("all time", 30),
    ],
)
def test_parse_period(text, days):
    assert parse_period(text) == pytest.approx(days)


def test_weeks_start_on_sunday_and_days_are_elapsed(frame):
    df = frame([("2024-01-07 10:00:00", "2024-01-08 09:59:59"), ("2024-01-08 00:00:00", "2024-01-10 00:00:00")],
               "a timestamp, b timestamp")
    got = df.select(
        F.date_format(bucket_start(F.col("a"), "weekly"), "yyyy-MM-dd").alias("w"),
        elapsed_days(F.col("a"), F.col("b")).alias("d"),
    ).collect()
    assert [(r.w, r.d) for r in got] == [("2024-01-07", 0), ("2024-01-07", 2)]


def test_period_is_two_sided(frame):
    df = frame([("2024-01-01",), ("2024-01-30 23:59:59",), ("2024-01-31",), ("2023-12-31 23:59:59",)], "ts timestamp")
    assert df.filter(in_period("ts", "2024-01-31", 30)).count() == 2


def _numbers(spark, seed=3):
    rng = np.random.default_rng(seed)
    hot = np.round(rng.lognormal(3, 2, 4000), 2)
    values = {"hot": hot, "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.0]),
              "negative": -rng.random(101)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None)]
    return values, spark.createDataFrame(rows, "k string, v double").repartition(8)


def test_exact_quantiles_with_ties_and_hot_keys(spark):
    values, df = _numbers(spark)
    probs = {"q05": 0.05, "median": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(values)
    for key, vs in values.items():
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(vs, p * 100), rel=1e-12)


def test_exact_quantiles_without_keys(spark):
    values, df = _numbers(spark)
    everything = np.concatenate(list(values.values()))
    row = exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert row.m == pytest.approx(np.median(everything))


@pytest.mark.parametrize("size", [1, 5, 10, 997])
def test_values_from_top_match_the_sorted_list(spark, size):
    vs = [float(v) for v in np.random.default_rng(size).integers(0, 60, size)]
    df = spark.createDataFrame([(v,) for v in vs], "v double")
    got = values_from_top(df, "v", {"high": 0.2, "low": 0.6})
    ordered = sorted(vs, reverse=True)
    assert got == {"high": ordered[int(size * 0.2)], "low": ordered[int(size * 0.6)]}
    assert values_from_top(df.limit(0), "v", {"high": 0.2}) == {}


def _integrated(t, df):
    """Two-sided tail by integrating the density in the angle, where it is smooth and bounded."""
    theta = np.linspace(0, math.atan(abs(t) / math.sqrt(df)), 200_001)
    y = np.cos(theta) ** (df - 1)
    area = float(((y[1:] + y[:-1]) / 2 * np.diff(theta)).sum())
    norm = math.sqrt(math.pi) * math.exp(math.lgamma(df / 2) - math.lgamma((df + 1) / 2)) / 2
    return 1 - area / norm


@settings(max_examples=40, deadline=None)
@given(st.floats(0.01, 6), st.integers(1, 400))
def test_t_probability_against_integration(t, df):
    assert two_sided(np.array([t]), np.array([float(df)]))[0] == pytest.approx(_integrated(t, df), abs=1e-8)


def test_t_probability_known_points():
    p = two_sided(np.array([0.0, 2.228138852, -2.228138852, 1.959963985]), np.array([3.0, 10.0, 10.0, 1e9]))
    assert p == pytest.approx([1.0, 0.05, 0.05, 0.05], abs=1e-8)


def test_scalars(spark):
    df = spark.createDataFrame(
        [(500, "a" * 500, 'x {"a": {"b": 1}} y'), (12_500, "b" * 501, "none"), (2_500_000, "c", "{}"),
         (3_250_000_000, "d", None)],
        "n long, s string, t string",
    )
    got = df.select(
        rupiah(F.col("n")).alias("r"), rupiah_short(F.col("n")).alias("c"), shortened(F.col("s")).alias("s"),
        first_json(F.col("t")).alias("j"),
    ).collect()
    assert [r.r for r in got] == ["Rp500", "Rp12.500", "Rp2.500.000", "Rp3.250.000.000"]
    assert [r.c for r in got] == ["Rp500", "Rp12.500", "Rp2.5M", "Rp3.3B"]
    assert [len(r.s) for r in got] == [500, 500, 1, 1] and got[1].s.endswith("b...")
    assert [r.j for r in got] == ['{"a": {"b": 1}}', None, "{}", None]


def test_composite_score(spark):
    df = spark.createDataFrame(
        [(1.0, "HIGH", "critical", "easy"), (0.0, "low", "low", "complex"), (0.5, "odd", None, "odd")],
        "confidence double, impact string, urgency string, effort string",
    )
    args = [F.col(c) for c in df.columns]
    got = [r[0] for r in df.select(composite_score(*args)).collect()]
    assert got == pytest.approx([1.0, 0.1 + 0.0625 + 0.05, 0.15 + 0.2 + 0.125 + 0.1])
    only = [r[0] for r in df.select(composite_score(*args, {"impact": 0, "urgency": 0, "effort": 0, "confidence": 1})).collect()]
    assert only == pytest.approx([1.0, 0.0, 0.5])


def test_exact_quantiles_of_keys_larger_than_the_sketch(spark):
    n = 60_000
    df = spark.range(n, numPartitions=6).selectExpr("id % 2 as k", "cast((id * 7919) % 60013 as double) / 7 as v")
    probs = {"low": 0.001, "median": 0.5, "p99": 0.99, "top": 1.0}
    values = df.toPandas()
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for key, group in values.groupby("k"):
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(group["v"], p * 100), rel=1e-12)
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(values["v"].median())
    cut = values_from_top(df, "v", {"high": 0.2})
    assert cut["high"] == sorted(values["v"], reverse=True)[int(n * 0.2)]
