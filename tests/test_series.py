import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metricmill.operators import anomalies as an
from metricmill.operators import forecast as fc
from metricmill.operators import forest, series as se
from metricmill.operators.smoothing import fit


def positions(df):
    return sorted((r.series_key, r.idx) for r in df.collect())


def test_moving_average_and_short_series(series):
    got = se.moving_average(series(long=range(9), short=[1, 2, 6]), 7).orderBy("series_key", "ts").collect()
    assert [(r.series_key, r.moving_average) for r in got] == [("long", 3), ("long", 4), ("long", 5), ("short", 3)]


def test_growth(series, rows):
    df = series(up=[10, 20, 40], zero=[0, 5], one=[5], short=[10, 15])
    got = rows(se.growth_rate(df), "series_key")
    assert {k: v["growth_rate"] for k, v in got.items()} == {"up": 100, "zero": 0, "one": 0, "short": 50}
    assert got["one"]["method"] == "insufficient_data"
    back = rows(se.growth_rate(df, periods=2), "series_key")
    assert back["up"]["growth_rate"] == 300 and back["short"]["method"] == "full_period"


def test_trend(series, rows):
    got = rows(se.trend(series(flat=[5] * 8, up=range(1, 9), down=range(8, 0, -1), two=[1, 9])), "series_key")
    assert [got[k]["trend"] for k in ("flat", "up", "down", "two")] == ["stable", "increasing", "decreasing", "unknown"]
    assert got["flat"]["r_squared"] == 0 and got["up"]["strength"] == pytest.approx(100)
    assert got["two"]["confidence"] == 0


def test_outliers(series, rows):
    df = series(spike=[1, 2, 3, 2, 1, 90], flat=[4] * 6, short=[1, 1, 90])
    for method in ("iqr", "zscore"):
        got = rows(se.outlier_summary(df, method), "series_key")
        assert {k: v["count"] for k, v in got.items()} == {"spike": 1, "flat": 0, "short": 0}
        assert got["spike"]["first_index"] == 5
    with pytest.raises(ValueError):
        se.mark_outliers(df, "other")


def test_baseline_comparison(series, rows):
    df = series(far=[1, 2, 3, 11, 12, 13], near=[1, 2, 3, 1, 2, 4], flat=[5, 5, 5, 5, 5, 5], step=[1, 1, 1, 2, 2, 2],
                none=[1, 2, 3])
    got = rows(se.compare_to_baseline(df, F.col("ts") >= F.lit("2024-01-04").cast("timestamp")), "series_key")
    assert "none" not in got
    assert got["far"]["t_statistic"] == pytest.approx(12.247448714)
    # With 4 degrees of freedom the tail is 1 - sin(a) (1 + cos(a)^2 / 2) at tan(a) = t / 2, and t^2 is 150.
    assert got["far"]["p_value"] == pytest.approx(1 - (150 / 154) ** 0.5 * (1 + 4 / 154 / 2), rel=1e-9)
    assert got["far"]["interpretation"] == "substantial increase"
    assert got["near"]["interpretation"] == "not statistically significant"
    assert got["flat"]["p_value"] is None and got["flat"]["is_significant"] is False
    assert got["step"]["p_value"] == 0 and got["step"]["is_significant"] is True


def test_p_values_agree_with_regression(spark, rows):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(5)
    x = rng.random(30)
    y = 0.4 * x + rng.random(30)
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)], "series_key string, x double, y double")
    model = LinearRegression(solver="normal", labelCol="y").fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(df))
    row = se.correlation(df).first()
    assert row.p_value == pytest.approx(model.summary.pValues[0], rel=1e-7)
    assert row.correlation_coefficient == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_correlation_edges(spark, rows):
    df = spark.createDataFrame(
        [("exact", 1.0, 2.0), ("exact", 2.0, 4.0), ("exact", 3.0, 6.0), ("two", 1.0, 2.0), ("two", 2.0, 1.0),
         ("one", 1.0, 1.0)], "series_key string, x double, y double")
    got = rows(se.correlation(df), "series_key")
    assert set(got) == {"exact", "two"}
    assert got["exact"]["p_value"] == pytest.approx(0, abs=1e-7) and got["exact"]["strength"] == "very strong"
    assert got["two"]["p_value"] == 1 and got["two"]["direction"] == "negative"


def test_seasonal_index_needs_fourteen_points(series):
    df = series(a=[1, 2, 3, 4, 5, 6, 7] * 2, b=[1] * 13)
    got = se.seasonal_index(df, "weekly").orderBy("period").collect()
    assert {r.series_key for r in got} == {"a"} and [r.period for r in got] == list(range(1, 8))
    assert got[0].seasonal_index == pytest.approx((1 / 4 - 1) * 100)  # the series starts on a Monday
    with pytest.raises(ValueError):
        se.seasonal_index(df, "yearly")


def test_summary_stats_mode_and_zero_mean(series, rows):
    got = rows(se.summary_stats(series(a=[1, 1, 2, 2, 3], z=[-1, 1]), integers=True), "series_key")
    assert got["a"]["mode"] == 1 and got["a"]["median"] == 2 and got["a"]["iqr"] == 1
    assert got["z"]["coefficient_of_variation"] == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=4, max_size=25), st.integers(-9, 9), st.integers(1, 9))
def test_z_scores_ignore_shift_and_scale(spark, values, shift, scale):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    made = [("a", start + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    made += [("b", t, v * scale * 4 + shift) for _, t, v in made]
    got = an.z_score(spark.createDataFrame(made, "series_key string, ts timestamp, value double"), 1.3).collect()
    # A score within rounding of the threshold may fall either way.
    sides = {k: {r.idx for r in got if r.series_key == k and abs(r.score - 1.3) > 1e-9} for k in "ab"}
    assert sides["a"] == sides["b"]


def test_z_score_and_iqr_edges(series):
    df = series(spike=[1, 2, 1, 2, 1, 2, 1, 2, 1, 60], flat=[3] * 9, short=[1, 1, 99])
    assert positions(an.z_score(df)) == [("spike", 9)]
    row = an.iqr(df).first()
    assert (row.idx, row.expected_value, row.deviation) == (9, 2.0, 58.0) and row.severity == "critical"
    assert row.context["upper_bound"] == pytest.approx(4.5)
    assert an.iqr(series(flat=[3] * 9 + [9])).count() == 0


def test_moving_window_skips_flat_windows(series):
    df = series(flat=[5] * 7 + [50], noisy=[1, 2, 1, 2, 1, 2, 1, 9, 2], seven=[1, 2, 1, 2, 1, 2, 99])
    assert positions(an.moving_window(df)) == [("noisy", 7)]


def test_pattern_needs_three_per_slot(series):
    weekly = [1, 2, 3, 4, 5, 6, 7] * 8
    changed = weekly.copy()
    changed[21] = 100
    assert positions(an.pattern(series(a=changed, b=weekly), "weekly")) == [("a", 21)]
    assert an.pattern(series(a=[1] * 13), "weekly").count() == 0
    assert an.pattern(series(a=[1] * 13 + [90]), "weekly").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_density_noise_against_brute_force(series, seed):
    values = np.round(np.random.default_rng(seed).random(60) * 12, 3)
    near = np.abs(values[:, None] - values[None, :]) <= 0.5
    core = near.sum(axis=1) >= 3
    noise = [i for i in range(60) if not (near[i] & core).any()]
    assert positions(an.density_noise(series(a=values))) == [("a", i) for i in noise]


def test_change_points_against_brute_force(series):
    values = list(np.random.default_rng(4).random(15)) + list(np.random.default_rng(5).random(15) + 6)
    expected = []
    for i in range(10, 20):
        before, after = np.array(values[i - 10 : i]), np.array(values[i : i + 10])
        if abs(after.mean() - before.mean()) / max(before.std(), after.std()) > 2.5:
            expected.append(("a", i))
    assert positions(an.change_points(series(a=values, short=values[:19], flat=[1] * 30))) == expected != []


def test_forest_finds_far_points_and_repeats(series):
    values = np.concatenate([np.random.default_rng(1).normal(0, 1, 300), [40, -35]])
    df = series(a=values, b=values * 2 + 5)
    first = forest.isolation_forest(df)
    got = positions(first)
    assert {("a", 300), ("a", 301), ("b", 300), ("b", 301)} <= set(got)
    assert 0 < len([k for k, _ in got if k == "a"]) <= 31
    assert got == positions(forest.isolation_forest(df.repartition(3)))
    scores = [r.score for r in first.collect()]
    assert 0 < min(scores) <= max(scores) < 1


def test_tree_steps_follow_the_splits():
    starts, depths = forest.grow_tree(np.array([1.0, 2.0, 3.0, 100.0]), seed=1)
    assert starts[0] == -np.inf and starts == sorted(starts) and len(starts) == len(depths)
    assert forest.grow_tree(np.array([5.0] * 9), seed=1) == ([-np.inf], [forest.usual_depth(9)])


def test_forecast_needs_ten_points(series):
    df = series(nine=range(9), ten=range(10))
    got = fc.forecast(df, 3, "linear").collect()
    short = [r for r in got if r.series_key == "nine"]
    assert [(r.method, r.forecast, r.mae) for r in short] == [("too_short", None, None)] * 3
    got = [r for r in got if r.series_key == "ten"]
    assert sorted(r.forecast for r in got) == pytest.approx([10, 11, 12])
    assert [str(r.ts.date()) for r in sorted(got, key=lambda r: r.step)] == ["2024-01-11", "2024-01-12", "2024-01-13"]
    with pytest.raises(Exception, match="at least 10"):
        fc.forecast(df, 3, "linear", strict=True).collect()


def test_method_choice(series, rows):
    noise = [5, 6, 5, 6, 6, 5, 5, 6, 6, 5, 5, 6]
    got = rows(fc.select_method(series(long=[1] * 50, rising=range(12), flat=[3] * 12, noise=noise[:12])), "series_key")
    assert {k: v["method"] for k, v in got.items()} == {
        "long": "linear", "rising": "linear", "flat": "exponential_smoothing",
        "noise": "linear" if abs(np.polyfit(range(12), noise, 1)[0] * 12) > 0.1 else "exponential_smoothing",
    }


def test_auto_forecast_uses_each_method(series):
    df = series(rising=range(12), flat=[3] * 12)
    got = fc.forecast(df, 2).collect()
    assert {(r.series_key, r.method) for r in got} == {("rising", "linear_regression"), ("flat", "exponential_smoothing")}
    assert [r.forecast for r in got if r.series_key == "flat"] == pytest.approx([3, 3], abs=1e-6)


def test_moving_average_forecast_window(series, rows):
    got = fc.forecast(series(a=range(10), b=range(13), c=range(20)), 1, "moving_average").collect()
    assert {r.series_key: (r.method, r.forecast) for r in got} == {
        "a": ("moving_average_5", 7), "b": ("moving_average_6", 9.5), "c": ("moving_average_7", 16),
    }
    assert all(r.lower_bound == r.upper_bound == r.forecast for r in got)


def test_seasonal_forecast_follows_the_week(series):
    week = [10, 20, 30, 40, 50, 60, 70]
    got = fc.seasonal_linear_forecast(series(a=week * 6), 7).orderBy("step").collect()
    values = [r.forecast for r in got]
    assert values == sorted(values) and values[-1] > 4 * values[0] and got[0].mape < 40


def test_smoothing_beats_the_last_value():
    t = np.arange(60)
    y = 50 + 0.5 * t + np.random.default_rng(8).normal(0, 3, 60)
    sse, params, errors, _, _ = fit(y)
    assert sse == pytest.approx((errors**2).sum()) and sse < (np.diff(y) ** 2).sum()
    assert all(0 < p < 1 for p in params)


def test_forecast_errors_and_mismatch(spark):
    pairs = [("a", i, 10.0, 10.0 + (i % 2)) for i in range(12)] + [("a", 12, 100.0, 0.0), ("a", 13, 100.0, 50.0)]
    df = spark.createDataFrame(pairs, "series_key string, step int, actual double, forecast double")
    got = {r.step: r for r in fc.forecast_errors(df).collect()}
    errors = np.array([abs(a - f) for _, _, a, f in pairs])
    assert set(got) == {i for i, e in enumerate(errors) if e > 2 * errors.std()} == {12}
    assert got[12].percent_error == 0 and got[12].severity == "low"
    whole, part = df.select("series_key", "step", "actual"), df.select("series_key", "step", "forecast").limit(5)
    with pytest.raises(Exception, match="same length"):
        fc.pair_by_step(whole, part).collect()


def test_anomaly_summary(series, rows):
    got = rows(an.anomaly_summary(an.z_score(series(a=[1, 2, 1, 2, 1, 2, 1, 2, 1, 60]))), "label")
    score = (60 - 7.3) / np.std([1, 2, 1, 2, 1, 2, 1, 2, 1, 60])
    assert {k: v["anomalies"] for k, v in got.items()} == {"medium": 1, "z_score": 1, "all": 1}
    assert got["all"]["max_score"] == got["all"]["average_score"] == pytest.approx(score)
