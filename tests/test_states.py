"""Commit logs, mergeable states, dated order lines, rank selection, backtests and regressions."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricmill.functions.quantiles import exact_quantiles, mode_of, values_from_top
from metricmill.operators import anomalies, backtest, forecast, metrics, operations, regression, states
from metricmill.operators import series as se
from metricmill.operators.metrics import column_summary
from metricmill.plans import load_catalog
from metricmill.sources import commits, dated, files, journal, results, star, tables

ROOT = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def events(spark):
    return spark.range(600).select(
        F.col("id").alias("n"),
        F.expr("timestamp'2024-01-01' + make_dt_interval(0, cast(id % 240 as int))").alias("event_timestamp"),
        (F.col("id") % 3).alias("k"),
    )


def numbers(df) -> list[int]:
    return sorted(r.n for r in df.collect())


# ---- commits ---------------------------------------------------------------------------------------------


def test_replay_replaces_all_days_of_a_batch(spark, events, tmp_path):
    path = str(tmp_path / "t")
    assert len(tables.write_events(events.filter("n < 300"), path, 1)) == 10
    tables.write_events(events.filter("n >= 300"), path, 2)
    days = tables.write_events(events.filter("n < 20"), path, 1)  # one day now, ten before
    assert len(days) == 10
    assert numbers(tables.read_events(spark, path)) == [*range(20), *range(300, 600)]
    held = {f.split("/")[0] for c in commits.log(spark, path) if c.live for f, _, _ in c.files}
    assert {d for d in os.listdir(path) if d.startswith("attempt=")} == held  # the old files are gone


def test_uncommitted_files_are_not_read_and_are_swept(spark, events, tmp_path):
    path = str(tmp_path / "t")
    tables.write_events(events.filter("n < 300"), path, 1)
    events.withColumn("event_date", F.to_date("event_timestamp")).withColumn("batch", F.lit("9")).write.partitionBy("event_date").parquet(f"{path}/attempt=a-lost")
    assert numbers(tables.read_events(spark, path)) == list(range(300))
    assert commits.vacuum(spark, path, 1) == 0 and commits.vacuum(spark, path, 0) == 1
    assert numbers(tables.read_events(spark, path)) == list(range(300))


def test_folded_batches_can_be_replaced(spark, events, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(4):
        tables.write_events(events.filter(F.col("n") % 4 == batch), path, batch)
    assert tables.fold(spark, path) == 4
    assert [c.kind for c in commits.log(spark, path) if c.live] == ["fold"]
    tables.write_events(events.filter("n = 2"), path, 2)
    want = sorted([*(i for i in range(600) if i % 4 != 2), 2])
    assert numbers(tables.read_events(spark, path)) == want
    tables.compact(spark, path, f"{path}-copy")
    assert numbers(tables.read_events(spark, f"{path}-copy")) == want
    assert tables.fold(spark, path) == 2 and numbers(tables.read_events(spark, path)) == want
    assert [c.kind for c in commits.log(spark, path) if c.live] == ["fold"]
    assert tables.fold(spark, path, small=1) == 0


def test_two_writers_take_different_numbers(spark, events, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.write_events(events.filter("n < 5"), path, 1)
    blind = commits.log(spark, path)
    tables.write_events(events.filter("n >= 595"), path, 2)
    real = commits.log
    monkeypatch.setattr(commits, "log", lambda s, p: blind)  # a writer that has not seen the second commit
    commits.write(events.filter("n = 100").withColumns({"event_date": F.to_date("event_timestamp"), "batch": F.lit("3")}), path, "batch", ["3"])
    monkeypatch.setattr(commits, "log", real)
    assert [c.seq for c in commits.log(spark, path)] == [1, 2, 3]
    assert numbers(tables.read_events(spark, path)) == [*range(5), 100, *range(595, 600)]


def test_events_without_time_and_empty_batches(spark, events, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        commits.read(spark, path)
    tables.write_events(events.limit(0), path, 1)
    assert tables.read_events(spark, path).count() == 0
    odd = events.filter("n < 3").withColumn("event_timestamp", F.lit(None).cast("timestamp"))
    assert tables.write_events(odd, path, 2) == [commits.NO_DAY]
    assert tables.read_events(spark, path).count() == 3
    assert tables.read_events(spark, path, "2024-01-11", 30).count() == 0
    tables.write_daily_metrics(spark, path, f"{path}-days", ["k"], {"total": "n"})
    assert [(r.event_date, r.k, r.total) for r in tables.read_daily_metrics(spark, f"{path}-days").orderBy("k").collect()] == [(None, 0, 0.0), (None, 1, 1.0), (None, 2, 2.0)]


def test_days_that_lost_their_events_leave_the_metrics(spark, events, tmp_path):
    path, gold = str(tmp_path / "t"), str(tmp_path / "g")
    tables.write_events(events, path, 1)
    tables.write_daily_metrics(spark, path, gold, [], {"total": "n"})
    assert tables.read_daily_metrics(spark, gold).count() == 10
    days = tables.write_events(events.filter("event_timestamp < '2024-01-04'"), path, 1)
    tables.write_daily_metrics(spark, path, gold, [], {"total": "n"}, days)
    assert sorted(str(r.event_date) for r in tables.read_daily_metrics(spark, gold).collect()) == ["2024-01-01", "2024-01-02", "2024-01-03"]


def test_a_period_lists_files_of_its_days_only(spark, events, tmp_path):
    path = str(tmp_path / "t")
    tables.write_events(events, path, 1)
    recent = tables.read_events(spark, path, "2024-01-11", 2)
    assert {f.split("event_date=")[1][:10] for f in recent.inputFiles()} == {"2024-01-09", "2024-01-10"}
    assert numbers(recent) == numbers(events.filter("event_timestamp >= '2024-01-09'"))


# ---- states ----------------------------------------------------------------------------------------------


@pytest.fixture
def measured(spark):
    draw = np.random.default_rng(4)
    rows = [
        (str(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=int(h))), [None, "a", "b"][k], None if x < 0.1 else float(1e6 + 100 * x))
        for h, k, x in zip(draw.integers(0, 24 * 40, 4000), draw.integers(0, 3, 4000), draw.random(4000))
    ]
    return spark.createDataFrame(rows, "t string, k string, v double").select(F.col("t").cast("timestamp").alias("event_timestamp"), "k", "v")


def alike(a: dict, b: dict) -> bool:
    return a.keys() == b.keys() and all(
        math.isclose(a[k], b[k], rel_tol=1e-9) if isinstance(a[k], float) and isinstance(b[k], float) else a[k] == b[k] for k in a
    )


@pytest.mark.parametrize("period", ["hourly", "daily", "weekly", "monthly"])
def test_trends_from_states_equal_trends_from_events(measured, rows, period):
    made = states.states_of(measured, {"v": "v"}, ["k"], "hourly")
    got = rows(states.trends(made, "v", period), "period")
    want = rows(metrics.trends(measured, "v", "2025-01-01", period, 400), "period")
    assert got.keys() == want.keys()
    for key in want:  # the deviation too, though values lie near a million
        assert alike(got[key], want[key])


def test_merged_states_are_states(measured, rows):
    made = states.states_of(measured, {"v": "v"}, ["k"], "hourly")
    days = states.merged(made, ["v"], {"slot": F.date_trunc("day", "slot"), "k": F.col("k")})
    by_key = rows(states.merged(days, ["v"], {"k": F.col("k")}), "k")
    want = rows(measured.groupBy("k").agg(
        F.count("*").alias("events"), F.count("v").alias("v_n"), F.sum("v").alias("v_sum"), F.min("v").alias("v_min"),
        F.max("v").alias("v_max"), (F.var_pop("v") * F.count("v")).alias("v_m2"),
    ), "k")
    assert None in by_key and by_key.keys() == want.keys()
    assert all(alike(by_key[k], want[k]) for k in want)
    one = states.merged(days, ["v"], {}).first()
    assert one.events == 4000 and one.v_m2 == pytest.approx(measured.agg(F.var_pop("v") * F.count("v")).first()[0], rel=1e-9)
    assert states.merged(days.limit(0), ["v"], {}).first().events == 0


def test_state_tables_replace_batches_and_leave_events_alone(spark, measured, tmp_path):
    path = str(tmp_path / "s")
    half = F.col("k") == "a"
    for batch, part in ((1, measured.filter(half)), (2, measured.filter(~half | F.col("k").isNull())), (1, measured.filter(half))):
        states.write_states(part, path, batch, {"v": "v"}, ["k"], "daily")
    read = states.read_states(spark, path, "2024-01-15", 7, "daily")
    got = states.trends(read, "v", "daily")
    assert all(f"{path}/attempt=" in f for f in got.inputFiles())  # no file of the events
    assert {f.split("event_date=")[1][:10] for f in got.inputFiles()} == {"2024-01-01"}  # of two months
    want = {r.period: r["count"] for r in metrics.trends(measured, "v", "2024-01-15", "daily", 7).collect()}
    assert {r.period: r["count"] for r in got.collect()} == want
    with pytest.raises(ValueError, match="slots"):
        states.read_states(spark, path, "2024-01-15 12:00:00", 7, "daily")


@pytest.mark.parametrize("scale", [1.0, -3.0, 1e-9, 1e12])
def test_bins_answer_ranks_within_their_ratio(spark, scale):
    draw = np.random.default_rng(2)
    values = [*np.exp(draw.normal(size=999)) * scale, 0.0]
    df = spark.createDataFrame([("2024-01-01 05:00:00", float(v)) for v in values], "t string, v double")
    df = df.select(F.col("t").cast("timestamp").alias("event_timestamp"), "v")
    odd = df.limit(3).withColumn("v", F.lit(float("inf"))).union(df.limit(2).withColumn("v", F.lit(None).cast("double")))
    bins = states.bins_of(df.union(odd), "v")
    got = states.quantiles(bins.union(bins), [], {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p100": 1.0}).first()  # every value twice
    ordered = sorted(values * 2)
    assert got.n == 2000
    for name, p in (("p0", 0), ("p10", 0.1), ("p50", 0.5), ("p100", 1)):
        assert got[name] == pytest.approx(ordered[math.floor(p * 1999)], rel=0.0101)


# ---- dated lines --------------------------------------------------------------------------------------------


def test_dated_lines_prune_periods_and_join_without_exchange(spark, tmp_path):
    orders, lines = star.table(spark, ROOT, "orders"), star.table(spark, ROOT, "lineitem")
    dated.write_order_lines(orders, lines, "dated_test", str(tmp_path / "d"), 4, "month")
    read = dated.order_lines(spark, "dated_test", "2001-08-02", 90, "month")
    plan = plan_of(read)
    assert "Exchange" not in plan and plan.count("PartitionFilters: [isnotnull(order_period") == 2
    months = {f.split("order_period=")[1][:7] for f in read.inputFiles()}
    whole = star.order_lines(spark, ROOT).filter("o_orderdate >= '2001-05-04' AND o_orderdate < '2001-08-02'")
    key = ["l_orderkey", "l_linenumber"]
    assert sorted(map(tuple, read.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))
    assert sorted(read.columns) == sorted(whole.columns) and months
    few = dated.order_lines(spark, "dated_test", "2001-08-02", 30, "month")
    assert "SortMergeJoin" in plan_of(few) or "ShuffledHashJoin" in plan_of(few)
    for name in ("dated_test_orders", "dated_test_lines"):
        spark.sql(f"DROP TABLE {name}")


def test_dated_buckets_follow_the_volume(spark, monkeypatch):
    load_catalog()
    from metricmill.plans import state_queries

    monkeypatch.setattr(dated, "PER_BUCKET", 500)
    lines = star.table(spark, ROOT, "lineitem")
    wanted = math.ceil(lines.count() / 500)
    assert wanted > 8 and dated.buckets_for(lines) == wanted and dated.buckets_for(lines.limit(0)) == 8
    read = state_queries.dated_lines(spark, ROOT, 90)
    assert plan_of(read).count(f"SelectedBucketsCount: {wanted} out of {wanted}") == 2 and "Exchange" not in plan_of(read)
    whole = star.order_lines(spark, ROOT).filter("o_orderdate >= '2001-05-04' AND o_orderdate < '2001-08-02'")
    assert sorted(map(str, read.select("l_orderkey", "l_linenumber").collect())) == sorted(map(str, whole.select("l_orderkey", "l_linenumber").collect()))


# ---- ranks ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [20_000, 50, 1])
def test_ranks_of_odd_values_and_null_keys(spark, monkeypatch, few):
    """However often brackets are narrowed, the result is numpy's."""
    from metricmill.functions import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "PARTS", 8)
    draw = np.random.default_rng(few)
    groups = {
        None: np.concatenate((draw.normal(size=300), [0.0] * 40, [-0.0])), "a": 1.7e9 + draw.integers(0, 10**6, 900),
        "b": np.array([3.0]), "c": np.full(500, -2.5), "d": np.array([5e-324, -1e308, 1e308, 1e308, -1e-300]), "e": np.arange(400.0),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p97": 0.97, "top": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(values, p * 100), rel=1e-12), (key, name)
    every = np.concatenate(list(groups.values()))
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median(every), rel=1e-12)
    assert exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).first().m is None
    assert exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
    assert values_from_top(df, "v", {"a": 0.1}) == {"a": sorted(every, reverse=True)[len(every) // 10]}


def test_infinite_values_have_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, float("inf"), float("-inf"), float("inf"))], "v double")
    got = values_from_top(df, "v", {"first": 0.0, "third": 0.5, "last": 0.9})
    assert got == {"first": float("inf"), "third": 2.0, "last": float("-inf")}


def test_modes(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("a", 1), (None, 5), ("b", None)], "k string, v long")
    assert {r.k: r.m for r in mode_of(df, ["k"], F.col("v"), "m").collect()} == {"a": 1, None: 5}


def test_column_summary_of_odd_frames(spark):
    df = spark.createDataFrame([(1, 2.0, "x", None), (3, None, "y", None), (5, float(10**9), "z", None)], "a int, b double, c string, d long")
    got = {r["column"]: r for r in column_summary(df).collect()}
    assert set(got) == {"a", "b", "d"}
    assert (got["a"].mean, got["a"]["std"], got["a"].median) == (3.0, 2.0, 3.0)
    assert got["b"].non_null == 2 and got["b"]["std"] == pytest.approx(np.std([2.0, 1e9], ddof=1))
    assert (got["d"].row_count, got["d"].non_null, got["d"].median, got["d"]["std"]) == (3, 0, None, None)
    empty = {r["column"]: r for r in column_summary(df.limit(0)).collect()}
    assert set(empty) == {"a", "b", "d"} and empty["a"].row_count == 0


def test_warehouses_without_an_id_can_be_bottlenecks(spark):
    rows = [(None, 100.0 + i % 5) for i in range(20)] + [(f"w{k}", 10.0 + i % 3) for k in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, "warehouse_id string, fulfillment_time_hours double").withColumn("event_timestamp", F.lit("2024-01-10").cast("timestamp"))
    got = operations.bottlenecks(df, "2024-01-11").collect()
    assert [(r.warehouse_id, r.order_count, r.median_time) for r in got] == [(None, 20, 102.0)]


def test_quartile_methods_have_no_percentile_window(series):
    data = series(a=[*range(30), 500], b=[1, 2, 3])
    for df in (anomalies.iqr(data), se.mark_outliers(data), se.summary_stats(data)):
        assert "percentile(" not in plan_of(df)
    assert [r.value for r in anomalies.iqr(data).collect()] == [500.0]


# ---- forecasts ------------------------------------------------------------------------------------------------


def test_backtest_against_plain_loops(series):
    draw = np.random.default_rng(8)
    data = {"a": list(draw.normal(size=25)), "b": [float(i) for i in range(14)], "short": [1.0] * 9}
    got = {(r.series_key, r.idx, r.step, r.method): (r.actual, r.forecast) for r in backtest.origins(series(**data), 9).collect()}
    want = {}
    for key, values in data.items():
        for o in range(9, len(values) - 1):
            seen = values[: o + 1]
            slope, base = np.polyfit(np.arange(o + 1), seen, 1)
            for h in range(1, 10):
                if o + h < len(values):
                    season = o + h - 7
                    while season > o:
                        season -= 7
                    for method, value in (
                        ("linear", base + slope * (o + h)), ("moving_average", np.mean(seen[-7:])), ("seasonal_naive", values[season]), ("last_value", seen[-1]),
                    ):
                        want[key, o, h, method] = (values[o + h], value)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    best = {r.series_key: r.method for r in backtest.best_methods(backtest.origins(series(**data))).collect()}
    assert best["b"] == "linear" and set(best) == {"a", "b"}
    with pytest.raises(ValueError, match="unknown"):
        backtest.origins(series(a=[1.0]), methods=["guess"])


def weekly(n, draw):
    """A rise that bends, with a week's shape and some noise."""
    day = np.arange(n)
    return 100 + 0.5 * day + np.maximum(day - n / 2, 0) * 1.5 + 20 * np.sin(2 * np.pi * day / 7) + 8 * np.cos(4 * np.pi * day / 7) + draw.normal(size=n)


def test_regression_solves_the_normal_equations(series):
    values = weekly(80, np.random.default_rng(1))
    df = series(a=list(values))
    row = regression.sums(df).first()
    days = np.array([19723 + i for i in range(80)], float)  # 2024-01-01 and on
    share = np.arange(80) / 80
    x = np.stack([np.ones(80), share, *(np.maximum(share - k / 3, 0) for k in (1, 2)),
                  *(w(days * 2 * np.pi * k / 7) for k in (1, 2, 3) for w in (np.sin, np.cos))])
    full = x @ x.T
    assert row.xx == pytest.approx(full[np.triu_indices(10)].tolist(), rel=1e-6, abs=1e-6)
    assert row.xy == pytest.approx((x @ values).tolist(), rel=1e-6, abs=1e-6)
    full[[2, 3], [2, 3]] += regression.RIDGE * 80
    beta, rmse = regression.solve(row.n, row.yy, np.array(row.xy), np.array(row.xx))
    assert beta == pytest.approx(np.linalg.solve(full, x @ values), rel=1e-4, abs=1e-4)
    assert rmse == pytest.approx(math.sqrt(np.mean((values - beta @ x) ** 2)), rel=1e-4)


def test_regression_beats_the_seasonal_line_on_later_days(series):
    draw = np.random.default_rng(3)
    whole = {f"s{i}": weekly(120, draw) for i in range(6)}
    known = series(**{k: list(v[:106]) for k, v in whole.items()})
    errors = {}
    for name, rows in (("regression", regression.seasonal_regression(known, 14)), ("line", forecast.seasonal_linear_forecast(known, 14))):
        errors[name] = np.mean([abs(r.forecast - whole[r.series_key][105 + r.step]) for r in rows.collect()])
    assert errors["regression"] < 0.6 * errors["line"]
    assert regression.seasonal_regression(series(a=[1.0] * 9)).count() == 0


def test_forecasts_of_every_length_read_the_series_once(series):
    df = series(long=[float(i) for i in range(60)], flat=[5.0, 5.1, 5.1, 5.0] * 4, short=[1.0, 2.0])
    got = {(r.series_key, r.method) for r in forecast.forecast(df).collect()}
    assert got == {("long", "linear_regression"), ("flat", "exponential_smoothing"), ("short", "too_short")}
    with pytest.raises(Exception, match="at least 10"):
        forecast.forecast(df, strict=True).collect()
    assert forecast.forecast(series(a=[1.0]).limit(0)).count() == 0


# ---- kept results ----------------------------------------------------------------------------------------------


def test_results_are_kept_by_plan_values_and_files(spark, tmp_path):
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(100).selectExpr("id", "id % 3 as k").write.parquet(source)

    def ask(limit, name="n"):
        rows = spark.read.parquet(source).filter(F.col("id") < limit).groupBy("k").agg(F.count("*").alias(name))
        return results.cached(rows, kept)

    def files_of(df):
        return {f.split("/result=")[0].split("/")[-1] if "/result=" in f else "source" for f in df.inputFiles()}

    first = ask(50)
    assert sorted(map(tuple, first.collect())) == [(0, 17), (1, 17), (2, 16)]
    assert set(first.inputFiles()) == set(ask(50).inputFiles())  # the same kept files
    assert files_of(ask(50)).isdisjoint(files_of(ask(40)) | files_of(ask(50, "m")) | {"source"})
    assert ask(50, "m").columns == ["k", "m"]
    old = set(ask(50).inputFiles())
    spark.range(100, 110).selectExpr("id - 100 as id", "id % 3 as k").write.mode("append").parquet(source)
    new = ask(50)
    assert sum(r.n for r in new.collect()) == 60 and old.isdisjoint(new.inputFiles())
    assert not any(os.path.exists(f.removeprefix("file:")) for f in old)  # the result of the old files is gone


def test_results_that_a_plan_does_not_tell_are_not_kept(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)
    rows = spark.read.parquet(source)
    for odd in (
        rows.withColumn("r", F.rand()), rows.mapInArrow(lambda x: x, rows.schema), spark.range(3).toDF("x"),
        rows.join(spark.createDataFrame([(1,)], "id long"), "id"), rows.withColumn("u", F.udf(lambda x: x, "long")("id")),
    ):
        assert results.cached(odd, str(tmp_path / "kept")) is odd
    assert not (tmp_path / "kept").exists()


def test_unfinished_results_are_not_found(spark, tmp_path):
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(10).write.parquet(source)
    rows = spark.read.parquet(source).filter("id > 3")
    spark.range(1).write.parquet(f"{kept}/{results.plan_digest(rows)}/result=r-lost")
    assert results.cached(rows, kept).count() == 6


def test_export_with_summary(spark, tmp_path):
    frames = {"a": spark.range(3).toDF("x"), "empty": spark.range(0).selectExpr("id", "id as y")}
    got = {r.name: (r.records, r["columns"], r.folder) for r in files.export_with_summary(frames, str(tmp_path)).collect()}
    assert got == {"a": (3, 1, "a"), "empty": (0, 2, "empty")}
    assert spark.read.json(str(tmp_path / "summary")).count() == 2
    with pytest.raises(ValueError):
        files.export_with_summary({}, str(tmp_path))


# ---- streams ----------------------------------------------------------------------------------------------------


def test_keyed_windows_equal_the_batch_and_forget_silent_keys(spark, tmp_path):
    from metricmill.streaming import ingest as live
    from metricmill.streaming import windows

    windows.prepare_state(spark)
    draw = np.random.default_rng(6)
    start = pd.Timestamp("2024-01-01")
    rows = [(k, str(start + pd.Timedelta(hours=i)), float(v)) for k in "ab" for i, v in enumerate(draw.standard_t(2, 120))]
    rows += [("quiet", str(start + pd.Timedelta(hours=i)), float(i % 2)) for i in range(8)] + [("quiet", str(start + pd.Timedelta(hours=110)), 50.0)]
    df = spark.createDataFrame(rows, "series_key string, t string, value double").select("series_key", F.col("t").cast("timestamp").alias("ts"), "value")
    for day in range(5):
        df.filter((F.col("ts") >= F.lit(str(start + pd.Timedelta(days=day)))) & (F.col("ts") < F.lit(str(start + pd.Timedelta(days=day + 1))))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(name, idle):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = windows.moving_window_alerts(stream, idle_seconds=idle)
        live.start_updates(found, str(tmp_path / name), str(tmp_path / f"{name}-check"), True, "append").awaitTermination()
        return {(r.series_key, r.idx, round(r.score, 9)) for r in spark.read.parquet(str(tmp_path / name)).collect()}

    batch = {(r.series_key, r.idx, round(r.score, 9)) for r in anomalies.moving_window(df).collect()}
    assert run("kept", 90 * 86400) == batch and any(k == "quiet" for k, *_ in batch)
    assert run("short", 24 * 3600) == {x for x in batch if x[0] != "quiet"}  # its state was dropped in between


# ---- journal -----------------------------------------------------------------------------------------------------


def test_merged_journals_equal_one_full_apply(spark, tmp_path):
    from metricmill.operators.recommend import apply_status_log

    draw = np.random.default_rng(7)
    rows = [
        (f"r{draw.integers(0, 60)}", str(draw.choice(["approved", "rejected", "done"])), [None, "", "good", "bad"][draw.integers(0, 4)],
         [None, 1.5, -2.0][draw.integers(0, 3)], f"2024-01-{draw.integers(1, 9):02d} 00:00:00")
        for _ in range(900)
    ] + [(None, "done", None, None, "2024-02-01 00:00:00")]
    log = spark.createDataFrame(rows, "recommendation_id string, status string, feedback string, actual_impact double, t string")
    log = log.withColumn("updated_at", F.col("t").cast("timestamp")).drop("t")
    recs = spark.createDataFrame([(f"r{i}", "new", "2023-12-01 00:00:00") for i in range(70)], "recommendation_id string, status string, t string")
    recs = recs.withColumn("updated_at", F.col("t").cast("timestamp")).drop("t")
    state = lambda df: {r.recommendation_id: (r.status, r.feedback, r.actual_impact, r.updated_at) for r in df.collect()}
    path = str(tmp_path / "j")
    part = F.pmod(F.xxhash64("updated_at", "status"), F.lit(3))
    for k in (1, 2, 0, 2):
        assert journal.merge(log.filter(part == k), path, 8) == list(range(8))
    assert state(journal.current(recs, path)) == state(apply_status_log(recs, log))
    assert journal.entries(spark, path).groupBy("recommendation_id").count().agg(F.max("count")).first()[0] <= 3
    before = state(journal.current(recs, path))
    one = spark.createDataFrame([("r5", "late", "x", 9.0, "2024-03-01 00:00:00")], "recommendation_id string, status string, feedback string, actual_impact double, t string")
    one = one.withColumn("updated_at", F.col("t").cast("timestamp")).drop("t")
    (touched,) = journal.merge(one, path, 8)
    assert {p.split("bucket=")[1].split("/")[0] for p, _, _ in commits.log(spark, path)[-1].files} == {str(touched)}
    assert state(journal.current(recs, path))["r5"][:3] == ("late", "x", 9.0)
    assert state(journal.current(recs, path, upto=4)) == before  # an older version
    assert "SortAggregate" not in plan_of(journal.deciding(log))
    assert journal.merge(log.limit(0), path, 8) == []


def test_journal_shuffles_changes_once(spark, tmp_path, monkeypatch):
    """One exchange decides a batch, and the write needs no other; a batch of one busy id gives the same entries."""
    from metricmill.operators.recommend import apply_status_log

    rows = spark.range(4000).select(
        F.when(F.col("id") < 2500, "busy").when(F.col("id") < 3998, F.concat(F.lit("r"), F.col("id") % 300)).alias("recommendation_id"),
        F.concat(F.lit("s"), F.col("id") % 7).alias("status"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("f"), F.col("id") % 5)).alias("feedback"),
        F.when(F.col("id") % 4 == 0, F.col("id") % 11 * 1.0).alias("actual_impact"),
        F.when(F.col("id") % 50 != 0, F.timestamp_seconds(1.7e9 + F.col("id") % 90)).alias("updated_at"),
    )
    plan = journal.deciding(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan_of(journal.deciding(rows)).count("Exchange") == 1
    found = {}
    for floor in (100_000, 10):
        monkeypatch.setattr(journal, "BUSY", floor)
        path = str(tmp_path / f"j{floor}")
        for k in (1, 0, 1):
            journal.merge(rows.filter(F.col("updated_at").isNull() | (F.second("updated_at") % 2 == k)), path, 8)
        found[floor] = sorted(map(str, journal.entries(spark, path).collect()))
        assert len({f for c in commits.log(spark, path) if c.live for f, _, _ in c.files}) <= 8 * journal.PARTS
    assert found[10] == found[100_000]
    recs = spark.createDataFrame([("busy",), ("r1",), ("r299",)], "recommendation_id string")
    of = lambda df: sorted(map(str, df.collect()))
    assert of(journal.current(recs, path)) == of(apply_status_log(recs, rows))


def test_feed_runs_what_is_behind_it_once(spark):
    load_catalog()
    from metricmill.plans.state_queries import feed

    rows = spark.range(90).select("id", (F.col("id") * 2).alias("twice"))
    arrived = feed(rows, F.when(F.col("id") != 5, F.col("id") % 3), ["id"])
    assert [sorted(r.id for r in arrived(k).collect()) for k in range(4)] == [[i for i in range(90) if i % 3 == k and i != 5] for k in range(4)]
    assert all("feed_batch=" in f for f in arrived(1).inputFiles()) and "Range" not in plan_of(arrived(1))


def test_state_feeds_are_joined_once(spark, monkeypatch):
    """The batches of a state table come from the landed feed; the join behind it is not run for each."""
    load_catalog()
    from metricmill.plans import state_queries

    given = []
    monkeypatch.setattr(states, "write_states", lambda events, path, batch, *_: given.append((batch, events)))
    state_queries.state_table(spark, ROOT, star.revenue_events, {"amount": "amount"})
    assert [b for b, _ in given] == [0, 1, 2, 1] and all("Join" not in plan_of(e) for _, e in given)
    whole = star.revenue_events(spark, ROOT)
    for batch, rows in given:
        want = whole.filter(F.col("customer_id") % 3 == batch).select("event_timestamp", "amount")
        assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
