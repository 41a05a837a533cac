"""Series statistics, anomalies and forecasts over roll-ups of the event views."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricmill.functions.timeparts import in_period
from metricmill.operators import anomalies as an
from metricmill.operators import forecast as fc
from metricmill.operators import forest, series as se
from metricmill.operators.metrics import rollup_series
from metricmill.operators.smoothing import smoothing_forecast
from metricmill.plans.catalog import EVENTS_AS_OF, SALES_AS_OF, over, query, within
from metricmill.plans.metric_queries import DAILY_CHANNEL, channel_series
from metricmill.sources import star

HOURLY = f"""SELECT event_type AS series_key, date_trunc('hour', ts) AS ts, sum(value) AS value
             FROM events WHERE {within(30, EVENTS_AS_OF, 'events.ts')} GROUP BY 1, date_trunc('hour', events.ts)"""
DAILY_EVENTS = HOURLY.replace("'hour'", "'day'")
INDEXED = """SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 AS idx,
                    count(*) OVER (PARTITION BY series_key) AS n FROM s"""
STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
SEVERITY = """CASE WHEN score < 2 THEN 'low' WHEN score < 3 THEN 'medium' WHEN score < 4 THEN 'high'
              ELSE 'critical' END AS severity"""


def event_series(spark, root, grain="hourly"):
    events = star.table(spark, root, "events").withColumnRenamed("ts", "event_timestamp")
    recent = events.filter(in_period("event_timestamp", EVENTS_AS_OF, 30))
    return rollup_series(recent, ["event_type"], "value", grain, "sum")


def channel_sql(body: str, **ctes: str) -> str:
    return over(body, "sales_events", s=DAILY_CHANNEL, i=INDEXED, **ctes)


def hourly_sql(body: str, **ctes: str) -> str:
    return over(body, s=HOURLY, i=INDEXED, **ctes)


def anomaly_sql(table: str, method: str, expected: str, where: str, extra: str = "", level: str = SEVERITY) -> str:
    return f"""SELECT series_key, idx, {STAMP}, value, {expected} AS expected_value, deviation, score, {level},
                      '{method}' AS method {extra} FROM {table} WHERE {where}"""


def flat(rows, **context):
    """Context values as columns, since maps print differently in the two engines."""
    return rows.select("*", *[F.col("context")[k].alias(v) for k, v in context.items()]).drop("context")


@query(
    "channel_moving_average",
    channel_sql(
        f"""SELECT series_key, {STAMP}, moving_average FROM (SELECT *, avg(value) OVER (PARTITION BY series_key
                ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS moving_average FROM i) WHERE idx >= 6"""
    ),
)
def channel_moving_average(spark, root):
    return se.moving_average(channel_series(spark, root))


@query(
    "channel_growth_rate",
    channel_sql(
        """SELECT series_key, (last - prev) / prev * 100 AS growth_rate, 'period_over_period' AS method
           FROM (SELECT series_key, max(value) FILTER (idx = n - 1) AS last,
                        max(value) FILTER (idx = n - 8) AS prev FROM i GROUP BY 1)"""
    ),
)
def channel_growth_rate(spark, root):
    return se.growth_rate(channel_series(spark, root), periods=7)


@query(
    "channel_trend",
    channel_sql(
        """SELECT series_key, CASE WHEN abs(slope) < 0.01 * size THEN 'stable' WHEN slope > 0 THEN 'increasing'
                  ELSE 'decreasing' END AS trend, slope, r2 AS r_squared, least(abs(r2) * 100, 100) AS strength,
                  least(abs(r2) + 0.5, 1.0) AS confidence
           FROM (SELECT series_key, regr_slope(value, idx) AS slope, regr_r2(value, idx) AS r2,
                        avg(abs(value)) AS size FROM i GROUP BY 1)"""
    ),
)
def channel_trend(spark, root):
    return se.trend(channel_series(spark, root))


OUTLIERS = """SELECT series_key, count(*) FILTER (o) AS count, count(*) FILTER (o) / count(*) * 100 AS percentage,
                     min(idx) FILTER (o) AS first_index, max(idx) FILTER (o) AS last_index FROM m GROUP BY 1"""
QUARTILES = """SELECT *, quantile_cont(value, 0.25) OVER (PARTITION BY series_key) AS q1,
                      quantile_cont(value, 0.75) OVER (PARTITION BY series_key) AS q3 FROM i"""
MOMENTS = """SELECT *, avg(value) OVER (PARTITION BY series_key) AS mean,
                    stddev_pop(value) OVER (PARTITION BY series_key) AS sd FROM i"""


@query(
    "event_outliers_iqr",
    hourly_sql(
        OUTLIERS, q=QUARTILES,
        m="SELECT *, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS o FROM q",
    ),
)
def event_outliers_iqr(spark, root):
    return se.outlier_summary(event_series(spark, root), "iqr")


@query(
    "event_outliers_zscore",
    hourly_sql(OUTLIERS, q=MOMENTS, m="SELECT *, abs((value - mean) / sd) > 1.5 AS o FROM q"),
)
def event_outliers_zscore(spark, root):
    return se.outlier_summary(event_series(spark, root), "zscore")


# Two-sided t probability by its finite series in the angle atan(t / sqrt(df)).
T_TAIL = """SELECT series_key, greatest(0, 1 - CASE WHEN df % 2 = 1
                THEN 2 / pi() * (max(theta) + max(sin(theta)) * coalesce(sum(CASE WHEN j <= (df - 3) / 2 THEN
                       exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(theta), 2 * j + 1) END), 0))
                ELSE max(sin(theta)) * sum(CASE WHEN j <= (df - 2) / 2 THEN
                       exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(theta), 2 * j) END) END) AS p
            FROM (SELECT series_key, df, atan(abs(t) / sqrt(df)) AS theta, unnest(range(0, df // 2 + 1)) AS j
                  FROM stat) GROUP BY series_key, df"""


@query(
    "channel_baseline_comparison",
    channel_sql(
        """SELECT series_key, m1 AS current_average, m2 AS baseline_average, m1 - m2 AS absolute_change,
                  pc AS percent_change, t AS t_statistic, p AS p_value, p < 0.05 AS is_significant,
                  CASE WHEN p >= 0.05 THEN 'not statistically significant' ELSE
                    CASE WHEN abs(pc) < 5 THEN 'minimal' WHEN abs(pc) < 15 THEN 'moderate'
                         WHEN abs(pc) < 30 THEN 'significant' ELSE 'substantial' END
                    || CASE WHEN pc > 0 THEN ' increase' ELSE ' decrease' END END AS interpretation
           FROM stat JOIN tail USING (series_key)""",
        sides="""SELECT series_key, avg(value) FILTER (c) AS m1, avg(value) FILTER (NOT c) AS m2,
                        count(*) FILTER (c) AS n1, count(*) FILTER (NOT c) AS n2,
                        var_samp(value) FILTER (c) AS v1, var_samp(value) FILTER (NOT c) AS v2
                 FROM (SELECT *, ts >= TIMESTAMP '2001-05-04' AS c FROM i) GROUP BY 1""",
        stat="""SELECT *, (m1 - m2) / m2 * 100 AS pc, n1 + n2 - 2 AS df,
                       (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t
                FROM sides""",
        tail=T_TAIL,
    ),
)
def channel_baseline_comparison(spark, root):
    return se.compare_to_baseline(channel_series(spark, root), F.col("ts") >= F.lit("2001-05-04").cast("timestamp"))


def seasonal_sql(slot: str) -> str:
    return channel_sql(
        f"""SELECT series_key, CAST({slot} AS INTEGER) AS period, avg(value) AS average_value,
                   count(*) AS sample_count, max(m) AS overall_average, (avg(value) / max(m) - 1) * 100
                     AS seasonal_index
            FROM (SELECT *, avg(value) OVER (PARTITION BY series_key) AS m FROM i) WHERE n >= 14 GROUP BY 1, 2"""
    )


@query("channel_seasonality_weekly", seasonal_sql("isodow(ts)"))
def channel_seasonality_weekly(spark, root):
    return se.seasonal_index(channel_series(spark, root), "weekly")


@query("channel_seasonality_daily", seasonal_sql("day(ts)"))
def channel_seasonality_daily(spark, root):
    return se.seasonal_index(channel_series(spark, root), "daily")


@query("channel_seasonality_monthly", seasonal_sql("month(ts)"))
def channel_seasonality_monthly(spark, root):
    return se.seasonal_index(channel_series(spark, root), "monthly")


@query(
    "channel_revenue_quantity_correlation",
    over(
        """SELECT series_key, n, r AS correlation_coefficient, p AS p_value, p < 0.05 AS is_significant,
                  CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak'
                       WHEN abs(r) < 0.5 THEN 'moderate' WHEN abs(r) < 0.7 THEN 'strong' ELSE 'very strong' END
                    AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
           FROM stat JOIN tail USING (series_key)""",
        "sales_events",
        d=f"""SELECT channel AS series_key, event_timestamp AS ts, sum(revenue) AS x, sum(quantity) AS y
              FROM sales_events WHERE {within(365)} GROUP BY 1, 2""",
        stat="""SELECT *, n - 2 AS df, r * sqrt((n - 2) / (1 - r * r)) AS t FROM
                (SELECT series_key, count(*) AS n, corr(x, y) AS r FROM d GROUP BY 1)""",
        tail=T_TAIL,
    ),
)
def channel_revenue_quantity_correlation(spark, root):
    sales = star.sales_events(spark, root).filter(in_period("event_timestamp", SALES_AS_OF, 365))
    daily = sales.groupBy(F.col("channel").alias("series_key"), "event_timestamp").agg(
        F.sum("revenue").alias("x"), F.sum("quantity").alias("y")
    )
    return se.correlation(daily)


@query(
    "event_summary_stats",
    hourly_sql(
        """SELECT series_key, count(*) AS count, avg(value) AS mean, quantile_cont(value, 0.5) AS median,
                  NULL::DOUBLE AS mode, stddev_pop(value) AS std, var_pop(value) AS variance, min(value) AS min,
                  max(value) AS max, max(value) - min(value) AS range, quantile_cont(value, 0.25) AS q1,
                  quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
                  avg(pow(value - mean, 3)) / pow(var_pop(value), 1.5) AS skewness,
                  stddev_pop(value) / avg(value) AS coefficient_of_variation
           FROM m GROUP BY 1""",
        m=MOMENTS,
    ),
)
def event_summary_stats(spark, root):
    return se.summary_stats(event_series(spark, root))


@query(
    "channel_linear_projection",
    channel_sql(
        """SELECT series_key, step, b + a * (n - 1 + step) AS forecast,
                  b + a * (n - 1 + step) - 1.96 * sd AS lower_bound,
                  b + a * (n - 1 + step) + 1.96 * sd AS upper_bound, a AS trend_slope
           FROM (SELECT f.series_key, f.n, a, b, stddev_pop(value - (b + a * idx)) AS sd
                 FROM f JOIN i USING (series_key) GROUP BY 1, 2, 3, 4),
                (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS step)""",
        f="""SELECT series_key, count(*) AS n, regr_slope(value, idx) AS a, regr_intercept(value, idx) AS b
             FROM i GROUP BY 1""",
    ),
)
def channel_linear_projection(spark, root):
    return se.simple_forecast(channel_series(spark, root))


@query(
    "event_anomalies_zscore",
    hourly_sql(
        anomaly_sql("z", "z_score", "mean", "n >= 4 AND score > 2.5"), m=MOMENTS,
        z="SELECT *, value - mean AS deviation, abs((value - mean) / nullif(sd, 0)) AS score FROM m",
    ),
)
def event_anomalies_zscore(spark, root):
    return flat(an.z_score(event_series(spark, root)))


@query(
    "event_anomalies_iqr",
    hourly_sql(
        anomaly_sql(
            "z", "iqr", "edge", "n >= 4 AND w <> 0 AND (value < lower_bound OR value > upper_bound)",
            ", lower_bound, upper_bound",
        ),
        q=QUARTILES,
        b="SELECT *, q3 - q1 AS w, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM q",
        e="SELECT *, CASE WHEN value < lower_bound THEN q1 ELSE q3 END AS edge FROM b",
        z="SELECT *, value - edge AS deviation, abs(value - edge) / w AS score FROM e",
    ),
)
def event_anomalies_iqr(spark, root):
    rows = an.iqr(event_series(spark, root), threshold=1.5)
    return flat(rows, lower_bound="lower_bound", upper_bound="upper_bound")


@query(
    "event_anomalies_moving_window",
    hourly_sql(
        anomaly_sql("z", "moving_window", "mean", "n >= 4 AND idx >= 7 AND score > 2.5", ", mean AS window_mean"),
        m="""SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM i
             WINDOW w AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
        z="SELECT *, value - mean AS deviation, abs((value - mean) / nullif(sd, 0)) AS score FROM m",
    ),
)
def event_anomalies_moving_window(spark, root):
    return flat(an.moving_window(event_series(spark, root)), window_mean="window_mean")


def pattern_sql(name: str, slot: str) -> str:
    return hourly_sql(
        anomaly_sql("z", f"pattern_{name}", "mean", "n >= 14 AND k >= 3 AND score > 2.5", ", slot::DOUBLE AS pattern_key"),
        g=f"SELECT *, {slot} AS slot FROM i",
        m="""SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, count(*) OVER w AS k FROM g
             WINDOW w AS (PARTITION BY series_key, slot)""",
        z="SELECT *, value - mean AS deviation, abs((value - mean) / nullif(sd, 0)) AS score FROM m",
    )


@query("event_pattern_daily", pattern_sql("daily", "hour(ts)"))
def event_pattern_daily(spark, root):
    return flat(an.pattern(event_series(spark, root), "daily"), pattern_key="pattern_key")


@query("event_pattern_weekly", pattern_sql("weekly", "isodow(ts) - 1"))
def event_pattern_weekly(spark, root):
    return flat(an.pattern(event_series(spark, root), "weekly"), pattern_key="pattern_key")


@query("event_pattern_monthly", pattern_sql("monthly", "day(ts)"))
def event_pattern_monthly(spark, root):
    return flat(an.pattern(event_series(spark, root), "monthly"), pattern_key="pattern_key")


@query(
    "event_density_noise",
    hourly_sql(
        """SELECT series_key, idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value, 0.0::DOUBLE AS expected_value,
                  0.0::DOUBLE AS deviation, 1.0::DOUBLE AS score, 'medium' AS severity, 'dbscan' AS method
           FROM (SELECT *, max(core) OVER (PARTITION BY series_key ORDER BY value
                           RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS reached FROM c)
           WHERE n >= 4 AND reached = 0""",
        c="""SELECT *, CASE WHEN count(*) OVER (PARTITION BY series_key ORDER BY value
                            RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) >= 3 THEN 1 ELSE 0 END AS core FROM i""",
    ),
)
def event_density_noise(spark, root):
    return flat(an.density_noise(event_series(spark, root)))


CHANGES = """SELECT *, abs(after_mean - before_mean) / greatest(bs, sd) AS score,
                    after_mean - before_mean AS change_magnitude
             FROM (SELECT *, avg(value) OVER b AS before_mean, stddev_pop(value) OVER b AS bs,
                          avg(value) OVER a AS after_mean, stddev_pop(value) OVER a AS sd FROM i
                   WINDOW b AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
                          a AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
             WHERE idx >= 10 AND idx < n - 10 AND bs > 0 AND sd > 0"""


@query(
    "event_change_points",
    hourly_sql(
        f"""SELECT series_key, idx, {STAMP}, before_mean, after_mean, change_magnitude, score, {SEVERITY}
            FROM c WHERE score > 1.0""",
        c=CHANGES,
    ),
)
def event_change_points(spark, root):
    return an.change_points(event_series(spark, root), threshold=1.0)


@query(
    "event_anomaly_summary",
    hourly_sql(
        """SELECT 'severity' AS breakdown, severity AS label, count(*) AS anomalies, avg(score) AS average_score,
                  max(score) AS max_score FROM u GROUP BY 2
           UNION ALL SELECT 'method', method, count(*), avg(score), max(score) FROM u GROUP BY 2
           UNION ALL SELECT 'total', 'all', count(*), avg(score), max(score) FROM u""",
        m=MOMENTS,
        z="SELECT *, abs((value - mean) / nullif(sd, 0)) AS score FROM m",
        w="""SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM i
             WINDOW w AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
        x="SELECT *, abs((value - mean) / nullif(sd, 0)) AS score FROM w",
        u=f"""SELECT 'z_score' AS method, score, {SEVERITY} FROM z WHERE score > 2.5
              UNION ALL SELECT 'moving_window', score, {SEVERITY} FROM x WHERE idx >= 7 AND score > 2.5""",
    ),
)
def event_anomaly_summary(spark, root):
    rows = event_series(spark, root)
    return an.anomaly_summary(an.z_score(rows).unionByName(an.moving_window(rows)))


@query(
    "event_forest_extremes",
    hourly_sql(
        """SELECT series_key, max(value) AS highest, true AS few FROM i WHERE n >= 4 GROUP BY 1""",
    ),
)
def event_forest_extremes(spark, root):
    """The forest flags each series' highest value, and no more than its share of points."""
    series = event_series(spark, root)
    flagged = forest.isolation_forest(series, 0.1).groupBy("series_key").agg(F.max("value").alias("highest"), F.count("*").alias("flagged"))
    sizes = series.groupBy("series_key").agg(F.count("*").alias("n"))
    return flagged.join(sizes, "series_key").select("series_key", "highest", (F.col("flagged") <= F.ceil(F.col("n") * 0.1)).alias("few"))


@query("event_isolation_forest")
def event_isolation_forest(spark, root):
    return flat(forest.isolation_forest(event_series(spark, root)))


LINEAR = """SELECT f.series_key, CAST(step AS INTEGER) AS step, ts_last + (ts_last - ts_prev) * step AS due,
                   b + a * (n - 1 + step) AS forecast, sd, mae
            FROM (SELECT f.series_key, f.n, a, b, stddev_pop(value - (b + a * idx)) AS sd,
                         avg(abs(value - (b + a * idx))) AS mae, max(ts) AS ts_last,
                         max(ts) FILTER (idx = i.n - 2) AS ts_prev
                  FROM f JOIN i USING (series_key) GROUP BY 1, 2, 3, 4) f, (SELECT unnest(range(1, 8)) AS step)"""
FIT = """SELECT series_key, count(*) AS n, regr_slope(value, idx) AS a, regr_intercept(value, idx) AS b
         FROM i GROUP BY 1"""
FORECAST_ROW = """series_key, step, strftime(due, '%Y-%m-%d %H:%M:%S') AS ts, forecast,
                  forecast - 1.96 * sd AS lower_bound, forecast + 1.96 * sd AS upper_bound"""


@query(
    "channel_forecast_linear",
    channel_sql(
        f"SELECT {FORECAST_ROW}, 'linear_regression' AS method, mae, sd AS rmse FROM l", f=FIT, l=LINEAR,
    ),
)
def channel_forecast_linear(spark, root):
    return fc.forecast(channel_series(spark, root), 7, "linear")


@query(
    "channel_forecast_auto",
    over(
        f"SELECT {FORECAST_ROW}, 'linear_regression' AS method, mae, sd AS rmse FROM l WHERE n >= 50",
        "sales_events",
        s=DAILY_CHANNEL.replace(within(365), "true"), i=INDEXED, f=FIT,
        l=LINEAR.replace("SELECT f.series_key,", "SELECT f.series_key, n,", 1),
    ),
)
def channel_forecast_auto(spark, root):
    return fc.forecast(channel_series(spark, root, None), 7, "auto")


@query(
    "channel_forecast_methods",
    channel_sql(
        """SELECT series_key, n, t AS has_trend, CASE WHEN n >= 50 OR t THEN 'linear' ELSE 'exponential_smoothing'
                  END AS method
           FROM (SELECT series_key, count(*) AS n, max(value) > min(value) AND
                        abs(regr_slope(value, idx) * count(*)) > 0.1 * (max(value) - min(value)) AS t
                 FROM i GROUP BY 1)"""
    ),
)
def channel_forecast_methods(spark, root):
    return fc.select_method(channel_series(spark, root))


@query(
    "channel_forecast_moving_average",
    channel_sql(
        f"SELECT {FORECAST_ROW}, 'moving_average_' || w AS method, mae, rmse FROM l",
        r="SELECT *, least(7, n // 2) AS w FROM i",
        g="""SELECT *, value - ma AS gap FROM (SELECT *, CASE w
                WHEN 5 THEN avg(value) OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
                WHEN 6 THEN avg(value) OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
                ELSE avg(value) OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
                END AS ma FROM r) WHERE idx >= w - 1""",
        l="""SELECT series_key, CAST(step AS INTEGER) AS step, last + (last - prev) * step AS due, forecast, sd, mae,
                    rmse, w FROM (SELECT series_key, w, arg_max(ma, idx) AS forecast, stddev_pop(gap) AS sd,
                        avg(abs(gap)) AS mae, sqrt(avg(gap * gap)) AS rmse, max(ts) AS last,
                        max(ts) FILTER (idx = n - 2) AS prev FROM g GROUP BY 1, 2),
                    (SELECT unnest(range(1, 8)) AS step)""",
    ),
)
def channel_forecast_moving_average(spark, root):
    return fc.forecast(channel_series(spark, root), 7, "moving_average")


@query(
    "channel_forecast_seasonal",
    channel_sql(
        f"SELECT {FORECAST_ROW}, 'seasonal_linear' AS method, mae, rmse, mape FROM o",
        f=FIT,
        k="""SELECT series_key, isodow(ts) AS slot, avg(value) / max(m) AS factor
             FROM (SELECT *, avg(value) OVER (PARTITION BY series_key) AS m FROM i) GROUP BY 1, 2""",
        e="""SELECT series_key, stddev_pop(gap) AS sd, avg(abs(gap)) AS mae, sqrt(avg(gap * gap)) AS rmse,
                    avg(abs(gap / value)) * 100 AS mape, max(ts) AS last, max(ts) FILTER (idx = n - 2) AS prev
             FROM (SELECT i.*, value - (b + a * idx) * factor AS gap FROM i JOIN f USING (series_key)
                   JOIN k ON k.series_key = i.series_key AND slot = isodow(ts)) GROUP BY 1""",
        p="""SELECT e.*, a, b, f.n, CAST(step AS INTEGER) AS step, last + (last - prev) * step AS due
             FROM e JOIN f USING (series_key), (SELECT unnest(range(1, 8)) AS step)""",
        o="""SELECT p.*, (b + a * (n - 1 + step)) * coalesce(factor, 1) AS forecast
             FROM p LEFT JOIN k ON k.series_key = p.series_key AND slot = isodow(due)""",
    ),
)
def channel_forecast_seasonal(spark, root):
    return fc.seasonal_linear_forecast(channel_series(spark, root), 7)


SMOOTH = """SELECT series_key, -1::BIGINT AS idx, regr_intercept(value, idx) - regr_slope(value, idx) AS level,
                   regr_slope(value, idx) AS growth, NULL::DOUBLE AS e FROM i WHERE idx < 10 AND n >= 10 GROUP BY 1
            UNION ALL
            SELECT r.series_key, i.idx, ahead + 0.3 * (value - ahead), 0.9 * growth + 0.3 * 0.2 * (value - ahead), value - ahead
            FROM (SELECT *, level + 0.9 * growth AS ahead FROM r) r JOIN i ON i.series_key = r.series_key AND i.idx = r.idx + 1"""


@query(
    "channel_forecast_smoothing_given",
    channel_sql(
        """SELECT series_key, step::INTEGER AS step, level + growth * list_sum(list_transform(range(1, step + 1), lambda j: pow(0.9, j))) AS forecast,
                  mae, rmse FROM r JOIN (SELECT series_key, max(idx) AS idx, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse
                                         FROM r GROUP BY 1) USING (series_key, idx), (SELECT unnest(range(1, 8)) AS step)""",
        r=SMOOTH,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def channel_forecast_smoothing_given(spark, root):
    """The recursion at fixed parameters, replayed in SQL."""
    rows = smoothing_forecast(channel_series(spark, root), 7, parameters=(0.3, 0.2, 0.9))
    return rows.select("series_key", "step", "forecast", "mae", "rmse")


@query("channel_forecast_smoothing")
def channel_forecast_smoothing(spark, root):
    return fc.forecast(channel_series(spark, root), 7, "exponential_smoothing")


@query(
    "event_forecast_errors",
    hourly_sql(
        """SELECT series_key, idx AS step, value AS actual, fit AS forecast, value - fit AS deviation,
                  pe AS percent_error, CASE WHEN pe < 10 THEN 'low' WHEN pe < 25 THEN 'medium' WHEN pe < 50
                  THEN 'high' ELSE 'critical' END AS severity
           FROM (SELECT *, abs((value - fit) / fit) * 100 AS pe,
                        stddev_pop(abs(value - fit)) OVER (PARTITION BY series_key) AS sd FROM j)
           WHERE abs(value - fit) > 2 * sd""",
        f=FIT,
        j="SELECT i.*, b + a * idx AS fit FROM i JOIN f USING (series_key)",
    ),
)
def event_forecast_errors(spark, root):
    rows = se.with_line(event_series(spark, root)).withColumnRenamed("idx", "step")
    predicted = rows.select("series_key", "step", (F.col("value") - F.col("gap")).alias("forecast"))
    actual = rows.select("series_key", "step", F.col("value").alias("actual"))
    return fc.forecast_errors(fc.pair_by_step(actual, predicted))


@query(
    "revenue_forecast_totals",
    over(
        """SELECT series_key, sum(forecast) AS projected_total, sum(forecast - 1.96 * sd) AS projected_lower,
                  sum(forecast + 1.96 * sd) AS projected_upper, count(*) AS periods FROM l GROUP BY 1""",
        "revenue_events",
        s=f"""SELECT 'all' AS series_key, event_timestamp AS ts, avg(amount) AS value FROM revenue_events
              WHERE {within(90)} GROUP BY 1, 2""",
        i=INDEXED, f=FIT, l=LINEAR.replace("range(1, 8)", "range(1, 31)"),
    ),
)
def revenue_forecast_totals(spark, root):
    rows = fc.forecast_revenue(star.revenue_events(spark, root), "amount", SALES_AS_OF, periods=30)
    return fc.projected_totals(rows)
