"""One call for all anomaly methods."""

from __future__ import annotations

from pyspark.sql import DataFrame

from metricmill.operators import anomalies
from metricmill.operators.forest import isolation_forest


def detect(series: DataFrame, method: str = "z_score", threshold: float = anomalies.THRESHOLD) -> DataFrame:
    """Unusual points of every series of at least four points; an unknown method means z-scores."""
    if method == "iqr":
        return anomalies.iqr(series, threshold)
    if method == "isolation_forest":
        return isolation_forest(series)
    if method == "moving_average":
        return anomalies.moving_window(series, threshold=threshold)
    return anomalies.z_score(series, threshold)
