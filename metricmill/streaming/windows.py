"""Unusual values as they arrive: each key's last values are kept in the stream's state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from metricmill.operators.anomalies import THRESHOLD, WINDOW, anomaly_rows
from metricmill.operators.series import KEY

FOUND = f"{KEY} string, idx long, ts timestamp, value double, mean double, z double"


class LastValues(StatefulProcessor):
    """Keeps the last ``window`` values of a key; rows far from their mean come out.

    A timer at the key's last event plus ``idle`` milliseconds of event time drops the state of a key that
    has fallen silent; it then starts anew.
    """

    def __init__(self, window: int, threshold: float, idle: int):
        self.window, self.threshold, self.idle = window, threshold, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "held array<double>, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values("ts")
        held, seen = self.recent.get() if self.recent.exists() else ([], 0)
        before = [*held]
        values = batch["value"].to_numpy(float)
        path = np.array([*before, *values])
        found = []
        for i, value in enumerate(values):
            end = len(before) + i
            if end >= self.window:
                last = path[end - self.window: end]
                mean, spread = last.mean(), last.std()
                if spread > 0 and abs(value - mean) / spread > self.threshold:
                    found.append((key[0], seen + i, batch["ts"].iloc[i], value, mean, abs(value - mean) / spread))
        self.recent.update(([float(x) for x in path[-self.window:]], seen + len(values)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last_ms = int(batch["ts"].max().timestamp() * 1000)
        self.handle.registerTimer(max(last_ms + self.idle, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(found, columns=[KEY, "idx", "ts", "value", "mean", "z"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def moving_window_alerts(
    series: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, late: str = "1 hour", idle_seconds: int = 30 * 86400
) -> DataFrame:
    """The rows of ``anomalies.moving_window`` for a stream (series_key, ts, value), each as its value comes.

    Values of a key must arrive in order of time between micro-batches; within one they are ordered here. Values
    later than ``late`` behind the newest are dropped, keys without a value for ``idle_seconds`` forgotten; with
    neither of both the alerts are those of the batch operator. The state of a key is ``window`` numbers.
    Needs the RocksDB state store (``prepare_state``).
    """
    found = (
        series.select(KEY, "ts", F.col("value").cast("double").alias("value"))
        .withWatermark("ts", late)
        .groupBy(KEY)
        .transformWithStateInPandas(LastValues(window, threshold, idle_seconds * 1000), FOUND, "Append", "EventTime")
    )
    return anomaly_rows(
        found, "moving_window", F.col("mean"), F.col("value") - F.col("mean"), F.col("z"),
        window_size=F.lit(window), window_mean=F.col("mean"),
    )


def prepare_state(spark) -> None:
    """Keyed state with timers needs the state store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
