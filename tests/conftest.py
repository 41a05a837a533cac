from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from metricmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows to a DataFrame; timestamp columns may be given as text."""

    def build(rows, schema: str):
        import re

        text = re.sub(r"\btimestamp\b(?=\s*(,|$))", "string", schema)
        names = [c for c, t in spark.createDataFrame([], schema).dtypes if t == "timestamp"]
        df = spark.createDataFrame(rows, text)
        for name in names:
            df = df.withColumn(name, df[name].cast("timestamp"))
        return df

    return build


@pytest.fixture
def series(frame):
    """Daily series from plain lists: series(a=[1, 2, 3])."""
    from datetime import datetime, timedelta

    def build(**values):
        start = datetime(2024, 1, 1)
        rows = [
            (key, str(start + timedelta(days=i)), float(v)) for key, vs in values.items() for i, v in enumerate(vs)
        ]
        return frame(rows, "series_key string, ts timestamp, value double")

    return build


@pytest.fixture
def rows():
    """Collected rows as dicts, by one key column."""

    def build(df, key):
        return {r[key]: r.asDict(recursive=True) for r in df.collect()}

    return build
