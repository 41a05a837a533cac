"""Run registered queries on Spark and their SQL on DuckDB, and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def cell(value, digits: int = 9):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.{digits}g}")
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def close(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def compare(spark, con, root: str, run, sql: str | None) -> tuple[str, int]:
    df = run(spark, root)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return "rows only", len(got)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}", len(got)
    kinds = {c[0]: str(c[1]) for c in result.description}
    odd = [
        f"{n}:{t}~{kinds[n]}"
        for n, t in df.dtypes
        if (t in ("bigint", "int")) != (kinds[n] in ("BIGINT", "INTEGER", "HUGEINT"))
        or (t == "double") != (kinds[n] == "DOUBLE")
        or kinds[n] in ("HUGEINT",)
    ]
    if odd:
        return f"types differ: {odd}", len(got)
    want = rows_of(names, result.fetchall())
    if len(got) != len(want):
        return f"row counts differ: {len(got)} / {len(want)}", len(got)
    for a, b in zip(got, want):
        if not all(close(x, y) for x, y in zip(a, b)):
            return f"values differ:\n   {a}\n   {b}", len(got)
    return "ok", len(got)


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from metricmill.session import build_session

    root = os.environ.get("COMPARE_SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "6g",
                                                    "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            verdict, n = compare(spark, con, root, run, oracles.get(name))
        except Exception as error:  # report and go on to the next query
            verdict, n = f"FAILED {type(error).__name__}: {str(error)[:1500]}", -1
        print(f"{name:45s} {n:7d} rows {time.time() - start:6.2f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
