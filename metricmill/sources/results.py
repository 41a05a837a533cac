"""Results kept by what was asked and what the data was: the plan, its bound values, and the files it reads.

A result lies in ``<root>/<plan>/<version>``: the plan is the digest of the optimised plan without the names that
differ from run to run, the version the digest of the source files' paths, sizes and times. A record in the plan's
folder names the folder of the complete result, so a result that was not finished is not found. When the files
have changed, the result is computed anew and the old one deleted.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from metricmill.session import shared_dir
from metricmill.sources.commits import files_system, put_new

# What makes a plan's text say too little: functions that are known by name only, and rows that are in no file.
OPAQUE = ("PythonUDF", "EvalPython", "InPandas", "InArrow", "ScalaUDF", "MapElements", "MapPartitions", "LogicalRDD", "LocalRelation", "StreamingRelation", "rand(", "randn(", "uuid(", "shuffle(")


def plan_digest(df: DataFrame) -> str | None:
    """A digest of the optimised plan, the same for the same question; None if its text does not say all."""
    spark = df.sparkSession
    width, length = (spark.conf.get(k, None) for k in ("spark.sql.debug.maxToStringFields", "spark.sql.maxMetadataStringLength"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        text = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    finally:
        for key, value in (("spark.sql.debug.maxToStringFields", width), ("spark.sql.maxMetadataStringLength", length)):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    if any(word in text for word in OPAQUE):
        return None
    # Names of columns and their types are not part of a canonical plan's text.
    return hashlib.sha256((text + df.schema.json() + spark.conf.get("spark.sql.session.timeZone")).encode()).hexdigest()


def data_version(df: DataFrame) -> str:
    """A digest of the files that the plan reads, with their sizes and times."""
    spark = df.sparkSession
    listed = []
    for name in sorted(df.inputFiles()):
        _, path, fs = files_system(spark, name)
        status = fs.getFileStatus(path)
        listed.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(listed).encode()).hexdigest()


def cached(df: DataFrame, root: str | None = None) -> DataFrame:
    """``df``, read from the kept result if there is one for the same question over the same files, else kept now.

    Rows come back without order. Questions with Python functions, random values or rows that are in no file are
    answered each time. ``root`` is a folder that every executor can reach, by default one in the shared folder.
    """
    spark = df.sparkSession
    plan = plan_digest(df)
    if plan is None or not df.inputFiles():
        return df
    folder = f"{root or os.path.join(shared_dir(spark), 'results')}/{plan}"
    version = data_version(df)
    held = _record(spark, folder, version)
    if held is None:
        made = f"result=r-{uuid.uuid4().hex}"
        df.write.parquet(f"{folder}/{made}")
        put_new(spark, folder, f"{version}.json", json.dumps({"result": made}))
        held = _record(spark, folder, version)  # another writer's, if it was first
        _sweep(spark, folder, version, held)
    return spark.read.schema(df.schema).parquet(f"{folder}/{held}")


def _record(spark: SparkSession, folder: str, version: str) -> str | None:
    _, path, fs = files_system(spark, f"{folder}/{version}.json")
    if not fs.exists(path):
        return None
    return spark.read.schema("result string").json(f"{folder}/{version}.json").first()[0]


def _sweep(spark: SparkSession, folder: str, version: str, held: str) -> None:
    """Delete the results of older data."""
    _, path, fs = files_system(spark, folder)
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name not in (held, f"{version}.json") and not name.startswith("."):
            fs.delete(status.getPath(), True)
