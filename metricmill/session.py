"""Session set-up and the shared staging folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. Partition counts are left to AQE: start
# wide, let it coalesce small shuffles and split skewed join partitions.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "metricmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """A borrowed session with the runtime settings of ``SQL_SETTINGS``."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.isModifiable(key) and spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Timestamps are read and compared in UTC; make a borrowed session agree."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named in ``spark.checkpoint.dir``.

    Only a local session without the setting falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="metricmill-")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder for one run's output."""
    base = shared_dir(spark)
    path = os.path.join(base, f"{label}-{spark.sparkContext.applicationId}-{os.urandom(6).hex()}")
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context).deleteOnExit(folder)  # gone when the driver ends
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate that several later steps read to the shared folder.

    Reliable checkpoint, so a lost executor costs a re-read and not the upstream
    scan and join. Used for reduced frames, and by the text operators for narrow rows of one each per input row;
    whole fact rows are not staged.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
