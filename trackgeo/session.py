"""Session helpers: a local session for tests, and durable cut points for long plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", app: str = "trackgeo", **conf: str) -> SparkSession:
    """Session for tests and the bench. On a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in `spark.checkpoint.dir`; a private one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trackgeo-ckpt-"))
    return sc.getCheckpointDir()


_RUNS: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A fresh path in the folder of the innermost open run, else in the shared folder."""
    return f"{_RUNS[-1] if _RUNS else checkpoint_dir(spark)}/{fresh_name()}"


def fresh_name() -> str:
    return uuid.uuid4().hex


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table that this library wrote, in whatever store it lies."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """One folder for all cut points written inside; removed at the end.

    Results that read these tables must be written or collected before the run ends.
    """
    path = open_run(spark)
    try:
        yield path
    finally:
        close_run(spark, path)


def open_run(spark: SparkSession) -> str:
    """From here on cut points go into a folder of their own, until `close_run`."""
    _RUNS.append(new_path(spark))
    return _RUNS[-1]


def close_run(spark: SparkSession, path: str) -> None:
    """Remove the folder that `open_run` gave."""
    _RUNS.remove(path)
    delete_path(spark, path)


def durable(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read on from there.

    Freezes values that a recomputed task could change (partition numbers), cuts lineage, survives
    lost executors, and gives the planner real sizes (a checkpointed plan keeps the estimates of
    the plan it replaces, which multiply over joins).
    """
    path = new_path(df.sparkSession)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str) -> None:
    """Write `df` as Parquet. What its plan shuffled leaves the disk as soon as the table is written, not when the driver
    happens to collect its garbage: with a large heap that can be never, and all shuffles of a run would add up."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)
