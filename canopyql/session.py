"""Session helpers: a tuned session for local runs and the folder that a cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "canopyql") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CANOPYQL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine's own only where the setting is absent and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="canopyql-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in files that every executor can read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths handed out by ``scratch`` and not yet released, by application and thread: queries of one session that run at once leave each other's alone.
_SCRATCH: dict[tuple[str, int], set[str]] = {}


def _own(spark: SparkSession) -> set[str]:
    return _SCRATCH.setdefault((spark.sparkContext.applicationId, threading.get_ident()), set())


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _own(spark).add(path)
    return path


def held(spark: SparkSession) -> set[str]:
    """The scratch paths that this thread has made in this application and that are still there."""
    return set(_own(spark))


def release(spark: SparkSession, paths: set[str]) -> None:
    """Deletes scratch paths that nothing reads any more."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = java(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _own(spark).discard(path)


def stage(df: DataFrame, what: str = "stage") -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read back: cheap to read in part."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
