"""Intermediate tables in storage that every executor reaches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_RUNS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where that is unset and the master is local a temporary folder is made, removed at
    exit; on a cluster executors would not reach it, so an unset folder is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        made = tempfile.mkdtemp(prefix="callatlas-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the driver's Python ends."""
    run = f"{shared_dir(spark)}/callatlas-{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        _RUNS.add(run)
        atexit.register(_delete, run)
    return f"{run}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more, as rounds of an iteration do."""
    for t in tables:
        _delete(t.scratch)


def _delete(path: str) -> None:
    gateway, context = SparkContext._gateway, SparkContext._active_spark_context
    if gateway is None:
        return
    try:
        at = gateway.jvm.org.apache.hadoop.fs.Path(path)
        conf = context._jsc.hadoopConfiguration() if context else gateway.jvm.org.apache.hadoop.conf.Configuration()
        at.getFileSystem(conf).delete(at, True)
    except OSError:  # the JVM has ended before Python: its files stay
        return
