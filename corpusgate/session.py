"""Session defaults and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "corpusgate", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume; `conf` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: `spark.checkpoint.dir`.

    Only a local master, where driver and executors are one process, falls back to a
    temporary folder, deleted when the process ends; a cluster without the setting is an
    error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = os.environ.get("CORPUSGATE_LOCAL_DIR")
    if not fallback:
        fallback = os.environ["CORPUSGATE_LOCAL_DIR"] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, fallback, ignore_errors=True)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/corpusgate-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage with a table written to the shared folder.

    A Parquet table instead of an RDD checkpoint: later steps read only the columns they
    need, joins see real file sizes, and a lost executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def make_folder(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.mkdirs(at)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())


def sweep(spark: SparkSession, keep_hours: float = 24.0) -> list[str]:
    """Remove scratch tables of ended jobs from the shared folder; gives their names."""
    fs, at = _folder(spark, shared_dir(spark))
    now, gone = spark._jvm.java.lang.System.currentTimeMillis(), []
    for s in fs.listStatus(at) if fs.exists(at) else []:
        name = s.getPath().getName()
        if name.startswith("corpusgate-") and now - s.getModificationTime() >= keep_hours * 3.6e6:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)
