"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the operators rely on; all of them can be changed at run time.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot invoice or seller is split even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming sessions are merged before their shuffle; the session tracker needs timers and map state.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Larger generated methods are not compiled by the JVM and would be interpreted; beyond it expressions are split into small ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Exchanged rows are small and the work on each of them (patterns, XML) is not: smaller parts keep all cores busy.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    # A small file is read quickly: with the default of 4 MB for opening one, a task would read a few dozen documents.
    "spark.sql.files.openCostInBytes": "64k",
    # Arrow batches may hold whole texts: bounded by bytes, so that a batch of long ones still fits a worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(app_name: str = "faktorium", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or a test folder when unset."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="faktorium-")
    context.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession) -> str:
    """The folder below the shared one that holds all intermediate tables of this application."""
    return f"{shared_folder(spark).rstrip('/')}/faktorium/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for one written intermediate table."""
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> bool:
    """Remove the intermediate tables of this application, once their results are written; false if there were none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The exchanges of a table written inside are removed once it is there, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
