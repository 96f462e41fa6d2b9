"""Intermediate tables on the cluster's shared folder, owned by the application and dropped when it ends."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tableprep.functions.columns import PrepError

_owned: set[str] = set()
# Tables made in the running call of :func:`materialize_alone`.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``.

    In local mode, where driver and executors are one process, the warehouse folder stands in when the setting is
    unset; on a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise PrepError("Set spark.checkpoint.dir to a folder all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    folder = f"{base.rstrip('/')}/tableprep-{spark.sparkContext.applicationId}"
    if folder not in _owned:
        _owned.add(folder)
        atexit.register(_drop_quietly, spark, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this application wrote."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_quietly(spark: SparkSession, folder: str) -> None:
    try:
        drop_path(spark, folder)
    except Exception:  # the session ended first
        pass


def release(spark: SparkSession) -> None:
    """Drop all intermediate tables of the application; results that read them must have been stored."""
    for folder in [f for f in _owned if f.endswith(spark.sparkContext.applicationId)]:
        drop_path(spark, folder)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Drops the application's intermediate tables at the end of the block."""
    try:
        yield
    finally:
        release(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once and read it back: lineage is cut and its size is known to the planner."""
    path = scratch_path(df.sparkSession, label)
    if _made.get() is not None:
        _made.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Store what ``make`` returns and drop the tables and shuffles that it made on the way.

    Tables of other threads that ``make`` starts stay until the application ends.
    """
    outer = _made.set([])
    try:
        out = materialize(make(), label)
        *inner, last = _made.get()
    finally:
        _made.reset(outer)
    if _made.get() is not None:
        _made.get().append(last)
    for path in inner:
        drop_path(spark, path)
    free_shuffles(spark)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver's garbage collector has dropped their plans; this asks for it.

    Called after a large shuffle has been stored with :func:`materialize` and its plan is no longer referenced.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
