"""Where jobs cut lineage: a folder that the driver and every executor can reach."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local master may do without: it has one machine, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def job_root(spark: SparkSession) -> str:
    """Where this application writes."""
    return f"{shared_root(spark)}/tidemark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; a retried job never meets an older run's files."""
    return f"{job_root(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Delete all that this application wrote into the shared folder; nothing that was read from there may be used afterwards."""
    delete(spark, job_root(spark))


_SCRATCH: list[list[str]] = []  # tables of each open ``scratch``, innermost last


def delete(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern with asterisks; names only, nothing is read."""
    files, target = _file_system(spark, pattern)
    return [found.getPath().toString() for found in files.globStatus(target) or []]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end, but for kept ones; no result may still depend on the others.

    Shuffle files of plans that nothing refers to any more are dropped too: Spark does so when the driver collects garbage.
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete(spark, path)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result outlives lost executors and is computed once, whatever reads it afterwards. Inside a ``scratch`` it is deleted
    at its end unless ``keep`` is set.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
