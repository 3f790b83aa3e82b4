"""Intermediate tables in the folder that driver and executors share.

A table there cuts lineage and outlives a lost executor.  The folder is the session's
``spark.checkpoint.dir``; only a local master without it gets one of its own.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def hadoop_path(spark: SparkSession, path: str):
    """The JVM's path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"/tmp/checkpoints/keelson-core-{os.getpid()}"
    path = f"{root.rstrip('/')}/keelson/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_all() -> None:
    for path, spark in _MADE.items():
        try:
            at, fs = hadoop_path(spark, path)
            fs.delete(at, True)
        except Exception:  # the session has ended before the process; a local folder can still go
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
