"""Intermediate tables in the folder that driver and executors share.

A table written there cuts lineage and outlives a lost executor.  The folder is
the session's ``spark.checkpoint.dir``; only where that is unset (tests, a single
machine) a folder of this process is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"/tmp/checkpoints/keelson-{os.getpid()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder, in its partitions, and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/keelson/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OPEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._keelson_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that no later plan reads."""
    path = getattr(df, "_keelson_path", None)
    if path in _OPEN:
        _delete(path, _OPEN.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_OPEN.items()):
        try:
            _delete(path, spark)
        except Exception:  # the session has ended before the process; a local folder can still go
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
