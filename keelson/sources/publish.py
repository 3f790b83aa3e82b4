"""Folders that change in one step.

A new version is written beside the old one.  A journal that names both is put in place
before anything moves, and whoever finds it finishes what it says, so that after a crash
at any point the path holds the old version or the new one.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import hadoop_path


def _renamed(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"cannot move {a} to {b}")


def _journal(spark: SparkSession, path: str):
    return hadoop_path(spark, f"{path.rstrip('/')}.journal")


def recover(spark: SparkSession, path: str) -> None:
    """Finish a change of the folder that was begun and not ended."""
    journal, fs = _journal(spark, path)
    if fs.exists(journal):
        stream = fs.open(journal)
        says = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        for _, step in _steps(spark, path, says["new"], says["old"]):
            step()


def _steps(spark: SparkSession, path: str, new: str, old: str) -> list[tuple[str, Callable[[], None]]]:
    """The moves after the journal is in place; each may be repeated."""
    at, fs = hadoop_path(spark, path.rstrip("/"))
    fresh, aside = hadoop_path(spark, new)[0], hadoop_path(spark, old)[0]
    journal, _ = _journal(spark, path)

    def move_old() -> None:
        if fs.exists(fresh) and fs.exists(at) and not fs.exists(aside):
            _renamed(fs, at, aside)

    def move_new() -> None:
        if fs.exists(fresh):
            _renamed(fs, fresh, at)

    return [("move old", move_old), ("move new", move_new), ("drop journal", lambda: fs.delete(journal, False)), ("drop old", lambda: fs.delete(aside, True))]


def publish(spark: SparkSession, new: str, path: str, after: Callable[[str], None] = lambda step: None) -> None:
    """Put the whole folder ``new`` in the place of ``path``; ``after`` is told each step that is done."""
    journal, fs = _journal(spark, path)
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    draft, _ = hadoop_path(spark, f"{path.rstrip('/')}.journal-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"new": new, "old": old}).encode()))
    out.close()
    _renamed(fs, draft, journal)
    after("journal")
    for name, step in _steps(spark, path, new, old):
        step()
        after(name)


def new_version(path: str) -> str:
    """A path beside ``path`` for its next version."""
    return f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"


def replaced(spark: SparkSession, path: str, write: Callable[[str], None], after: Callable[[str], None] = lambda step: None) -> None:
    """Let ``write`` make the next version of ``path``; if it fails, nothing is left of it and ``path`` stays."""
    recover(spark, path)
    new = new_version(path)
    try:
        write(new)
    except BaseException:
        at, fs = hadoop_path(spark, new)
        fs.delete(at, True)
        raise
    after("written")
    publish(spark, new, path, after)


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict) -> str:
    """A key of the files under ``inputs`` (name, length, time of change) and of some parameters."""
    import hashlib

    digest = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode())
    for path in inputs:
        at, fs = hadoop_path(spark, path)
        files, own = fs.listFiles(at, True), []
        while files.hasNext():
            f = files.next()
            own.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        digest.update(json.dumps([path, sorted(own)]).encode())
    return digest.hexdigest()


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], inputs: list[str] = (), **parameters) -> DataFrame:
    """The table that ``compute`` gives for these input files and parameters, kept under ``path``.

    Each set of inputs and parameters has a folder of its own, named by its fingerprint
    and moved into place when it is whole: a write that failed is never read, and changed
    files or parameters are computed anew.
    """
    place = f"{path.rstrip('/')}/{fingerprint(spark, list(inputs), parameters)}"
    at, fs = hadoop_path(spark, place)
    if not fs.exists(at):
        draft = f"{path.rstrip('/')}/_draft-{uuid.uuid4().hex}"
        made, _ = hadoop_path(spark, draft)
        try:
            compute().write.parquet(draft)
            if not fs.exists(at):  # else another writer was first, with the same rows
                _renamed(fs, made, at)
        finally:
            fs.delete(made, True)
    return spark.read.parquet(place)


COPIED = "source string, destination string, n_bytes long, status string"


def _copies(batches, seal: str):
    """Copy each file under a temporary name and move it into place when it is whole."""
    import pyarrow as pa

    from .arrow_folder import file_system

    for batch in batches:
        rows = []
        for source, destination in zip(batch.column("source").to_pylist(), batch.column("destination").to_pylist(), strict=True):
            fs, a = file_system(source)
            to, b = file_system(destination)
            n, done = fs.get_file_info(a), to.get_file_info(b)
            if n.type.name != "File":
                rows.append((source, destination, None, "missing"))
            elif done.type.name == "File" and done.size == n.size:
                rows.append((source, destination, n.size, "there"))
            else:
                to.create_dir(b.rpartition("/")[0], recursive=True)
                draft = f"{b}.{seal}-{uuid.uuid4().hex}"
                with fs.open_input_stream(a) as given, to.open_output_stream(draft) as out:
                    while piece := given.read(1 << 20):
                        out.write(piece)
                to.move(draft, b)
                rows.append((source, destination, n.size, "copied"))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["source", "destination", "n_bytes", "status"])


def copy_files(manifest: DataFrame, record: str) -> DataFrame:
    """Copy the files of ``manifest(source, destination)`` in tasks, and keep what was done as a table at ``record``.

    ``(source, destination, n_bytes, status)``: ``copied``, ``there`` (of the same size
    from an earlier run), ``missing``, or ``conflict`` for a second source of one
    destination (the least is copied).  A file appears under its name when it is whole,
    so tasks and runs may be repeated; drafts that a killed task left go at the end.
    """
    from functools import partial

    spark = manifest.sparkSession
    seal = "draft-of-copy"
    first = manifest.groupBy("destination").agg(F.min("source").alias("source"), F.sort_array(F.collect_set("source")).alias("_all"))
    done = first.select("source", "destination").mapInArrow(partial(_copies, seal=seal), COPIED)
    late = first.select(F.explode(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0)))).alias("source"), "destination", F.lit(None).cast("long").alias("n_bytes"), F.lit("conflict").alias("status"))
    replaced(spark, record, lambda new: done.unionByName(late).write.parquet(new))
    out = spark.read.parquet(record)
    for r in out.select(F.regexp_extract("destination", r"^(.*)/[^/]*\z", 1).alias("folder")).distinct().toLocalIterator():
        at, fs = hadoop_path(spark, f"{r['folder']}/*.{seal}-*")
        for left in fs.globStatus(at) or []:
            fs.delete(left.getPath(), False)
    return out
