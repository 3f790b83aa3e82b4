"""Saved datasets of Arrow files: a folder with stream files and a JSON state that names them.

Several splits are folders under one with a JSON list of their names.  Reading plans a
partition for each file and streams it batch by batch; writing gives each task a file of
its own, and the state that names the files is put in place last.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from ..scratch import hadoop_path
from .publish import recover, replaced

# --- Fixed values: names of files and fields in a saved dataset. ---
STATE, INFO, SPLITS = "state.json", "dataset_info.json", "dataset_dict.json"
FILES, FILE, INDICES = "_data_files", "filename", "_indices_data_files"
# --- End of fixed values. ---


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path there."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def _plain(kind: pa.DataType) -> pa.DataType:
    """The type that holds the same values in Spark."""
    if pa.types.is_dictionary(kind):
        return _plain(kind.value_type)
    if pa.types.is_large_string(kind) or pa.types.is_string_view(kind):
        return pa.string()
    if pa.types.is_large_binary(kind) or pa.types.is_fixed_size_binary(kind):
        return pa.binary()
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(_plain(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _plain(f.type), f.nullable) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(_plain(kind.key_type), _plain(kind.item_type))
    if pa.types.is_unsigned_integer(kind):
        return {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[kind.bit_width]
    if pa.types.is_float16(kind):
        return pa.float32()
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    return kind


def _read_json(path: str) -> dict | None:
    fs, at = file_system(path)
    if fs.get_file_info(at).type.name != "File":
        return None
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())


def _write_json(path: str, value: dict) -> None:
    fs, at = file_system(path)
    draft = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(json.dumps(value, indent=2).encode())
    fs.move(draft, at)


def splits_of(path: str) -> list[str] | None:
    """Names of the splits, or None where the folder is one dataset."""
    found = _read_json(f"{path}/{SPLITS}")
    return None if found is None else list(found["splits"])


def files_of(path: str) -> list[str]:
    """The data files that a dataset's state names, in order."""
    state = _read_json(f"{path}/{STATE}")
    if state is None:
        raise FileNotFoundError(f"no dataset at {path}")
    if state.get(INDICES):
        raise ValueError(f"{path} selects rows by an index; flatten it when it is saved")
    return [f"{path}/{x[FILE]}" for x in state[FILES]]


@dataclass
class _File(InputPartition):
    path: str
    split: str | None


class _Reader(DataSourceReader):
    def __init__(self, files: list[_File], schema: StructType):
        self._files, self._schema = files, schema

    def partitions(self) -> list[InputPartition]:
        return self._files or [_File("", None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        target = to_arrow_schema(self._schema)
        fs, at = file_system(partition.path)
        with fs.open_input_stream(at) as f, pa.ipc.open_stream(f) as stream:
            for batch in stream:
                columns = [pa.array([partition.split] * batch.num_rows, field.type) if partition.split is not None and field.name == "split" else batch.column(field.name).cast(field.type) for field in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self._path, self._overwrite = path, overwrite
        self._schema = schema
        self._draft = f"{path}/_draft-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        batch = next(iterator, None)
        if batch is None:
            return _Written(None, 0)
        name, rows = f"{uuid.uuid4().hex}.arrow", 0
        fs, at = file_system(f"{self._draft}/{name}")
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(at) as out, pa.ipc.new_stream(out, batch.schema) as stream:
            while batch is not None:
                stream.write_batch(batch)
                rows += batch.num_rows
                batch = next(iterator, None)
        return _Written(name, rows)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        """Files of tasks whose message arrived get their names, and then the state names them; the old ones go last."""
        made = [m for m in messages if m is not None and m.file]
        fs, root = file_system(self._path)
        fs.create_dir(root, recursive=True)
        before = _read_json(f"{self._path}/{STATE}")
        if before is not None and not self._overwrite:
            self.abort(messages)
            raise FileExistsError(f"there is a dataset at {self._path}")
        seal = uuid.uuid4().hex[:16]
        names = [f"data-{k:05d}-of-{len(made):05d}-{seal}.arrow" for k in range(len(made))]
        if not made:  # a file without rows keeps the columns
            names = [f"data-00000-of-00001-{seal}.arrow"]
            with fs.open_output_stream(f"{root}/{names[0]}") as out, pa.ipc.new_stream(out, to_arrow_schema(self._schema)):
                pass
        draft = file_system(self._draft)[1]
        for m, name in zip(made, names, strict=False):
            fs.move(f"{draft}/{m.file}", f"{root}/{name}")
        _write_json(f"{self._path}/{INFO}", {"num_rows": sum(m.rows for m in made)})
        _write_json(f"{self._path}/{STATE}", {FILES: [{FILE: n} for n in names], "_fingerprint": seal, "_format_columns": None, "_format_kwargs": {}, "_format_type": None, "_output_all_columns": False, "_split": None})
        for old in (before or {}).get(FILES, []):
            fs.delete_file(f"{root}/{old[FILE]}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        fs, draft = file_system(self._draft)
        if fs.get_file_info(draft).type.name == "Directory":
            fs.delete_dir(draft)


class ArrowFolder(DataSource):
    """Options: ``path``, and ``split`` for one split of several."""

    @classmethod
    def name(cls) -> str:
        return "arrow_folder"

    def _files(self) -> list[_File]:
        path, wanted = self.options["path"].rstrip("/"), self.options.get("split")
        names = splits_of(path)
        if names is None:
            return [_File(f, None) for f in files_of(path)]
        if wanted and wanted not in names:
            raise ValueError(f"no split {wanted}; there are {', '.join(names)}")
        return [_File(f, s) for s in names if wanted in (None, s) for f in files_of(f"{path}/{s}")]

    def schema(self) -> StructType:
        files = self._files()
        fs, at = file_system(files[0].path)
        with fs.open_input_stream(at) as f, pa.ipc.open_stream(f) as stream:
            own = pa.schema([pa.field(x.name, _plain(x.type), x.nullable) for x in stream.schema if files[0].split is None or x.name != "split"])
        out = from_arrow_schema(own)
        return out if files[0].split is None else out.add("split", "string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._files(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/"), schema, overwrite)


def _unpacked(batches: Iterator[pa.RecordBatch], schema: pa.Schema, splits: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Batches of files that come whole."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            split = splits.get("/".join(path.rsplit("/", 2)[1:]))
            with pa.ipc.open_stream(pa.BufferReader(content.as_buffer())) as stream:
                for own in stream:
                    columns = [pa.array([split] * own.num_rows, f.type) if split is not None and f.name == "split" else own.column(f.name).cast(f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _by_spark(spark: SparkSession, path: str, split: str | None) -> DataFrame:
    """As :func:`read_arrow`, where only Spark's own readers open the path: each file is one row, so it has to fit a task."""

    def said(name: str) -> dict | None:
        at, fs = hadoop_path(spark, f"{path}/{name}")
        return json.loads(spark.read.text(f"{path}/{name}", wholetext=True).first()[0]) if fs.exists(at) else None

    names = said(SPLITS)
    folders = [""] if names is None else [f"{n}/" for n in names["splits"] if split in (None, n)]
    states = {f: said(f + STATE) for f in folders}
    if not folders or None in states.values():
        raise FileNotFoundError(f"no dataset at {path}" + (f" with a split {split}" if split else ""))
    if any(s.get(INDICES) for s in states.values()):
        raise ValueError(f"{path} selects rows by an index; flatten it when it is saved")
    files = [(f"{path}/{f}{x[FILE]}", f.rstrip("/")) for f, s in states.items() for x in s[FILES]]
    whole = spark.read.format("binaryFile").load([f for f, _ in files]).select("path", "content")
    head = spark.read.format("binaryFile").load(files[0][0]).select(F.substring("content", 1, 16 << 20).alias("h")).first()["h"]
    own = pa.schema([pa.field(x.name, _plain(x.type), x.nullable) for x in pa.ipc.read_schema(pa.py_buffer(bytes(head))) if names is None or x.name != "split"])
    schema = from_arrow_schema(own) if names is None else from_arrow_schema(own).add("split", "string")
    of_file = {} if names is None else {"/".join(f.rsplit("/", 2)[1:]): s for f, s in files}
    return whole.mapInArrow(partial(_unpacked, schema=to_arrow_schema(schema), splits=of_file), schema)


def read_arrow(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A saved dataset of Arrow files; of several splits all with a column ``split``, or one of them."""
    recover(spark, path)
    try:
        file_system(path)
    except (pa.ArrowInvalid, OSError):  # a scheme that pyarrow doesn't know or can't open here
        return _by_spark(spark, path, split)
    spark.dataSource.register(ArrowFolder)
    reader = spark.read.format("arrow_folder")
    return (reader if split is None else reader.option("split", split)).load(path)


def save_arrow(df: DataFrame, path: str, split: str | None = None) -> None:
    """Save as a dataset of Arrow files, or with ``split`` as one of several: a folder for each value of that column.

    All of it appears in one step, whatever was there before; a failed task leaves what was there.
    """
    spark = df.sparkSession
    spark.dataSource.register(ArrowFolder)

    def write(new: str) -> None:
        if split is None:
            df.write.format("arrow_folder").mode("append").save(new)
            return
        names = sorted(r[0] for r in df.select(split).distinct().collect())  # splits are few
        if bad := [n for n in names if not re.fullmatch(r"[\w.-]+", n)]:
            raise ValueError(f"not names of splits: {bad[:3]}")
        for n in names:
            df.where(F.col(split) == n).drop(split).write.format("arrow_folder").mode("append").save(f"{new}/{n}")
        _write_json(f"{new}/{SPLITS}", {"splits": names})

    replaced(spark, path, write)
