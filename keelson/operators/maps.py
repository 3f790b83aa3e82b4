"""Row-wise maps by a user's functions, in Arrow batches.

A function has a name and declares what it returns.  It takes one row as a dict and
gives a dict, or None to drop the row; or it takes a whole Arrow batch and gives its new
columns.  What raises doesn't end the job: the row goes on without results and with the
error's text in a column, or where that isn't wanted the job fails with the row named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

AT_ONCE = 1024  # rows given to a function together


@dataclass(frozen=True)
class MapFunction:
    name: str
    call: Callable
    returns: str  # DDL
    by_batch: bool


FUNCTIONS: dict[str, MapFunction] = {}


def map_function(returns: str, name: str | None = None, by_batch: bool = False) -> Callable[[Callable], Callable]:
    """Register a function under its name; ``returns`` are its columns as DDL.

    Of a batch function the result holds the columns in that order, each as long as the
    batch; a row whose columns are all null is dropped.
    """

    def kept(call: Callable) -> Callable:
        own = MapFunction(name or call.__name__, call, returns, by_batch)
        FUNCTIONS[own.name] = own
        return call

    return kept


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _by_row(batch: pa.RecordBatch, call: Callable, names: list[str]) -> list[tuple[int, list, str | None]]:
    """(row, values, error) of the rows that stay."""
    out = []
    for k, row in enumerate(batch.to_pylist()):
        try:
            got = call(row)
            if got is not None:
                out.append((k, [got.get(n) for n in names], None))
        except Exception as e:  # any error of the user's function is the row's
            out.append((k, [None] * len(names), _said(e)))
    return out


def _by_batch(batch: pa.RecordBatch, call: Callable, names: list[str], at: int = 0) -> list[tuple[int, list, str | None]]:
    """As :func:`_by_row`; a batch that raises is halved until the rows that do are alone."""
    if not batch.num_rows:
        return []
    try:
        columns = call(batch)
        columns = columns.columns if isinstance(columns, pa.RecordBatch) else columns
        if len(columns) != len(names) or any(len(c) != batch.num_rows for c in columns):
            raise ValueError(f"{len(names)} columns of {batch.num_rows} rows were declared")
        rows = zip(*(c.to_pylist() if isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c in columns), strict=True)
        return [(at + k, list(r), None) for k, r in enumerate(rows) if any(x is not None for x in r)]
    except Exception as e:  # any error of the user's function is the rows'
        if batch.num_rows == 1:
            return [(at, [None] * len(names), _said(e))]
        half = batch.num_rows // 2
        return _by_batch(batch.slice(0, half), call, names, at) + _by_batch(batch.slice(half), call, names, at + half)


def _map(batches: Iterator[pa.RecordBatch], own: MapFunction, names: list[str], schema: pa.Schema, error: str | None) -> Iterator[pa.RecordBatch]:
    run = _by_batch if own.by_batch else _by_row
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(at, AT_ONCE)
            found = run(some, own.call, names)
            if error is None and (bad := next((x for x in found if x[2]), None)):
                raise ValueError(f"{own.name} failed on {some.slice(bad[0], 1).to_pylist()[0]!r:.500}: {bad[2]}")
            stay = some.take(pa.array([k for k, _, _ in found], pa.int64()))
            kinds = {f.name: f.type for f in schema}
            made = {n: _column([v[j] for _, v, _ in found], kinds[n], own.name) for j, n in enumerate(names)}
            if error is not None:
                made[error] = pa.array([e for _, _, e in found], pa.string())
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else stay.column(f.name).cast(f.type) for f in schema], schema=schema)


def _column(values: list, kind: pa.DataType, name: str) -> pa.Array:
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
        raise TypeError(f"{name} returned what it didn't declare: {e}") from e


def map_rows(df: DataFrame, function: str | MapFunction, error: str | None = "error") -> DataFrame:
    """``df`` with the columns of a registered function added, or in place of those of the same names.

    Rows for which it gives None go.  A row for which it raises has nulls in these columns
    and the error's text in the column ``error``, null for all others; with ``error=None``
    the job fails instead.  Null values reach the function as None; an empty table gives
    no rows.
    """
    own = FUNCTIONS[function] if isinstance(function, str) else function
    returns = StructType.fromDDL(own.returns)
    new = {*returns.names, *([error] if error else [])}
    fields = [f for f in df.schema.fields if f.name not in new] + returns.fields
    schema = StructType(fields)
    if error:
        schema = schema.add(error, StringType())
    return df.mapInArrow(partial(_map, own=own, names=returns.names, schema=to_arrow_schema(schema), error=error), schema)


def map_chain(df: DataFrame, *functions: str, error: str = "error") -> DataFrame:
    """One function after the other; a row that failed in one keeps its error and isn't given to the next."""
    if not functions:
        return df
    out = map_rows(df, functions[0], error)
    for name in functions[1:]:
        own = FUNCTIONS[name]
        call = partial(_unless_failed, call=own.call, names=StructType.fromDDL(own.returns).names)
        if own.by_batch:
            raise ValueError("only functions of one row can be chained")
        out = map_rows(out.withColumnRenamed(error, "_failed"), MapFunction(name, call, own.returns, False), error)
        out = out.withColumn(error, F.coalesce("_failed", error)).drop("_failed")
    return out


def _unless_failed(row: dict, call: Callable, names: list[str]) -> dict | None:
    return {n: row.get(n) for n in names} if row.pop("_failed") is not None else call(row)

