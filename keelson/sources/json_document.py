"""One JSON document read by many tasks.

Spark's text reader cuts the file into byte ranges and, with ``}`` for a line end, hands
each task the fragments that begin in its range.  What a range begins with isn't known
beforehand, so a first pass sums each range up for both cases, inside a string and
outside: whether a string is open at its end, and how the depth of brackets changes.  The
sums of the ranges before it give each range its start.  The second pass then cuts out
the objects at a given depth.  What runs over the end of a range comes in parts, which are
put together by the range that they begin in; so does a key.

Brackets and quotes inside strings, escapes, and strings that run over the end of a range
are read as JSON has them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored

BYTES = 1 << 20  # scanned together
QUOTE, ESCAPE, COLON, OPEN = b'"\\:{'
BRACKETS = {ord(c): 1 for c in "{["} | {ord(c): -1 for c in "}]"}
STEP = np.array([BRACKETS.get(b, 0) for b in range(256)], np.int8)
MARK = np.array([b in BRACKETS or b in (QUOTE, ESCAPE, COLON) for b in range(256)])
#: Where a key is from: it stands in the range; it runs over its begin; or, from 1, it was that container's when the range began.
HERE, ACROSS = 0, -1
#: Kinds of rows of the second pass.
WHOLE, PART, LAST_KEY, HEAD, TAIL = range(5)


@dataclass
class Marks:
    """Quotes, brackets and colons of some bytes, in order."""

    quotes: np.ndarray  # that open or close a string
    at: np.ndarray  # of brackets and colons
    step: np.ndarray  # of the depth: none at a colon
    inside: np.ndarray  # whether an odd number of quotes stands before

    @classmethod
    def of(cls, raw: np.ndarray) -> Marks:
        at = np.flatnonzero(MARK[raw])
        kind = raw[at]
        quote, escape = kind == QUOTE, kind == ESCAPE
        if escape.any():
            # Of a run of escapes every second one, from the first on, turns what follows it.
            order, follows = np.arange(len(at)), np.concatenate(([False], at[1:] == at[:-1] + 1))
            first = np.maximum.accumulate(np.where(escape & ~(follows & np.concatenate(([False], escape[:-1]))), order, 0))
            turns = escape & ((order - first) % 2 == 0)
            quote[1:] &= ~(turns[:-1] & follows[1:])
        odd = np.bitwise_xor.accumulate(quote)
        rest = ~(escape | (kind == QUOTE))
        return cls(at[quote], at[rest], STEP[kind[rest]], odd[rest])


def _fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """A range's name and some of its bytes, each fragment with the bracket that ended it."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files, blocks = batch.column("file"), batch.column("block")
        values = pc.binary_join_element_wise(batch.column("value").cast(pa.large_binary()), pa.scalar(b"}", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
        raw = np.frombuffer(values.buffers()[2], np.uint8)
        other = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), n]
        for at, last in pairwise(edges):
            name = files[at].as_py(), blocks[at].as_py()
            while at < last:
                to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + BYTES))), last)
                yield name, raw[ends[at] : ends[to]]
                at = to


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


SUMS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("flips", pa.bool_()), *((f"{k}{s}", pa.int64()) for s in (0, 1) for k in ("change", "low"))])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: whether it ends as it began, and the change and the lowest point of the depth from either begin."""
    now, flips, seen = None, False, []
    for name, raw in _fragments(batches):
        if name != now:
            if now:
                yield _batch([(*now, flips, *seen[0], *seen[1])], SUMS)
            now, flips, seen = name, False, [[0, 0], [0, 0]]
        marks = Marks.of(raw)
        for begin, state in enumerate(seen):
            depth = state[0] + np.cumsum(np.where(marks.inside ^ flips ^ bool(begin), 0, marks.step), dtype=np.int64)
            if len(depth):
                state[0], state[1] = int(depth[-1]), min(state[1], int(depth.min()))
        flips ^= bool(len(marks.quotes) % 2)
    if now:
        yield _batch([(*now, flips, *seen[0], *seen[1])], SUMS)


def _starts(sums: list, level: int) -> dict[tuple[str, int], tuple[int, bool, int, int]]:
    """How each range begins: its number in order, whether in a string, its depth, and the number of the range in which what is open at ``level`` began."""
    out: dict[tuple[str, int], tuple[int, bool, int, int]] = {}
    file, in_string, depth, owner = None, False, 0, 0
    for number, r in enumerate(sorted(sums, key=lambda r: (r["file"], r["block"]))):
        if r["file"] != file:
            file, in_string, depth, owner = r["file"], False, 0, number
        out[file, r["block"]] = number, in_string, depth, owner
        if depth + r[f"low{int(in_string)}"] <= level:
            owner = number
        depth += r[f"change{int(in_string)}"]
        in_string ^= r["flips"]
    return out


#: Ranges by their numbers; only keys (a few rows a range) name their file.
PARTS = pa.schema([("kind", pa.int32()), ("file", pa.string()), ("block", pa.int64()), ("owner", pa.int64()), ("key", pa.string()), ("origin", pa.int32()), ("value", pa.string())])


class _Cutter:
    """Cuts one range: whole objects at ``level``, and what runs over its ends."""

    def __init__(self, file: str, start: tuple[int, bool, int, int], level: int):
        self._file, self._level = file, level
        self._number, self._in_string, self._depth, self._owner = start
        self._open = self._depth > level
        self._held: list[bytes] = []  # of what is open
        self._keys: list[tuple[str | None, int]] = [(None, d) for d in range(1, level + 1)]  # the last of each container, from outside in
        self._held_key = self._key()
        self._string: list[bytes] | None = [] if self._in_string else None  # of the string that is open
        self._across = self._in_string  # it began before this range

    def _key(self) -> tuple[str | None, int]:
        """The innermost key that there is, or the place to look for it."""
        return next((k for k in reversed(self._keys) if k != (None, HERE)), (None, HERE))

    def add(self, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What these bytes complete: the objects that lie in them as one batch, and rows of what runs over their ends."""
        level, text = self._level, raw.tobytes()
        marks = Marks.of(raw)
        outside = marks.inside == self._in_string
        places, step = marks.at[outside], marks.step[outside]
        depth = self._depth + np.cumsum(step, dtype=np.int64)
        self._depth = int(depth[-1]) if len(depth) else self._depth
        seen = depth <= level + (step > 0)
        places, step, depth = places[seen], step[seen], depth[seen]
        # What opens above the level closes with the next mark that is seen, here or in bytes to come.
        whole = np.flatnonzero((step[:-1] > 0) & (depth[:-1] == level + 1))
        single = np.ones(len(places), bool)
        single[whole] = single[whole + 1] = False
        singles = np.flatnonzero(single)
        rows, keys, counts, done, since = [], [], [], 0, 0
        for at, turn, d, n in zip(places[single].tolist(), step[single].tolist(), depth[single].tolist(), np.searchsorted(whole, singles).tolist(), strict=True):
            if n > done:
                keys.append(self._key())
                counts.append(n - done)
                done = n
            if turn == 0:
                if d > 0:
                    self._keys[d - 1] = yield from self._key_before(text, marks, at)
            elif turn > 0 and d == level + 1:
                self._open, self._owner, self._held, self._held_key, since = True, self._number, [], self._key(), at
            elif turn < 0 and d == level and self._open:
                rows += self._closed(text[since : at + 1])
            else:
                first = d - 1 if turn > 0 else d  # a container that opens has no key yet, and those that have closed have none
                self._keys[max(first, 0) :] = [(None, HERE)] * (level - max(first, 0))
        if len(whole) > done:
            keys.append(self._key())
            counts.append(len(whole) - done)
        if self._open:
            self._held.append(text[since:])
        if len(marks.quotes) % 2:
            self._in_string = not self._in_string
        if not self._in_string:
            self._string = None
        elif len(marks.quotes):
            self._string, self._across = [text[int(marks.quotes[-1]) + 1 :]], False
        elif self._string is not None:
            self._string.append(text)
        if rows:
            yield _batch(rows, PARTS)
        if len(whole):
            yield from self._objects(raw, text, places[whole], places[whole + 1] + 1, keys, counts)

    def _objects(self, raw: np.ndarray, text: bytes, begins: np.ndarray, ends: np.ndarray, keys: list, counts: list[int]) -> Iterator[pa.RecordBatch]:
        """Whole objects, cut out of the bytes together; arrays aren't objects."""
        edges = np.stack([begins, ends], 1).ravel()
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(text)])
        kept = np.flatnonzero(raw[begins] == OPEN)
        if len(kept):
            which = np.repeat(np.arange(len(keys)), counts)[kept]
            key, origin = (pa.array(x, t).take(pa.array(which)) for x, t in zip(zip(*keys, strict=True), (pa.string(), pa.int32()), strict=True))
            same = [pa.repeat(pa.scalar(x, t), len(kept)) for x, t in ((WHOLE, pa.int32()), (None, pa.string()), (self._number, pa.int64()), (None, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*same, key, origin, pieces.take(pa.array(2 * kept)).cast(pa.string())], schema=PARTS)

    def _key_before(self, text: bytes, marks: Marks, colon: int) -> Iterator[pa.RecordBatch]:
        n = int(np.searchsorted(marks.quotes, colon))
        if n > 1:
            return text[int(marks.quotes[n - 2]) + 1 : int(marks.quotes[n - 1])].decode(), HERE
        key = b"".join([*(self._string or []), text[: int(marks.quotes[0])]]).decode()
        if not self._across:
            return key, HERE
        yield _batch([(HEAD, self._file, self._number, None, key, None, None)], PARTS)
        return None, ACROSS

    def _closed(self, last: bytes) -> Iterator[tuple]:
        value = b"".join([*self._held, last]).decode()
        self._open, self._held = False, []
        if self._owner != self._number:
            yield PART, None, self._number, self._owner, None, None, value
        elif value[0] == "{":
            yield WHOLE, None, self._number, None, *self._held_key, value

    def end(self) -> Iterator[tuple]:
        if self._open:
            yield PART, None, self._number, self._owner, *self._held_key, b"".join(self._held).decode()
        for d, key in enumerate(self._keys, 1):
            yield LAST_KEY, self._file, self._number, d, *key, None
        if self._string is not None and self._depth <= self._level:
            yield TAIL, self._file, self._number, None, b"".join(self._string).decode(), ACROSS if self._across else HERE, None


def _parts(batches: Iterator[pa.RecordBatch], starts: dict, level: int) -> Iterator[pa.RecordBatch]:
    now, cutter = None, None
    for name, raw in _fragments(batches):
        if name != now:
            if cutter:
                yield _batch(list(cutter.end()), PARTS)
            now, cutter = name, _Cutter(name[0], starts[name], level)
        yield from cutter.add(raw)
    if cutter:
        yield _batch(list(cutter.end()), PARTS)


def _keys_at_starts(rows: list, level: int) -> list[tuple[str, int, list[str | None], str | None]]:
    """(file, range, innermost key of the containers down to each that is open where it begins, key that runs over its begin)."""
    ranges: dict[tuple[str, int], dict[tuple[int, int | None], tuple]] = {}
    for r in rows:
        ranges.setdefault((r["file"], r["block"]), {})[r["kind"], r["owner"]] = (r["key"], r["origin"])
    out = []
    file, keys, tail = None, [None] * level, ""
    for (f, block), found in sorted(ranges.items()):
        if f != file:
            file, keys, tail = f, [None] * level, ""
        across = tail + found[HEAD, None][0] if (HEAD, None) in found else None
        inner, deepest = [], None
        for k in keys:
            deepest = deepest if k is None else k
            inner.append(deepest)
        out.append((f, block, inner, across))
        last = [found[LAST_KEY, d] for d in range(1, level + 1)]
        keys = [key if origin == HERE else across if origin == ACROSS else keys[d] for d, (key, origin) in enumerate(last)]
        end, origin = found.get((TAIL, None), ("", HERE))
        tail = end if origin == HERE else tail + end
    return out


def members(spark: SparkSession, path: str | list[str], level: int) -> DataFrame:
    """``(key, value)``: the JSON text of every object that lies in ``level`` containers, with the innermost key on its way.

    For an array of records the level is 1 and ``key`` null; for an object of objects it
    is 1 and ``key`` their own; for an object of arrays (COCO) it is 2 and ``key`` the
    array's.  What isn't an object is left out, and keys are as written, escapes
    included.  ``path`` may name several files or a folder; an empty document has no
    members.

    The file is read twice, a small row a range goes to the driver, and the objects are
    kept in a table of the session's shared folder, however often they are used.
    """
    text = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    ddl = lambda schema: ", ".join(f"{f.name} {({pa.string(): 'string', pa.int64(): 'long', pa.int32(): 'int', pa.bool_(): 'boolean'})[f.type]}" for f in schema)
    starts = _starts(text.mapInArrow(_sums, ddl(SUMS)).collect(), level)  # a row a range
    found = stored(text.mapInArrow(partial(_parts, starts=starts, level=level), ddl(PARTS)), "members")
    keys = found.where(F.col("kind") >= LAST_KEY).select("kind", "file", "block", "owner", "key", "origin").collect()  # a few short rows a range
    at_start = spark.createDataFrame(_keys_at_starts(keys, level), "_file string, block long, _inner array<string>, _across string").drop("_file")
    cut = found.where(F.col("kind") == PART).groupBy("owner").agg(F.min_by("key", "block").alias("key"), F.min_by("origin", "block").alias("origin"), F.sort_array(F.collect_list(F.struct("block", "value"))).alias("_parts"))
    joined = cut.select(F.col("owner").alias("block"), "key", "origin", F.array_join(F.transform("_parts", lambda x: x["value"]), "").alias("value")).where(F.col("value").startswith("{"))
    both = found.where(F.col("kind") == WHOLE).select("block", "key", "origin", "value").unionByName(joined)
    named = both.join(F.broadcast(at_start), "block", "left")  # a row a range
    return named.select(F.when(F.col("origin") == HERE, F.col("key")).when(F.col("origin") == ACROSS, F.col("_across")).otherwise(F.get("_inner", F.col("origin") - 1)).alias("key"), "value")
