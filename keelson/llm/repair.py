"""Conversation structure repair by A* on the edit lattice.

A node of the lattice is a number of rows dealt with and a state of the turn grammar
``(s?(ua)+)?``; its edges keep, rerole or delete the next row, or insert a turn.  The
heuristic of a node is the suffix sum of what its remaining rows cost at least: the
deletion of a blank or duplicate row, and for a truncated one the lesser of its charge
and its deletion.  It never decreases by more than an edge costs, so a node is final when
it first leaves the queue, which is keyed by (cost + heuristic, audit).

The audit is the string of the edits' initials.  Audits of one node and cost are never
one the beginning of the other (what is longer has inserts that cost), so the least audit
of a node is the beginning of the least whole one.

Conversations meet by id and are read in order as a stream.  A long one is searched
``BLOCK`` rows at a time, from all states that are reached to all states; edits that all
surviving paths share are final and leave memory with their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = 256  # rows searched together
BATCH_ROWS, BATCH_CHARS = 2048, 4 << 20  # written together
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
START, LED, ASKED, ANSWERED = range(4)  # nothing yet, after a system turn, after a user turn, after an assistant turn
#: The state after a turn whose role has that initial.
GRAMMAR = {START: {"s": LED, "u": ASKED}, LED: {"u": ASKED}, ASKED: {"a": ANSWERED}, ANSWERED: {"u": ASKED}}
FINAL = (START, ANSWERED)
NAMES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
EDITS = "edit string, turn long, fault string, old_role string, role string, text string"
LEGAL = ("su", "ua", "au")


@dataclass
class Row:
    turn: int | None
    role: str
    text: str
    fault: str | None

    @property
    def least(self) -> int:
        """What any path pays for it."""
        return DELETE if self.fault in (BLANK, DUPLICATE) else min(DELETE, TRUNCATED) if self.fault == CUT else 0


def _next_role(state: int) -> str:
    """The initial of the user or assistant turn that may follow."""
    return "a" if state == ASKED else "u"


def search(rows: list[Row], begin: dict[int, tuple[int, str]], goals: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) of each of ``goals`` after all ``rows``, from states with the (cost, audit) so far."""
    rest = [0] * (len(rows) + 1)
    for k in range(len(rows) - 1, -1, -1):
        rest[k] = rest[k + 1] + rows[k].least
    queue = [(cost + rest[0], audit, 0, state) for state, (cost, audit) in begin.items()]
    heapify(queue)
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while queue and len(found) < len(goals):
        total, audit, k, state = heappop(queue)
        if (k, state) in done:
            continue
        done.add((k, state))
        cost = total - rest[k]
        if k == len(rows) and state in goals:
            found[state] = (cost, audit)
        grammar = GRAMMAR[state]
        forced = grammar[_next_role(state)]
        heappush(queue, (total + INSERT, audit + "I", k, forced))
        if k == len(rows):
            continue
        row, h = rows[k], rest[k + 1]
        heappush(queue, (cost + DELETE + h, audit + "D", k + 1, state))
        if row.fault not in (BLANK, DUPLICATE):
            charge = TRUNCATED if row.fault == CUT else 0
            kept = grammar.get(row.role[:1])
            if kept is not None:
                heappush(queue, (cost + KEEP + charge + h, audit + "K", k + 1, kept))
            heappush(queue, (cost + REROLE + charge + h, audit + "R", k + 1, forced))
    return found


def _without_hopeless(live: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """States that another one serves better whatever follows: after an answer all may follow that may after a
    system turn, and at the price of one deletion all that may at the start."""
    if ANSWERED in live:
        cost = live[ANSWERED][0]
        live = {s: x for s, x in live.items() if not (s == LED and cost < x[0] or s == START and cost + DELETE < x[0])}
    return live


class _Repair:
    """One conversation, row by row; edits come out as they become final."""

    def __init__(self):
        self._live = {START: (0, "")}
        self._held: list[Row] = []  # rows whose edits aren't final
        self._new: list[Row] = []  # of them, those not yet searched
        self._state = START  # where the edits so far have led

    def add(self, row: Row) -> Iterator[tuple]:
        if len(self._new) == BLOCK:
            self._live = _without_hopeless(search(self._new, self._live, (START, LED, ASKED, ANSWERED)))
            self._held += self._new
            self._new = []
            shared = commonprefix([audit for _, audit in self._live.values()])
            yield from self._made(shared)
            self._live = {s: (cost, audit[len(shared) :]) for s, (cost, audit) in self._live.items()}
        self._new.append(row)

    def end(self) -> Iterator[tuple]:
        self._live = search(self._new, self._live, FINAL)
        self._held += self._new
        yield from self._made(min(self._live.values())[1])

    def _made(self, audit: str) -> Iterator[tuple]:
        rows = iter(self._held)
        used = 0
        for edit in audit:
            row = None if edit == "I" else next(rows)
            used += row is not None
            initial = row.role[:1] if edit == "K" else _next_role(self._state)
            known = (edit, None, None, None) if row is None else (edit, row.turn, row.fault, row.role)
            if edit == "D":
                yield (*known, None, None)
                continue
            self._state = GRAMMAR[self._state][initial]
            yield (*known, row.role if edit == "K" else NAMES[initial], "" if row is None else row.text)
        self._held = self._held[used:]


def _repair(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by conversation and turn."""
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    now, own = None, None
    for given in batches:
        for at in range(0, given.num_rows, BATCH_ROWS):
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in given.slice(at, BATCH_ROWS).columns), strict=True):
                made = iter(())
                if own is None or conv != now:
                    ended = ((now, *x) for x in own.end()) if own else iter(())
                    for x in ended:
                        out.append(x)
                        size += len(x[-1] or "")
                    now, own = conv, _Repair()
                made = own.add(Row(turn, role, text, fault))
                for x in made:
                    out.append((now, *x))
                    size += len(x[-1] or "")
                if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield batch()
                    out, size = [], 0
    if own:
        out += [(now, *x) for x in own.end()]
    if out:
        yield batch()


def in_order(convs: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, fault)`` with each conversation's rows together and in order.

    The order is turn (nulls first), role, text.  ``fault`` is the first that holds of
    blank (no word), duplicate (role and text stand in an earlier row of the
    conversation) and truncated (the last character that isn't white space isn't one of
    ``.!?``).  One exchange, of rows by conversation, serves this and the search.
    """
    own = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    inner = F.regexp_extract("text", r"([^ \t-\r])[ \t-\r]*\z", 1)
    fault = F.when(~F.col("text").rlike(r"[^ \t-\r]"), BLANK).when(F.col("_n") > 1, DUPLICATE).when(~inner.isin(".", "!", "?"), CUT)
    marked = own.repartition("conv_id").withColumn("_n", again).withColumn("fault", fault).drop("_n")
    return marked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault").asc_nulls_first())


def repair(convs: DataFrame) -> DataFrame:
    """The cheapest edits that give each conversation of ``convs(conv_id, turn, role, text)`` a legal order of turns.

    ``(conv_id, edit, turn, fault, old_role, role, text)``, a row for each edit in the
    order of the repaired conversation: ``K`` keeps a row, ``R`` changes its role to user
    or assistant, ``D`` deletes it (role and text are null), ``I`` inserts an empty turn
    (turn, fault and old_role are null).  What stays begins with a system turn or none
    and goes on with pairs of a user and an assistant turn, by the initials of the roles.
    Blank and duplicate rows have to go, a truncated one that stays costs as much as an
    insertion, and of equally cheap edits the least string of initials is taken.

    Null roles and texts count as one space; an empty role has no initial and can't be
    kept; a null conv_id is a conversation of its own; null turns come first; repeated
    rows are duplicates; texts may have any length; an empty table gives no rows; other
    columns are not read.  A conversation is one sequence and is searched by one task, as
    a stream.
    """
    from functools import partial

    rows = in_order(convs)
    schema = StructType.fromDDL(f"conv_id long, {EDITS}")
    arrow = pa.schema([(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.string()) for f in schema])
    return rows.mapInArrow(partial(_repair, schema=arrow), schema)


def _summaries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sums and digests of conversations whose edits come one after the other."""
    import hashlib

    done: list[tuple] = []
    now, s = None, None

    def closed() -> tuple:
        gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
        return now, gaps, s[BLANK], s[DUPLICATE], s[CUT], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    for given in batches:
        for conv, edit, turn, fault, old, role, text in zip(*(c.to_pylist() for c in given.columns), strict=True):
            if s is None or conv != now:
                if s:
                    done.append(closed())
                now, s = conv, {"low": None, "high": None, "turns": 0, BLANK: 0, DUPLICATE: 0, CUT: 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "last": None, "any": False}
            s["audit"].append(edit)
            if edit != "I":
                if turn is not None and turn != s["high"]:
                    s["low"] = turn if s["low"] is None else s["low"]
                    s["high"] = turn
                    s["turns"] += 1
                if fault:
                    s[fault] += 1
                initial = old[:1]
                s["illegal"] += s["last"] is not None and s["last"] + initial not in LEGAL
                s["last"] = initial
            s["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == CUT and edit != "D" else 0)
            if edit != "D":
                s["sha"].update(f"{chr(10) * s['any']}{role}:{text}".encode())
                s["any"] = True
        if len(done) >= BATCH_ROWS:
            yield batch()
            done = []
    if s:
        done.append(closed())
    if done:
        yield batch()


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(edits: DataFrame) -> DataFrame:
    """A row for each conversation of :func:`repair`'s result, which has to come as it was made, conversations whole and in order."""
    from functools import partial

    schema = StructType.fromDDL(SUMMARY)
    arrow = pa.schema([(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.string()) for f in schema])
    return edits.mapInArrow(partial(_summaries, schema=arrow), schema)


def damaged(convs: DataFrame) -> DataFrame:
    """``convs(conv_id, turn, role, text)`` with faults dealt out by a checksum of conversation and turn.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3
    repeats the row, 4 makes the role ``user``.  Nulls count as one space; a null turn stays null.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    own = convs.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("_f")).where("_f <> 0")
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_f") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_f") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all conversations after damage; those without rows left have zeros and empty results."""
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    made = summaries(repair(damaged(convs))).withColumnRenamed("conv_id", "_id")
    every = convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(made, every["conv_id"].eqNullSafe(made["_id"]), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
