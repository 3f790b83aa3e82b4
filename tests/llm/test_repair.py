"""Conversation repair against all edit sequences, and long conversations against one search."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from keelson.llm import repair
from keelson.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WHITE = re.compile(r"[^\x20\x09-\x0D]")
CONV = "conv_id long, turn long, role string, text string"


def rows_of(convs):
    """Rows by conversation after damage, in order."""
    out = {}
    for conv, turn, role, text in convs:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        letters = WHITE.findall(text)
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cost, audit and repaired rows: of all edits, by cost and then audit, with memory of what follows from a place."""
    kinds = faults(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(k, last, inserts):
        found = []
        if k == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserts:
            for r in ("user", "assistant"):
                if (last, r[0]) in step:
                    cost, audit, rest = best(k, r[0], inserts - 1)
                    found.append((cost + 5, "I" + audit, ((r, ""), *rest)))
        if k < len(rows):
            _, role, text = rows[k]
            cost, audit, rest = best(k + 1, last, 3)
            found.append((cost + 2, "D" + audit, rest))
            if kinds[k] not in ("blank", "duplicate"):
                extra = 5 * (kinds[k] == "truncated")
                for edit, r, price in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                    if (last, r[:1]) in step:
                        cost, audit, rest = best(k + 1, r[:1], 3)
                        found.append((cost + price + extra, edit + audit, ((r, text), *rest)))
        return min(found, default=(10**9, "~", ()), key=lambda x: x[:2])

    return best(0, "", 3)


def plain(convs):
    out = {}
    for conv, rows in rows_of(convs).items():
        kinds = faults(rows)
        cost, audit, kept = plain_repair(tuple(rows))
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def ours(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_query(spark):
    convs = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ours(QUERIES["op11_conversation_repair"](spark, SF)) == plain(convs)


def odd(seed, n_convs=150, longest=9):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "a"]
    texts = ["yes.", "no", "no!", "", " \t\n", None, "Wait?  ", "…", "yes. \x1c"]
    out = []
    for conv in [None, *range(n_convs)]:
        for k in range(rnd.randint(1, longest)):
            role = rnd.choice(roles[:2]) if rnd.random() < 0.6 else rnd.choice(roles)
            text = f"turn {k}." if rnd.random() < 0.5 else rnd.choice(texts)
            out.append((conv, rnd.choice([k, k, k, k // 2, None]), role, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, tmp_path, seed):
    """Nulls everywhere, repeated and tied turns, odd roles, extra columns."""
    rows = odd(seed)
    spark.createDataFrame(rows, CONV).selectExpr("*", "'x' AS edit", "1 AS fault").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert ours(QUERIES["op11_conversation_repair"](spark, str(tmp_path))) == plain(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect() == []


def test_against_every_edit():
    """Up to four rows: every string of edits up to the least cost."""
    rnd = random.Random(5)
    grammar = re.compile(r"(s?(ua)+)?")

    def every(rows, cap):
        found, todo = [], [(0, "", 0, "")]
        while todo:
            cost, audit, k, roles = todo.pop()
            if cost > cap or not re.match(r"s?(ua)*u?$", roles):
                continue
            if k == len(rows) and grammar.fullmatch(roles):
                found.append((cost, audit))
            todo += [(cost + 5, audit + "I", k, roles + r) for r in "ua"]
            if k < len(rows):
                todo.append((cost + 2, audit + "D", k + 1, roles))
                if rows[k].fault not in ("blank", "duplicate"):
                    extra = 5 * (rows[k].fault == "truncated")
                    todo += [(cost + p + extra, audit + e, k + 1, roles + r) for e, r, p in (("K", rows[k].role[:1], 0), ("R", "u", 1), ("R", "a", 1)) if r]
        return min(found)

    for _ in range(300):
        rows = [repair.Row(k, rnd.choice(["user", "assistant", "system", "tool"]), "", rnd.choice([None, None, "blank", "truncated"])) for k in range(rnd.randint(0, 4))]
        got = min(repair.search(rows, {repair.START: (0, "")}, repair.FINAL).values())
        assert got == every(rows, got[0])


@pytest.mark.parametrize("block", [1, 2, 7])
def test_long_conversations_in_blocks(monkeypatch, block):
    """Searched in blocks, a conversation is repaired as in one search, and settled rows leave memory."""
    rnd = random.Random(block)
    for _ in range(200):
        rows = [repair.Row(k, rnd.choice(["user", "assistant", "system", "tool"]), f"t{k}", rnd.choice([None, None, None, "duplicate", "truncated"])) for k in range(rnd.randint(0, 40))]
        want = min(repair.search(rows, {repair.START: (0, "")}, repair.FINAL).values())[1]
        monkeypatch.setattr(repair, "BLOCK", block)
        own = repair._Repair()
        made = [x for r in rows for x in own.add(r)] + list(own.end())
        assert "".join(x[0] for x in made) == want
        assert [x[1] for x in made if x[0] != "I"] == list(range(len(rows)))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[4][0] for x in made if x[0] != "D"))


def test_memory_of_a_long_conversation():
    own, most = repair._Repair(), 0
    for k in range(20_000):
        for _ in own.add(repair.Row(k, "user" if k % 2 == 0 or k % 97 == 0 else "assistant", "x.", "truncated" if k % 13 == 0 else None)):
            pass
        most = max(most, len(own._held))
    assert most < 3 * repair.BLOCK


def test_edits_are_whole(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", "b."), (2, None, "user", "only."), (3, 5, "tool", "")]
    got = [tuple(r) for r in repair.repair(spark.createDataFrame(rows, CONV).coalesce(1)).orderBy("conv_id").collect()]
    assert got == [
        (1, "K", 0, None, "system", "system", "s."),
        (1, "R", 1, None, "assistant", "user", "a."),
        (1, "R", 2, None, "user", "assistant", "b."),
        (2, "D", None, None, "user", None, None),
        (3, "D", 5, "blank", "tool", None, None),
    ]
