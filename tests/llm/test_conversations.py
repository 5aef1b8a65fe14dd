"""Conversation repair: the search against all ways, the query against one pass over each conversation."""

import hashlib
import itertools
import os
import random
import zlib
from functools import lru_cache

import pytest

from provena.llm import conversations as c

SF = "/root/testdata/sf0.001"


def _least(rows, entry=0, exits=(0, 3), tail=True):
    """(cost, audit) by recursion over all edits, without a search."""
    n = len(rows)
    needed = {0: "u", 1: "u", 2: "a", 3: "u"}
    after = {"s": 1, "u": 2, "a": 3}
    legal = {0: "su", 1: "u", 2: "a", 3: "u"}

    @lru_cache(maxsize=None)
    def go(at, state, inserts):
        ways = [(0, "")] if at == n and state in exits else []
        if inserts < 2 and (at < n or tail):
            ways += [(5 + x, "I" + a) for x, a in go(at, after[needed[state]], inserts + 1)]
        if at < n:
            initial, fault = rows[at]
            ways += [(2 + x, "D" + a) for x, a in go(at + 1, state, 0)]
            if fault in (0, 3):
                more = 5 if fault == 3 else 0
                if initial and initial in legal[state]:
                    ways += [(more + x, "K" + a) for x, a in go(at + 1, after[initial], 0)]
                ways += [(1 + more + x, "R" + a) for x, a in go(at + 1, after[needed[state]], 0)]
        return [min(ways)] if ways else []

    for at, state in itertools.product(range(n, 0, -1), range(4)):
        go(at, state, 0)
    found = go(0, entry, 0)
    return found[0] if found else None


def test_search_equals_all_ways():
    r = random.Random(5)
    for k in range(1500):
        rows = [(r.choice("suuaaat") if r.random() < 0.97 else "", r.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 9))]
        assert c.cheapest(rows) == _least(rows), rows
        if k % 5 == 0:
            for s, t in itertools.product(range(4), range(4)):
                assert c.cheapest(rows, s, (t,), tail=False) == _least(rows, s, (t,), False), (rows, s, t)


def test_long_conversation_in_one_search():
    r = random.Random(6)
    rows = [(r.choice("uuaas"), r.choice([0, 0, 0, 0, 0, 1, 2, 3])) for _ in range(300)]
    assert c.cheapest(rows) == _least(rows)


def _order(v):
    return (v is not None, v if v is not None else 0)


def _by_hand(rows):
    """The contract's rows from (conv, turn, role, text), one conversation after the other."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    for conv, found in out.items():
        found.sort(key=lambda x: (_order(x[0]), x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in found:
            bare = text.strip("\t\n\x0b\f\r ")
            faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
        initials = [x[1][:1] for x in found]
        cost, audit = _least(list(zip(initials, faults, strict=True)))
        left, at, state = [], 0, 0
        for letter in audit:
            need = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
            if letter == "I":
                left.append((need, ""))
            elif letter in "KR":
                left.append((found[at][1] if letter == "K" else need, found[at][2]))
            if letter != "D":
                state = {"s": 1, "u": 2, "a": 3}[left[-1][0][0]]
            at += letter != "I"
        turns = {x[0] for x in found} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = ((gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, sha), left)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _odd_rows():
    r = random.Random(9)
    texts = ["Yes.", "No!", "And?", "well", "", " \n", "Good. ", "é😀.", None, "x" * 3000 + "."]
    rows = [(conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(texts)) for conv in range(60) for turn in range(r.randint(0, 9))]
    rows += [(None, t, "user", "Hi.") for t in (None, 0, 1)] + [(77, None, None, None)] * 3 + [(78, 5, "user", "A.")] * 4 + [(79, 1, "user", "B."), (79, 1, "assistant", "A.")]
    # One conversation has most rows, and copies of one message.
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", "Same." if t % 3 else f"Message {t}{'.' if t % 7 else ''}") for t in range(700)]
    return rows


@pytest.mark.parametrize("most_rows", [c.SEGMENT_ROWS, 40])
def test_report_and_messages_by_hand(spark, most_rows):
    rows = _odd_rows()
    docs = spark.createDataFrame([(*x, "n", 1) for x in rows], "conv_id long, turn long, role string, text string, conv string, part int").repartition(5)
    want = _by_hand(rows)
    damaged = c.damaged(docs)
    got = {x.conv_id: tuple(x[k] for k in COLUMNS) for x in c.report(damaged, most_rows=most_rows).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    left = {}
    for x in c.messages(damaged, most_rows=most_rows).orderBy("place").collect():
        left.setdefault(x.conv_id, []).append((x.role, x.text))
    assert left == {k: v[1] for k, v in want.items() if v[1]}


def test_undamaged_and_empty(spark):
    docs = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "No.")], "conv_id long, turn long, role string, text string")
    got = {x.conv_id: (x.cost, x.audit) for x in c.report(c.as_found(docs)).collect()}
    assert got == {1: (0, "KK"), 2: (2, "D")}
    empty = c.report(c.damaged(docs.limit(0)))
    assert empty.columns == ["conv_id", *COLUMNS] and empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_by_hand(spark):
    from provena.llm.queries import op12_conversation_repair

    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {x.conv_id: tuple(x[k] for k in COLUMNS) for x in op12_conversation_repair(spark, SF).collect()}
    assert got == {k: v[0] for k, v in _by_hand(rows).items()}
