"""Conversation structure repair: the cheapest edits that give a conversation its turns, by Dijkstra's search from both ends.

A repaired conversation has at most one system message, then pairs of user and assistant. The edit lattice of
a conversation has a node for each row reached and each state of that pattern. A search from the first node and
one from the last ones meet; when both radii together pass the cheapest way found, every cheapest way crosses
from what one has settled to what the other has, so the least of the audits put together at these crossings is
the least of all.

Rows are sorted by conversation and turn in ranges that cut through conversations, and read in order as a stream,
so no conversation is gathered. One that lies within a range, with at most `SEGMENT_ROWS` rows, is repaired
there. Others are told in segments of so many rows: for each a table of the least costs from each state before
to each after it (searched the same way), from which its states along the cheapest way follow; each segment then
has its own part of the audit, and digests are continued over segments in order. What is gathered of a
conversation is that table, 36 numbers for each segment, and its audit, a letter for each edit, which is the
result itself.

Nulls: a null id is a conversation of its own; null turns come first; a null role or text is one space. Ties:
rows of one turn are taken in the order of role and text, so copies are adjacent and the later are duplicates.
An empty role has no initial and is no role of the pattern. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import kept_table, modest_batches, named, tidy

#: Rows and bytes of text that are searched at once.
SEGMENT_ROWS, SEGMENT_BYTES = 512, 1 << 20

# What edits cost, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# Faults of a row.
FINE, BLANK, DUPLICATE, CUT_SHORT = range(4)
_SPACE = "\t\n\x0b\f\r "

# States of the pattern (s?(ua)+)?: nothing yet, after a system message, after a user's, after an assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEEP = {("s", _START): _SYSTEM, ("u", _START): _USER, ("u", _SYSTEM): _USER, ("u", _ASSISTANT): _USER, ("a", _USER): _ASSISTANT}
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_NAME = {_USER: "user", _ASSISTANT: "assistant"}
_ENDS = (_START, _ASSISTANT)
#: What ends a conversation from each state: inserted rows.
_CLOSING = {_START: "", _SYSTEM: "II", _USER: "I", _ASSISTANT: ""}
_FAR = 1 << 60

Row = tuple[str, int]  # initial, fault


def _after(rows: list[Row], at: int, state: int, tail: bool) -> Iterator[tuple[int, int, int, str]]:
    """(place, state, cost, letter) of the edits at a place."""
    if at < len(rows) or tail:
        yield at, _NEXT[state], INSERT, "I"
    if at < len(rows):
        initial, fault = rows[at]
        yield at + 1, state, DELETE, "D"
        if fault in (FINE, CUT_SHORT):
            more = TRUNCATED if fault == CUT_SHORT else 0
            if (kept := _KEEP.get((initial, state))) is not None:
                yield at + 1, kept, more, "K"
            yield at + 1, _NEXT[state], REROLE + more, "R"


def _ahead(rows: list[Row], at: int, state: int, tail: bool) -> Iterator[tuple[int, int, int, str]]:
    """(place, state, cost, letter) of the edits that lead to a place."""
    if at < len(rows) or tail:
        for s in range(4):
            if _NEXT[s] == state:
                yield at, s, INSERT, "I"
    if at:
        initial, fault = rows[at - 1]
        yield at - 1, state, DELETE, "D"
        if fault in (FINE, CUT_SHORT):
            more = TRUNCATED if fault == CUT_SHORT else 0
            for s in range(4):
                if _KEEP.get((initial, s)) == state:
                    yield at - 1, s, more, "K"
                if _NEXT[s] == state:
                    yield at - 1, s, REROLE + more, "R"


class _Search:
    """Dijkstra's search from one end. Of equal cost, nodes nearer to the end come first, so that an edit without cost never leads to a node that was settled."""

    def __init__(self, rows: list[Row], ends: list[tuple[int, int]], edits, forward: bool, tail: bool):
        self.rows, self.edits, self.tail, self.forward = rows, edits, tail, forward
        self.label = {e: (0, "") for e in ends}
        self.heap = [(0, self._far(e[0]), e) for e in ends]
        self.heap.sort()
        self.settled: set[tuple[int, int]] = set()
        self.ends = set(ends)

    def final(self) -> set[tuple[int, int]]:
        """Nodes whose label no longer changes."""
        return self.settled | self.ends

    def _far(self, at: int) -> int:
        return at if self.forward else len(self.rows) - at

    def radius(self) -> int:
        while self.heap and (self.heap[0][2] in self.settled or self.heap[0][0] > self.label[self.heap[0][2]][0]):
            heappop(self.heap)
        return self.heap[0][0] if self.heap else _FAR

    def step(self) -> Iterator[tuple[tuple[int, int], int]]:
        """Settles the nearest node; the nodes that it leads to, with the costs by way of it."""
        _, _, node = heappop(self.heap)
        self.settled.add(node)
        cost, audit = self.label[node]
        for at, state, more, letter in self.edits(self.rows, *node, self.tail):
            to, new = (at, state), (cost + more, audit + letter if self.forward else letter + audit)
            old = self.label.get(to)
            if old is None or new < old:
                if old is None or new[0] < old[0]:
                    heappush(self.heap, (new[0], self._far(at), to))
                self.label[to] = new
            yield to, new[0]


def cheapest(rows: list[Row], entry: int = _START, exits: tuple[int, ...] = _ENDS, tail: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of rows from a state to one of the exits; of equal ones the ASCII-least audit. None if there are none.

    Without `tail` nothing is inserted after the last row.
    """
    there = _Search(rows, [(0, entry)], _after, True, tail)
    back = _Search(rows, [(len(rows), e) for e in exits], _ahead, False, tail)
    best = 0 if (0, entry) in back.label else _FAR
    while min(there.radius(), back.radius()) < _FAR and there.radius() + back.radius() <= best:
        near, other = (there, back) if there.radius() <= back.radius() else (back, there)
        for node, cost in near.step():
            if node in other.label:
                best = min(best, cost + other.label[node][0])
    if best == _FAR:
        return None
    from_start, from_end = there.final(), back.final()
    audits = [there.label[n][1] + back.label[n][1] for n in from_start & from_end if there.label[n][0] + back.label[n][0] == best]
    for n in from_start:
        cost, audit = there.label[n]
        for at, state, more, letter in _after(rows, *n, tail):
            if (at, state) in from_end and cost + more + back.label[at, state][0] == best:
                audits.append(audit + letter + back.label[at, state][1])
    return best, min(audits)


def repaired(audit: str, roles: list[str], texts: list[str], state: int = _START) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the edits of an audit leave."""
    at = 0
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            yield _NAME[state], ""
            continue
        if letter == "R":
            state = _NEXT[state]
            yield _NAME[state], texts[at]
        elif letter == "K":
            state = _KEEP[roles[at][:1], state]
            yield roles[at], texts[at]
        at += 1


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, times) of conversations as one finds them: by crc32 of `id:turn`, of twenty rows one is gone (times 0), one has no text, one no marks that end sentences, one is there twice and one is the user's."""
    conv, turn, role, text = named([id_col, turn_col, role_col, text_col])
    said = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    what = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    new = F.when(what == 1, "").when(what == 2, F.translate(said(text), ".!?", "")).otherwise(said(text))
    return conversations.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.when(what == 4, "user").otherwise(said(role)).alias("role"), new.alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("times"))


def as_found(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, times) of conversations as they are."""
    conv, turn, role, text = named([id_col, turn_col, role_col, text_col])
    return conversations.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), F.lit(1).alias("times"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows in ranges by conversation and turn, each with `late`: whether its role and text stand in an earlier turn."""
    # Counts and least turns are found per task first, so a text that is everywhere is no burden to one of them.
    digest = F.sha2("text", 256)
    has = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"))
    again = rows.where("times > 0").groupBy("conv", F.col("role").alias("_role"), digest.alias("_digest")).agg(F.min(has).alias("_first"), F.sum("times").alias("_n"))
    again = again.where("_n > 1").withColumnRenamed("conv", "_conv").drop("_n")
    same = rows["conv"].eqNullSafe(again["_conv"]) & (rows["role"] == again["_role"]) & (digest == again["_digest"])
    out = rows.join(again, same, "left").withColumn("late", F.coalesce(has > F.col("_first"), F.lit(False)))
    return out.select("conv", "turn", "role", "text", "times", "late").repartitionByRange("conv", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv", "turn", "role", "text")


_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal")
_SEGMENT = (
    "part int, seq long, whole boolean, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, lo long, hi long, turns long,"
    " cost long, audit string, sha string, roles array<string>, texts array<string>, faults array<int>"
)


def _fault(text: str, again: bool) -> int:
    bare = text.rstrip(_SPACE)
    if not bare:
        return BLANK
    return DUPLICATE if again else FINE if bare[-1] in ".!?" else CUT_SHORT


def _digest(rows: Iterator[tuple[str, str]]):
    h, first = hashlib.sha256(), True
    for role, text in rows:
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return h


class _Segment:
    """Rows of one conversation that follow one another, as they come in."""

    def __init__(self, conv, opens: bool):
        self.conv, self.opens, self.bytes, self.before = conv, opens, 0, None
        self.roles, self.texts, self.faults, self.turns = [], [], [], []

    def add(self, turn, role: str, text: str, again: bool) -> None:
        self.bytes += len(text)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(_fault(text, again))
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def row(self, part: int, seq: int, whole: bool, with_rows: bool) -> tuple:
        initials = [r[:1] for r in self.roles]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        n = [len(initials), *(self.faults.count(f) for f in (BLANK, DUPLICATE, CUT_SHORT)), illegal]
        ends = (initials[0], initials[-1]) if initials else (None, None)
        turns = (self.turns[0], self.turns[-1], len(self.turns)) if self.turns else (None, None, 0)
        cost = audit = sha = None
        if whole:
            cost, audit = cheapest(list(zip(initials, self.faults, strict=True)))
            sha = _digest(repaired(audit, self.roles, self.texts)).hexdigest()
        lists = (self.roles, self.texts, self.faults) if with_rows or not whole else (None, None, None)
        return (self.conv, part, seq, whole, *n, *ends, *turns, cost, audit, sha, *lists)


def _segments(kind: pa.DataType, with_rows: bool, most_rows: int, most_bytes: int):
    """From rows in order to rows of _SEGMENT. The first and the last conversation of a task may go on in others, so they are never whole."""
    names = ["conv", *(x.split()[0] for x in _SEGMENT.split(", "))]
    kinds = [kind, pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32())]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def cut_up(batches):
        from pyspark import TaskContext

        part, seq, now, last, first, out, size = TaskContext.get().partitionId(), 0, None, None, True, [], 0
        for batch in batches:
            for conv, turn, role, text, times, late in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row(part, seq, now.opens and not first, with_rows))
                        size, seq, first = size + now.bytes, seq + 1, False
                    now, last = _Segment(conv, True), None
                same = last == (turn, role, text)
                for k in range(times):
                    if len(now.roles) >= most_rows or now.bytes >= most_bytes:
                        out.append(now.row(part, seq, False, with_rows))
                        size, seq = size + now.bytes, seq + 1
                        now = _Segment(conv, False)
                    now.add(turn, role, text, late or same or k > 0)
                if times:
                    last = (turn, role, text)
                if size >= 1 << 20 or len(out) >= 2000:
                    yield made(out)
                    out, size = [], 0
        if now is not None:
            out.append(now.row(part, seq, False, with_rows))
        if out:
            yield made(out)
        tidy()

    return cut_up


_PAIRS = [(s, t) for s in range(4) for t in range(4)]


def _tables(batches):
    """Costs from each state to each over a segment, and the place of each way's audit among those from the same state."""
    for batch in batches:
        costs, ranks = [], []
        for roles, faults in zip(batch.column("roles").to_pylist(), batch.column("faults").to_pylist(), strict=True):
            rows = [(r[:1], f) for r, f in zip(roles, faults, strict=True)]
            ways = {p: cheapest(rows, p[0], (p[1],), tail=False) for p in _PAIRS}
            order = {p: k for k, p in enumerate(sorted((p for p in _PAIRS if ways[p]), key=lambda p: ways[p][1]))}
            costs.append([ways[p][0] if ways[p] else -1 for p in _PAIRS])
            ranks.append([order.get(p, -1) for p in _PAIRS])
        kept = [batch.column(c) for c in batch.schema.names if c not in ("roles", "faults")]
        names = [c for c in batch.schema.names if c not in ("roles", "faults")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))], [*names, "costs", "ranks"])


_WAY = "part int, seq long, entry int, exit int, cost long, gaps long, rows long, blank long, duplicate long, truncated long, illegal long, ends boolean"


def _ways(pdf):
    """For each segment of a conversation the states that the cheapest way has before and after it, and the conversation's own figures."""
    import pandas as pd

    pdf = pdf.sort_values(["part", "seq"])
    costs = [[_FAR if c < 0 else c for c in row] for row in pdf["costs"]]
    left = [[INSERT * len(_CLOSING[s]) for s in range(4)]]  # from a state before a segment to the end
    for row in reversed(costs):
        left.append([min(row[4 * s + t] + left[-1][t] for t in range(4)) for s in range(4)])
    left.reverse()
    state, entries, exits = _START, [], []
    for k, (row, rank) in enumerate(zip(costs, pdf["ranks"], strict=True)):
        # Ways over a segment end with an edit of its last row, so no audit begins with another, and the least goes on best.
        to = min((t for t in range(4) if row[4 * state + t] + left[k + 1][t] == left[k][state]), key=lambda t: rank[4 * state + t])
        entries.append(state)
        exits.append(to)
        state = to
    n = {c: int(pdf[c].sum()) for c in _COUNTS}
    before = None
    for first, last in zip(pdf["first"], pdf["last"], strict=True):
        if first is not None:
            n["illegal"] += before is not None and before + first not in ("su", "ua", "au")
            before = last
    turns, lo, hi, at = 0, None, None, None
    for a, b, k in zip(pdf["lo"], pdf["hi"], pdf["turns"], strict=True):
        if k:
            turns, lo, at, hi = turns + int(k) - (at == a), a if lo is None else lo, b, b
    gaps = 0 if lo is None else int(hi) - int(lo) + 1 - turns
    same = {"cost": left[0][_START], "gaps": gaps, **n}
    out = pd.DataFrame({"part": pdf["part"], "seq": pdf["seq"], "entry": entries, "exit": exits})
    for k, v in same.items():
        out[k] = v
    out["ends"] = [False] * (len(out) - 1) + [True]
    return out[[x.split()[0] for x in _WAY.split(", ")]]


_FIGURES = ["gaps", "rows", "blank", "duplicate", "truncated", "illegal", "cost"]


def _continued(kind: pa.DataType, messages: bool):
    """From segments in order, with the states before and after them, to their conversations' audits and digests, or to their messages."""

    def run(batches):
        audit, digest, place = [], hashlib.sha256(), 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                way = cheapest([(r[:1], f) for r, f in zip(row["roles"], row["faults"], strict=True)], row["entry"], (row["exit"],), tail=False)[1]
                left = list(repaired(way, row["roles"], row["texts"], row["entry"]))
                if row["ends"]:
                    left += repaired(_CLOSING[row["exit"]], [], [], row["exit"])
                if messages:
                    out += [(row["conv"], place + k, r, t) for k, (r, t) in enumerate(left)]
                    place = 0 if row["ends"] else place + len(left)
                    continue
                audit.append(way)
                for role, text in left:
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                    place += 1
                if row["ends"]:
                    out.append((row["conv"], *(row[c] for c in _FIGURES), "".join(audit) + _CLOSING[row["exit"]], digest.hexdigest()))
                    audit, digest, place = [], hashlib.sha256(), 0
            names = ["conv", "place", "role", "text"] if messages else ["conv", *_FIGURES, "audit", "sha"]
            kinds = [kind, pa.int64(), pa.string(), pa.string()] if messages else [kind, *[pa.int64()] * len(_FIGURES), pa.string(), pa.string()]
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        tidy()

    return run


def _told(rows: DataFrame, with_rows: bool, most_rows: int, most_bytes: int) -> tuple[DataFrame, DataFrame, pa.DataType]:
    """Segments of conversations, and those of several segments with their states; both are in the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = rows.sparkSession
    modest_batches(spark)
    kind = rows.schema["conv"].dataType
    arrow, conv = to_arrow_type(kind), f"conv {kind.simpleString()}"
    told = kept_table(_in_order(rows).mapInArrow(_segments(arrow, with_rows, most_rows, most_bytes), f"{conv}, {_SEGMENT}"), "conversations")
    cut_up = told.where("not whole")
    narrow = ["conv", "part", "seq", *_COUNTS, "first", "last", "lo", "hi", "turns"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.select(*narrow).schema)
    tables = cut_up.select(*narrow, "roles", "faults").mapInArrow(_tables, f"{kinds}, costs array<bigint>, ranks array<int>")
    ways = tables.groupBy("conv").applyInPandas(_ways, _WAY)
    parts = cut_up.select("conv", "part", "seq", "roles", "texts", "faults").join(ways, ["part", "seq"])
    return told, parts.repartition("conv").sortWithinPartitions("conv", "part", "seq"), arrow


def report(rows: DataFrame, id_col: str = "conv_id", most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Per conversation of damaged() or as_found(): id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. One whose rows are all gone has zeros and an empty audit."""
    told, parts, kind = _told(rows, False, most_rows, most_bytes)
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    whole = told.where("whole").select("conv", gaps, *_FIGURES[1:], "audit", "sha")
    conv = f"conv {rows.schema['conv'].dataType.simpleString()}"
    long = parts.mapInArrow(_continued(kind, False), f"{conv}, {', '.join(f'{c} long' for c in _FIGURES)}, audit string, sha string")
    out = whole.unionByName(long)
    return out.select(F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def messages(rows: DataFrame, id_col: str = "conv_id", most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(id_col, place, role, text): the repaired conversations, places from 0. One of which nothing is left has no row."""
    told, parts, kind = _told(rows, True, most_rows, most_bytes)
    conv = f"conv {rows.schema['conv'].dataType.simpleString()}"

    def left(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out += [(row["conv"], k, r, t) for k, (r, t) in enumerate(repaired(row["audit"], row["roles"], row["texts"]))]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, pa.int64(), pa.string(), pa.string()], strict=True)], ["conv", "place", "role", "text"])

    schema = f"{conv}, place long, role string, text string"
    whole = told.where("whole").select("conv", "audit", "roles", "texts").mapInArrow(left, schema)
    return whole.unionByName(parts.mapInArrow(_continued(kind, True), schema)).withColumnRenamed("conv", id_col)
