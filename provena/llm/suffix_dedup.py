"""Suffix-array deduplication: bytes in a 50-byte string that a document with a smaller doc_id has too go.

No 50-byte string is without an anchor: a place whose next GRAM bytes have the least hash among those of
some run of places. An anchor's context is all that the 50-byte strings around it span. Contexts that
are equal settle most anchors. Where documents share an anchor but not its context, the suffixes that
begin up to an anchor are sorted, deep and shallow: by words to a shallow depth, and groups whose common
prefix goes on by blind tries. Suffixes with a common prefix of 50 bytes lie side by side then.

An anchor that a task finds in many contexts (a common line in different surroundings, a text that
repeats itself) would bring them all to one task. It is hot: its strings travel instead, by their own
hashes, after each task has kept the least document of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import _BYTE_KEYS, fresh, kept_table, mixed, modest_batches, named, range_hashes, text_slices, without

LENGTH = 50
GRAM = 20
#: Before and after an anchor's place, what the strings around it span.
BEFORE, AFTER = LENGTH - GRAM, LENGTH
#: Bytes that the sort by words looks at before blind tries take over.
SHALLOW = 48
#: Contexts of one anchor that are sorted together; the strings of an anchor with more are grouped by their hashes over the cluster.
MOST_TOGETHER = 20_000
#: Anchors that a task holds to settle among its own documents, and rows left of one of them from which it is hot.
HELD = 300_000
HOT = 64
#: Bytes of text of which only the least document's strings and contexts go on.
PASS_BYTES = 1_000_000
#: Rows that wait for the rest of their anchor.
WAITING = 400_000
#: Bits of the largest map of anchors that goes to every task; the maps grow with what is in them. Beyond it, contexts are joined with the anchors instead.
MAP_BITS = 1 << 29


def _least(h: np.ndarray, w: int, f) -> np.ndarray:
    """f over each run of w elements."""
    span = 1
    while span * 2 <= w:
        h = f(h[:-span], h[span:])
        span *= 2
    return f(h[: len(h) - (w - span)], h[w - span :]) if w > span else h


def _anchors(data: np.ndarray, offsets: np.ndarray):
    """Of texts that lie one after the other: (row, place, hash) of the anchors, in order, and the hash of the anchor that each place's 50-byte string is known by, its least."""
    n, w = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    at = np.arange(n - GRAM + 1)
    h = range_hashes(_BYTE_KEYS[data], at, at + GRAM)
    for end in offsets[1:-1]:
        h[max(0, end - GRAM + 1) : end] = np.uint64(0xFFFFFFFFFFFFFFFF)
    pad = np.full(w - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    low = _least(np.concatenate([pad, h, pad]), w, np.minimum)
    place = np.flatnonzero(_least(low, w, np.maximum) == h)
    row = np.searchsorted(offsets, place, side="right") - 1
    fits = (offsets[row + 1] - offsets[row] >= LENGTH) & (place + GRAM <= offsets[row + 1])
    return row[fits], place[fits], h[place[fits]], low[w - 1 :]


def _contexts(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, place: np.ndarray):
    lo, hi = np.maximum(offsets[row], place - BEFORE), np.minimum(offsets[row + 1], place + AFTER)
    return lo, hi


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Intervals of each document, those that touch as one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    # A document's intervals are all that long at most, so a running maximum by document needs no loop.
    base = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) * (1 << 40) if len(doc) else np.zeros(0, np.int64)
    reach = np.maximum.accumulate(base + hi)
    new = np.ones(len(doc), bool)
    new[1:] = base[1:] + lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1 if len(first) else first
    return doc[first], lo[first], (reach - base)[last]


_CONTEXT, _KNOWN, _IS_HOT = 0, 1, 2
_FOUND = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("kind", pa.int8())])


def _firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    first = np.ones(len(sorted_columns[0]), bool)
    first[1:] = False
    for c in sorted_columns:
        first[1:] |= c[1:] != c[:-1]
    return first


def _least_of(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row the least doc among the rows of its name."""
    order = np.lexsort((doc, name))
    first = _firsts(name[order])
    out = np.empty(len(doc), np.int64)
    out[order] = doc[order][np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
    return out


def _placed(batches):
    """Rows (hash of the anchor, hash of the context, doc, context of n bytes from lo, kind). What a task can settle alone is known: n bytes from lo are covered. Of a hot anchor nothing but that it is hot goes on."""
    held, size = [], 0

    def out():
        h, ctx, doc, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
        gone = doc > _least_of(mixed(h * np.uint64(3) + ctx), doc)
        rest = np.flatnonzero(~gone)
        keys, times = np.unique(h[rest], return_counts=True)
        hot = keys[times > HOT]
        if len(hot):
            rest = rest[~np.isin(h[rest], hot)]
        cd, cl, ch = _merged(doc[gone], lo[gone], hi[gone])
        none, some = np.zeros(len(cd), np.int64), np.zeros(len(hot), np.int64)
        cols = [np.concatenate(x) for x in ((h[rest].view(np.int64), cd, hot.view(np.int64)), (ctx[rest].view(np.int64), none, some), (doc[rest], cd, some), (lo[rest], cl, some), (hi[rest] - lo[rest], ch - cl, some))]
        kind = np.repeat([_CONTEXT, _KNOWN, _IS_HOT], [len(rest), len(cd), len(hot)])
        return pa.RecordBatch.from_arrays([*map(pa.array, cols[:4]), pa.array(cols[4].astype(np.int32)), pa.array(kind.astype(np.int8))], schema=_FOUND)

    for rows, data, offsets in text_slices(batches):
        row, place, h, _ = _anchors(data, offsets)
        if not len(row):
            continue
        lo, hi = _contexts(data, offsets, row, place)
        ctx = range_hashes(_BYTE_KEYS[data], lo, hi)
        ids = np.asarray(rows.column("doc_id"))
        held.append((h, ctx, ids[row], lo - offsets[row], hi - offsets[row]))
        size += len(row)
        if size > HELD:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _settled(batches):
    """Of rows in order of anchor, context and doc: what is covered for certain, and (with key) the anchors whose bytes must be looked at, and which of them are hot."""

    def work(t):
        key, ctx, doc, lo, n, kind = (np.asarray(t.column(c).combine_chunks()) for c in ("key", "ctx", "doc", "lo", "n", "kind"))
        hi, real = lo + n, kind == _CONTEXT
        new_key, new_ctx = _firsts(key), _firsts(key, ctx)
        k, starts = np.cumsum(new_key) - 1, np.flatnonzero(new_key)
        low = np.minimum.reduceat(np.where(real, doc, np.iinfo(np.int64).max), starts)
        top = np.maximum.reduceat(np.where(real, doc, np.iinfo(np.int64).min), starts)
        least = doc[np.flatnonzero(new_ctx)][np.cumsum(new_ctx) - 1]
        covered = (kind == _KNOWN) | (real & (doc > least))
        ask = np.zeros(len(starts), bool)
        ask[k[real & ~covered & (doc > low[k])]] = True
        ask &= top > low
        hot = np.bincount(k[real], minlength=len(starts)) > MOST_TOGETHER
        hot[k[kind == _IS_HOT]] = True
        ask |= hot
        cd, cl, ch = _merged(doc[covered], lo[covered], hi[covered])
        asked = key[starts[ask]]
        none, head = np.zeros(len(asked), np.int64), np.arange(len(cd) + len(asked)) < len(cd)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(len(cd), np.int64), asked]), mask=head), pa.array(np.concatenate([np.zeros(len(cd), bool), hot[ask]]), mask=head), *(pa.array(np.concatenate([x, none])) for x in (cd, cl, ch))], ["key", "hot", "doc", "lo", "hi"])

    held, size = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < WAITING // 4:
            continue
        t = pa.concat_tables(held).combine_chunks()
        key = np.asarray(t.column("key").combine_chunks())
        end = int(np.searchsorted(key, key[-1]))
        if end == 0 and size < WAITING:
            continue
        # An anchor of so many rows is hot: what its contexts cover is found by their strings, so it may be divided here.
        end = end or len(key)
        yield work(t.slice(0, end))
        held, size = [t.slice(end)], t.num_rows - end
    if size:
        yield work(pa.concat_tables(held).combine_chunks())


_NEAR = ["key", "ctx", "doc", "lo", "hi", "before", "bytes"]
_STRING, _COVER = -1, -2


def _strings_of(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, place: np.ndarray, ids: np.ndarray, burns) -> pa.RecordBatch:
    """The 50-byte strings around these anchors that are known by a hot one: (h1, h2, doc, lo, hi), one row for all places of a string in a doc that touch; what a smaller doc of these rows has is covered."""
    first, last = np.maximum(offsets[row], place + GRAM - LENGTH), np.minimum(place, offsets[row + 1] - LENGTH)
    step = np.zeros(len(data) + 2, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last + 1, -1)
    at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    # A string that is known by another anchor is found by that one's contexts, or as a string of its own.
    at = at[burns(at)]
    keys = _BYTE_KEYS[data]
    h1, h2 = range_hashes(keys, at, at + LENGTH), range_hashes(mixed(keys), at, at + LENGTH)
    of = np.searchsorted(offsets, at, side="right") - 1
    doc, lo = ids[of], at - offsets[of]
    both = h1 ^ mixed(h2)
    gone = doc > _least_of(both, doc)
    cd, cl, ch = _merged(doc[gone], lo[gone], lo[gone] + LENGTH)
    rest = np.flatnonzero(~gone)
    # Places of one string in one doc, as merged intervals.
    rest = rest[np.lexsort((doc[rest], both[rest]))]
    group = np.cumsum(_firsts(both[rest], doc[rest])) - 1 if len(rest) else rest
    name, sl, sh = _merged(group, lo[rest], lo[rest] + LENGTH)
    own = rest[np.searchsorted(group, name)]
    none = np.zeros(len(cd), np.int64)
    cols = [np.concatenate(x) for x in ((h1[own].view(np.int64), cd), (h2[own].view(np.int64), none), (doc[own], cd), (sl, cl), (sh, ch))]
    before = np.repeat(np.array([_STRING, _COVER], np.int32), [len(own), len(cd)])
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(before), pa.nulls(len(before), pa.binary())], _NEAR)


def _wanted(which, hot=None):
    """Anchors in a map of hashes (None: all), with their contexts' bytes; of those in the map of hot ones, the strings by their hashes."""

    def run(batches):
        for rows, data, offsets in text_slices(batches, most=PASS_BYTES):
            row, place, h, known_by = _anchors(data, offsets)
            ids = np.asarray(rows.column("doc_id"))
            burns = _marked(hot.value, h) if hot is not None else np.zeros(len(h), bool)
            if burns.any():
                yield _strings_of(data, offsets, row[burns], place[burns], ids, lambda at: _marked(hot.value, known_by[at]))
            own = np.flatnonzero(~burns & (_marked(which.value, h) if which is not None else True))
            if not len(own):
                continue
            row, place, h = row[own], place[own], h[own]
            lo, hi = _contexts(data, offsets, row, place)
            ctx = range_hashes(_BYTE_KEYS[data], lo, hi)
            # A context that a smaller doc has is covered already.
            own = np.flatnonzero(ids[row] == _least_of(mixed(h * np.uint64(3) + ctx), ids[row]))
            row, place, h, lo, hi, ctx = (x[own] for x in (row, place, h, lo, hi, ctx))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(ids[row]), pa.array(lo - offsets[row]), pa.array(hi - offsets[row]), pa.array((place - lo).astype(np.int32)), pa.array([raw[a:b] for a, b in zip(lo, hi, strict=True)], pa.binary())], _NEAR)

    return run


def _marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % np.uint64(len(marks) * 8)
    return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def blind_trie(rows: np.ndarray) -> tuple[list[int], list[int]]:
    """(order, common prefix of each with the one before it) of byte strings of one length.

    Each string goes down by the bytes at branching places alone to some leaf; one comparison with that
    leaf tells where it leaves the trie, and it is hung in there.
    """
    width = rows.shape[1]
    root: list = [width, {}, [0]]  # [place at which it branches, byte -> node, strings that are equal up to there]
    for i in range(1, len(rows)):
        s, node = rows[i], root
        while node[0] < width:
            node = node[1].get(int(s[node[0]])) or next(iter(node[1].values()))
        differ = np.flatnonzero(rows[node[2][0]] != s)
        at = int(differ[0]) if len(differ) else width
        other = int(rows[node[2][0]][at]) if at < width else 0
        node = root
        while node[0] < at:
            node = node[1][int(s[node[0]])]
        if at == width:
            node[2].append(i)
        elif node[0] == at:
            node[1][int(s[at])] = [width, {}, [i]]
        else:
            node[1], node[2], node[0] = {other: [node[0], node[1], node[2]], int(s[at]): [width, {}, [i]]}, [], at
    order, common, todo = [], [], [(root, 0)]
    while todo:
        node, shared = todo.pop()
        if node[0] == width:
            order += node[2]
            common += [shared] + [width] * (len(node[2]) - 1)
        else:
            todo += [(child, node[0] if k else shared) for k, (_, child) in reversed(list(enumerate(sorted(node[1].items()))))]
    return order, common


def deep_shallow(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): rows, byte strings of one length, in order within the groups they come in, and a number that equal ones of a group share.

    Shallow: groups are divided by one 8-byte word after the other, all groups at once, and a string
    alone in its group is done. Deep: groups still together at SHALLOW bytes, where a longer common
    prefix is likely, are put in order by blind tries unless all of their strings are equal.
    """
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order, group = np.arange(n), group.astype(np.int64)
    active = np.arange(n)  # places in order whose group has several strings
    for d in range(min(SHALLOW // 8, words.shape[1])):
        if not len(active):
            break
        own, g = order[active], group[active]
        by = np.lexsort((words[own, d], g))
        own, g = own[by], g[by]
        order[active] = own
        w = words[own, d]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])])
        first = np.flatnonzero(new)
        group[active] = active[first[np.cumsum(new) - 1]]  # a group is named by its first place
        size = np.diff(np.concatenate([first, [len(active)]]))
        active = active[np.repeat(size > 1, size)]
    if len(active):
        g = group[active]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.concatenate([first, [len(active)]]))
        head = np.repeat(order[active[first]], size)
        differs = np.add.reduceat((words[order[active]] != words[head]).any(axis=1), first) > 0
        for a, k in zip(first[differs].tolist(), size[differs].tolist(), strict=True):
            places = active[a : a + k]
            own = order[places]
            tails = np.ascontiguousarray(rows[own][:, SHALLOW:])
            _, one, which = np.unique(tails.view(np.dtype((np.void, tails.shape[1]))).ravel(), return_index=True, return_inverse=True)
            by, _ = blind_trie(tails[one])
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            at = np.argsort(rank[which], kind="stable")
            order[places] = own[at]
            r = rank[which][at]
            group[places] = places[np.searchsorted(r, r)]
    return order, group


def _rows(data: np.ndarray, at: np.ndarray, n: np.ndarray, step: int, width: int) -> np.ndarray:
    """width bytes from each place on, forwards or backwards, zeros where n bytes are over."""
    k, out = np.arange(width), np.zeros((len(at), width), np.uint8)
    for a in range(0, len(at), 20_000):
        some = data[np.clip(at[a : a + 20_000, None] + step * k, 0, max(0, len(data) - 1))]
        out[a : a + 20_000] = np.where(k < n[a : a + 20_000, None], some, 0)
    return out


def _shared(rows: np.ndarray, n: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The longest prefix that each string has in common with another of its run: in order of suffixes, with one next to it."""
    order, _ = deep_shallow(rows, run)
    a, b = order[:-1], order[1:]
    differ = rows[a] != rows[b]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common = np.minimum(common, np.minimum(n[a], n[b])) * (run[a] == run[b])
    out = np.zeros(len(rows), np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


class _Contexts:
    """Contexts of whole runs of anchors, in order of anchor and doc."""

    def __init__(self, rows: pa.Table):
        col = rows.column("bytes").combine_chunks()
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        self.data, self.start = np.frombuffer(col.buffers()[2], np.uint8), ends[:-1]
        self.n = np.diff(ends)
        key, self.doc, self.lo, self.before = (np.asarray(rows.column(c).combine_chunks()).astype(np.int64) for c in ("key", "doc", "lo", "before"))
        self.run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        self.run = np.searchsorted(self.run, self.run)  # a run is named by its first place

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """(context, start in it) of all its 50-byte strings around the anchor."""
        first = np.maximum(0, self.before + GRAM - LENGTH)
        count = np.maximum(0, np.minimum(self.before, self.n - LENGTH) - first + 1)
        of = np.repeat(np.arange(len(self.n)), count)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]


_COMPARED = ["h1", "h2", "doc", "lo", "hi"]


def _sorted_out(rows: pa.Table) -> pa.RecordBatch:
    """What is covered by strings that stand in a smaller doc of the same run."""
    c = _Contexts(rows)
    at = c.start + c.before
    right = _shared(_rows(c.data, at, c.n - c.before, 1, AFTER), c.n - c.before, c.run)
    left = _shared(_rows(c.data, at - 1, c.before, -1, BEFORE), c.before, c.run)
    view = np.lib.stride_tricks.sliding_window_view(c.data, LENGTH)
    held = []
    # Equal strings have the anchor at the same place in them, so each place is a sort of its own.
    for k in range(BEFORE + 1):
        own = np.flatnonzero((left >= k) & (right >= LENGTH - k))
        if len(own) < 2:
            continue
        order, group = deep_shallow(view[c.start[own] + c.before[own] - k], np.searchsorted(c.run[own], c.run[own]))
        doc = c.doc[own]
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, group, doc[order])
        gone = own[order[doc[order] > least[group]]]
        held.append((c.doc[gone], (c.lo + c.before)[gone] - k))
    d, lo = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
    d, lo, hi = _merged(d, lo, lo + LENGTH)
    none = np.zeros(len(d), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(none, mask=none == 0), pa.array(none), *map(pa.array, (d, lo, hi))], _COMPARED)


def _hashed(rows: pa.Table) -> pa.RecordBatch:
    """All strings, as hashes."""
    c = _Contexts(rows)
    of, start = c.strings()
    at, keys = c.start[of] + start, _BYTE_KEYS[c.data]
    h1, h2 = range_hashes(keys, at, at + LENGTH), range_hashes(mixed(keys), at, at + LENGTH)
    doc, lo = c.doc[of], c.lo[of] + start
    # A string that a smaller doc has among these very rows is settled here.
    order = np.lexsort((doc, h1 ^ mixed(h2)))
    h = (h1 ^ mixed(h2))[order]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0))
    gone = doc[order] > doc[order][first]
    d, a, b = _merged(doc[order[gone]], lo[order[gone]], lo[order[gone]] + LENGTH)
    rest = order[~gone]
    none = np.arange(len(rest) + len(d)) >= len(rest)
    both = [np.concatenate([x[rest].view(np.int64), np.zeros(len(d), np.int64)]) for x in (h1, h2)]
    return pa.RecordBatch.from_arrays([*(pa.array(x, mask=none) for x in both), *(pa.array(np.concatenate(x)) for x in ((doc[rest], d), (lo[rest], a), (lo[rest] + LENGTH, b)))], _COMPARED)


def _compared(batches, most: int = MOST_TOGETHER, together: int = 20_000):
    """Of strings by hash, then contexts by anchor, in order of those and of doc: covered intervals; a run of more than `most` contexts goes on as hashes of its strings."""
    held, size, wait, large = [], 0, together, None
    string = None  # (h1, h2, least doc) of the string that the last batch ended in

    def pieces(t, key):
        """Yields what is complete, and last what must wait."""
        nonlocal large
        if large is not None:
            end = int(np.searchsorted(key, large, side="right"))
            for a in range(0, end, 10_000):
                yield _hashed(t.slice(a, min(10_000, end - a)))
            t, key = t.slice(end), key[end:]
            if len(key):
                large = None
        yield t

    def covered(batch):
        nonlocal string
        key, ctx, doc, lo, hi, before = (np.asarray(batch.column(c)) for c in _NEAR[:-1])
        first = _firsts(key, ctx)
        if string is not None and (key[0], ctx[0]) == string[:2]:
            first[0] = False
        at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        least = np.where(at >= 0, doc[at], string[2] if string is not None else 0)
        string = (key[-1], ctx[-1], least[-1])
        gone = (before == _COVER) | (doc > least)
        d, a, b = _merged(doc[gone], lo[gone], hi[gone])
        none = np.zeros(len(d), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(none, mask=none == 0), pa.array(none), *map(pa.array, (d, a, b))], _COMPARED)

    last = None
    for batch in batches:
        if (n := batch.column("bytes").null_count) and batch.num_rows:
            yield covered(batch.slice(0, n))
            batch = batch.slice(n)
        if not batch.num_rows:
            continue
        # Equal contexts in larger docs are settled already: the first of each is all that others need.
        key, ctx, doc = (np.asarray(batch.column(c)) for c in ("key", "ctx", "doc"))
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]) | (doc[1:] == doc[:-1])
        first[0] = last is None or (key[0], ctx[0]) != last[:2] or doc[0] == last[2]
        last = (key[-1], ctx[-1], doc[-1])
        held.append(pa.Table.from_batches([batch.filter(pa.array(first))]))
        size += int(first.sum())
        if size < wait:
            continue
        t = pa.concat_tables(held)
        *done, t = pieces(t, np.asarray(t.column("key").combine_chunks()))
        yield from done
        key = np.asarray(t.column("key").combine_chunks())
        end = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if end:
            yield _sorted_out(t.slice(0, end))
            t = t.slice(end)
        elif len(key) > most:
            large = key[0]
            *done, t = pieces(t, key)
            yield from done
        held, size = [t], t.num_rows
        wait = max(together, min(2 * size, most + 1))
    if size:
        t = pa.concat_tables(held)
        *done, t = pieces(t, np.asarray(t.column("key").combine_chunks()))
        yield from done
        if t.num_rows:
            yield _sorted_out(t)


def _map(spark, keys: DataFrame, most: int):
    """A broadcast map of bits of these hashes with room for sixteen for each, up to `most` bits (a power of two); None if there are none."""
    n = keys.count()
    if not n:
        return None
    bits = max(1 << 20, min(most, 1 << (16 * n - 1).bit_length()))
    x = F.expr(f"key & {bits - 1}")
    found = keys.groupBy((x / 32768).cast("int").alias("at")).agg(F.bitmap_construct_agg(x % 32768).alias("bits")).collect()
    marks = np.zeros(bits // 8, np.uint8)
    for r in found:
        marks[r["at"] * 4096 : (r["at"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return spark.sparkContext.broadcast(marks)


def covered(docs: DataFrame, most_bits: int = MAP_BITS) -> DataFrame:
    """(doc, lo, hi): bytes from lo to hi are in 50-byte strings that a document with a smaller doc_id has; intervals may overlap."""
    spark = docs.sparkSession
    modest_batches(spark)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") >= LENGTH)
    found = docs.mapInArrow(_placed, "key long, ctx long, doc long, lo long, n int, kind byte")
    lists = found.repartition("key").sortWithinPartitions("key", "ctx", "doc")
    settled = kept_table(lists.mapInArrow(_settled, "key long, hot boolean, doc long, lo long, hi long"), "settled")
    done, asked = settled.where("key is null").select("doc", "lo", "hi"), settled.where("key is not null")
    few = asked.count() * 8 <= most_bits
    which = _map(spark, asked, most_bits) if few else None
    if few and which is None:
        return done
    # What this map has besides hot anchors goes as strings too, which changes nothing but the cost.
    near = docs.mapInArrow(_wanted(which, _map(spark, asked.where("hot"), min(most_bits, 1 << 26))), "key long, ctx long, doc long, lo long, hi long, before int, bytes binary")
    if not few:
        near = near.join(asked.select("key").distinct(), "key", "left_semi").unionByName(near.where("before < 0"))
    near = near.repartition("key").sortWithinPartitions(F.col("bytes").isNotNull(), "key", "ctx", "doc")
    compared = kept_table(near.mapInArrow(_compared, "h1 long, h2 long, doc long, lo long, hi long"), "compared")
    strings = compared.where("h1 is not null")
    least = strings.groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    again = strings.join(least, ["h1", "h2"]).where("doc > least").select("doc", "lo", "hi")
    return done.unionByName(compared.where("h1 is null").select("doc", "lo", "hi")).unionByName(again)


def remove_repeats(docs: DataFrame, most_bits: int = MAP_BITS) -> DataFrame:
    """docs with `spans` (removed runs of bytes, as longs lo << 32 | hi) and `kept` (the other bytes, in order), which replace columns of those names.

    A null text has no bytes. Documents under 50 bytes, and rows without doc_id, lose nothing and take
    nothing from others. Rows that repeat a doc_id are one document. `kept` may end a character early.
    doc_id must be a whole number. Other columns stay, whatever their names.
    """
    frame = without(docs, "spans", "kept")
    names = frame.columns
    cover, doc = fresh(frame, "cover", "doc")
    code = F.shiftleft(F.col("lo"), 32).bitwiseOR(F.col("hi"))
    by_doc = covered(docs, most_bits).groupBy(F.col("doc").alias(doc)).agg(F.collect_list(code).alias(cover))
    frame = frame.join(by_doc, F.col("doc_id") == F.col(doc), "left").select(*named(names), cover)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices([batch]):
                raw, spans, kept = data.tobytes(), [], []
                for i, found in enumerate(rows.column(cover)):
                    own = raw[offsets[i] : offsets[i + 1]]
                    if not found.is_valid:
                        spans.append([])
                        kept.append(own)
                        continue
                    x = np.asarray(found.values)
                    _, lo, hi = _merged(np.zeros(len(x), np.int64), x >> 32, x & 0xFFFFFFFF)
                    spans.append(((lo << 32) | hi).tolist())
                    ends = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(own)]
                    kept.append(b"".join(own[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], [*names, "spans", "kept"])

    schema = T.StructType([*docs.select(*named(names)).schema, T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType())])
    return frame.mapInArrow(run, schema)


def report(docs: DataFrame, most_bits: int = MAP_BITS) -> DataFrame:
    """Per document: its bytes, those removed, the runs they make, and a digest of the rest."""
    out = remove_repeats(docs.select("doc_id", "text"), most_bits)
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
