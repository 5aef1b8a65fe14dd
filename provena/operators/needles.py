"""Many needles in many texts: an automaton of all needles reads each text once.

Needles go to every task in parts of a checked size; each part is a pass over the texts. A text of any
length is read in one go, whatever its words and lines, and costs its length and what is found. Where more
needles than a part are counted, they stay where they are: one pass over the texts tells which stretches of a
needle's length may be one, and these meet the needles by an equi join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of needles that go to every task at once. An automaton has about a hundred bytes for each of a needle's.
PART_BYTES = 2 << 20
#: Characters of a needle up to which it is told by the hash of a stretch of its length; longer ones are looked for by automata, in parts.
MOST_LENGTH = 64
#: Bits of the map of needles' hashes that goes to every task: sixteen a needle, between two powers of two. A fuller map costs candidates, not results.
LEAST_BITS, MOST_BITS = 20, 27
#: Characters of texts that one numpy pass takes; a longer text is a pass of its own.
SLICE_CHARS = 500_000
# The digits, one of which every number has.
_DIGITS = tuple("0123456789")


def parts(needles: DataFrame, needle: str, most: int) -> Iterator[DataFrame]:
    """Needles in parts of about so many bytes, by a hash."""
    total = needles.agg(F.sum(F.octet_length(needle) + 16)).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        yield needles.where(F.pmod(F.xxhash64(needle), F.lit(n)) == k) if n > 1 else needles


def automaton(needles: list[str]):
    """Finds needles, by their number, in (end, number) pairs over a text; a needle is named once."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, x in enumerate(needles):
        made.add_word(x, k)
    made.make_automaton()
    return made


def _once(shared, build: Callable) -> Callable:
    """What a task builds of a broadcast value, when it is asked for first."""
    made = []

    def get():
        if not made:
            made.append(build(shared.value))
        return made[0]

    return get


_word: list[np.ndarray] = []


def _is_word() -> np.ndarray:
    """Of each code point whether it is a letter, a digit, an underscore or a hyphen."""
    if not _word:
        _word.append(np.fromiter((chr(c).isalnum() or c in (0x2D, 0x5F) for c in range(0x110000)), bool, 0x110000))
    return _word[0]


def _mixed(h: np.ndarray, n: int, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185) + np.uint64(n)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _stretches(chars: np.ndarray, ends: np.ndarray, room: np.ndarray, lengths: set[int], bits: int):
    """(length, ends, places in the map) of the stretches of these lengths that end at `ends` and have room; the hash goes back from the end."""
    h = np.zeros(len(ends), np.uint64)
    for n in range(1, max(lengths) + 1):
        there = room >= n
        ends, room, h = ends[there], room[there], h[there]
        h = h * np.uint64(0x9E3779B97F4A7C15) + chars[ends - (n - 1)] + np.uint64(1)
        if n in lengths:
            yield n, ends, _mixed(h, n, bits)


def _code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts as one, its code points, and where each text ends."""
    joined = "".join(texts)
    return joined, np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64), np.cumsum([len(t) for t in texts])


def _map_of(needles: DataFrame, bits: int) -> bytes:
    """A bit for each needle's hash, made by tasks in stretches of 2 ** LEAST_BITS bits; the driver gets at most 2 ** MOST_BITS of them."""
    import pyarrow as pa

    def places(batches):
        for batch in batches:
            if batch.num_rows:
                _, chars, stops = _code_points(batch.column(0).to_pylist())
                size = np.diff(stops, prepend=0)
                for n in set(size.tolist()):
                    own = size == n
                    for _, _, at in _stretches(chars, stops[own] - 1, size[own], {n}, bits):
                        yield pa.RecordBatch.from_arrays([pa.array(at)], ["at"])

    def made(group: pa.Table) -> pa.Table:
        at = group.column("at").to_numpy()
        flags = np.zeros(1 << LEAST_BITS, np.uint8)
        flags[at & ((1 << LEAST_BITS) - 1)] = 1
        return pa.table({"part": pa.array([int(at[0]) >> LEAST_BITS], pa.int64()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    at = needles.select("needle").mapInArrow(places, "at long").distinct().withColumn("part", F.shiftright("at", LEAST_BITS))
    have = {r["part"]: r["bits"] for r in at.groupBy("part").applyInArrow(made, "part long, bits binary").collect()}
    return b"".join(bytes(have.get(k) or bytes(1 << (LEAST_BITS - 3))) for k in range(1 << (bits - LEAST_BITS)))


def _by_hash(needles: DataFrame, texts: DataFrame, whole: bool) -> DataFrame:
    """occurrences() of needles (needle) of at most MOST_LENGTH characters in texts (text), whatever their number."""
    import pyarrow as pa

    sizes = {r["length"]: r["count"] for r in needles.groupBy(F.char_length("needle").alias("length")).count().collect()}
    if not sizes:
        return needles.select("needle", F.lit(0).cast("long").alias("times"))
    lengths, bits = set(sizes), min(MOST_BITS, max(LEAST_BITS, (16 * sum(sizes.values())).bit_length()))
    shared = needles.sparkSession.sparkContext.broadcast(_map_of(needles, bits))

    def counted(some: list[str]):
        held, (joined, chars, stops) = np.frombuffer(shared.value, np.uint8), _code_points(some)
        ends = np.arange(len(chars))
        if whole:
            goes_on = np.append(_is_word()[chars[1:].astype(np.int64)], False)
            goes_on[stops - 1] = False
            ends = np.flatnonzero(~goes_on)
        starts = np.concatenate([[0], stops])
        room, times = ends + 1 - starts[np.searchsorted(stops, ends, side="right")], {}
        for n, at, place in _stretches(chars, ends, room, lengths, bits):
            last: dict[str, int] = {}
            for end in at[(held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1].tolist():
                x = joined[end + 1 - n : end + 1]
                # A stretch of a later text begins after all that ended before.
                if end - n >= last.get(x, -1):
                    last[x] = end
                    times[x] = times.get(x, 0) + 1
        return pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array(list(times.values()), pa.int64())], ["needle", "times"])

    def count(batches):
        for batch in batches:
            some, size = [], 0
            for t in batch.column(0).to_pylist():
                if t:
                    some.append(t)
                    size += len(t)
                if size >= SLICE_CHARS:
                    yield counted(some)
                    some, size = [], 0
            if some:
                yield counted(some)

    found = texts.mapInArrow(count, "needle string, times long").groupBy("needle").agg(F.sum("times").alias("times"))
    return found.join(needles, "needle", "left_semi")


def occurrences(needles: DataFrame, texts: DataFrame, needle: str, text: str, whole: bool = False) -> DataFrame:
    """(needle, times) of the needles that stand in texts, counted from left to right without overlap.

    `whole`: after an occurrence no letter, digit, underscore or hyphen may come; what comes before doesn't
    matter. Needles that stand nowhere have no row; null and empty needles stand nowhere.
    """
    import pyarrow as pa

    own = needles.select(F.col(needle).cast("string").alias("needle")).where("needle <> ''").distinct()
    spark, out = needles.sparkSession, None
    if (own.agg(F.sum(F.octet_length("needle") + 16)).first()[0] or 0) > PART_BYTES:
        own, short = own.where(F.char_length("needle") > MOST_LENGTH), own.where(F.char_length("needle") <= MOST_LENGTH)
        out = _by_hash(short, texts.select(F.col(text).cast("string").alias("text")), whole)
    for part in parts(own, "needle", PART_BYTES):
        shared = spark.sparkContext.broadcast([r["needle"] for r in part.collect()])

        def count(batches, shared=shared):
            words, times = shared.value, {}
            if not words:
                return
            made = automaton(words)
            for batch in batches:
                for t in batch.column(0):
                    t, last = t.as_py(), {}
                    for end, k in made.iter(t) if t else ():
                        after = t[end + 1 : end + 2]
                        if whole and (after.isalnum() or after in ("_", "-")) and after:
                            continue
                        if end - len(words[k]) >= last.get(k, -1):
                            last[k] = end
                            times[k] = times.get(k, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in times], pa.string()), pa.array(list(times.values()), pa.int64())], ["needle", "times"])

        found = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "needle string, times long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return own.select("needle", F.lit(0).cast("long").alias("times")).where("false").withColumnRenamed("needle", needle)
    return out.groupBy("needle").agg(F.sum("times").alias("times")).withColumnRenamed("needle", needle)


def standing(passages: DataFrame, texts: DataFrame, passage_id: str, text_id: str, passage: str, text: str, pattern: str, hole: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(passage_id, text_id) of each passage that stands in a text.

    A passage with holes also stands where `pattern` does; the longest piece between its holes leads to its
    texts, and where there is none, any digit does, as holes stand for numbers.
    """
    import pyarrow as pa

    spark, out = passages.sparkSession, None
    kind = {f.name: f.dataType for f in passages.schema}[passage_id]
    text_kind = {f.name: f.dataType for f in texts.schema}[text_id]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow, schema = (to_arrow_type(kind), to_arrow_type(text_kind)), f"p {kind.simpleString()}, t {text_kind.simpleString()}"
    rows = passages.select(F.col(passage_id).alias("p"), F.col(passage).alias("text"), F.col(pattern).alias("pattern"), F.split(F.regexp_replace(passage, hole, "\u0001"), "\u0001", -1).alias("pieces"))

    def build(rows: list) -> tuple:
        leads, of = {}, []
        for k, r in enumerate(rows):
            piece = max(r["pieces"], key=len)
            exact = r["text"] if r["pattern"] is None else None
            of.append((r["p"], exact, None if r["pattern"] is None else (r["text"], re.compile(r["pattern"]))))
            for lead in (piece,) if piece else _DIGITS:
                leads.setdefault(lead, []).append(k)
        words = list(leads)
        return automaton(words), [leads[w] for w in words], of

    for part in parts(rows, "text", part_bytes):
        get = _once(spark.sparkContext.broadcast([r.asDict() for r in part.collect()]), build)

        def find(batches, get=get):
            for batch in batches:
                made, leads, of = get()
                ps, ts = [], []
                for i, t in enumerate(batch.column(1)):
                    t = t.as_py()
                    own = {k for w in {w for _, w in made.iter(t)} for k in leads[w]} if t and of else ()
                    hit = [of[k][0] for k in own if of[k][2] is None or of[k][2][0] in t or of[k][2][1].search(t)]
                    ps += hit
                    ts += [i] * len(hit)
                yield pa.RecordBatch.from_arrays([pa.array(ps, arrow[0]), batch.column(0).take(pa.array(ts, pa.int32())).cast(arrow[1])], ["p", "t"])

        found = texts.select(F.col(text_id).alias("t"), F.col(text).alias("text")).mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select("p").where("false").join(texts.select(F.col(text_id).alias("t")).where("false"))
    return out.select(F.col("p").alias(passage_id), F.col("t").alias(text_id))

