"""N-gram Jaccard join: links documents whose sets of word shingles have a Jaccard similarity of 0.75 or more.

A size-aware heavy-light join. Shingles have one global order: those that very many documents begin with
come last, others follow their hash. Two sets that link share a shingle, and two shingles, within short
prefixes under that order. Small sets enumerate all two-element subsets of their prefix; large ones are
listed under each shingle of theirs, and the lists are scanned. The size at the boundary is the one up
to which subsets cost less, by the lists' own lengths.

Equal sets are one node from the start, named by 64 bits of a hash; where those are equal for sets that 128
bits tell apart, the other 64 are their names. A list of more than FEW sets is not paired off: its sets are
held against one pivot of like size, and once the components of all links found so far are known, only
sets of different components in a list are compared. Thus a group of thousands costs its length, and no
link between different components is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import Words, components, cut, kept_table, lowered, mixed, modest_batches, text_slices

SHINGLE = 5
#: Sets link when DEN * overlap >= NUM * union.
NUM, DEN = 75, 100
#: Up to so many sets under a signature are paired off at once.
FEW = 8
#: Shingles that begin so many sets or more come last in the order.
FREQUENT = 64
#: Bits of the least and the largest map of frequent shingles or of sets to compare; a map has sixteen for each of those, as far as that allows. Other sizes change the cost only.
MAP_BITS, MOST_BITS = 1 << 20, 1 << 29
#: Parts in which the sets of one component are dealt when they get their smallest doc_id.
SALT = 32
#: Parts by which sets are counted: sets overlap no more than the smaller counts of all parts.
PARTS = 256
#: Words of 64 bits that map a set: sets differ in no fewer shingles than their maps in bits.
MARKS = 16
#: What comparing two sets costs, as a number of signatures.
COMPARE = 6

_inside = np.ones(256, bool)
_inside[0x20] = _inside[0x09:0x0E] = False
_KEPT = lowered(_inside)
_KEPT[0] = 0xFF  # the byte 0 is part of a word; 0xFF is in no UTF-8 text

_TOP = np.uint64(1 << 63)


def _sets(batches, common=None):
    """(rows, [sorted shingles of each row]); bit 63 is set for those in the map `common`."""
    for rows, data, offsets in text_slices(batches):
        w = Words(data, offsets, _KEPT)
        at, h = w.grams(SHINGLE)
        short = np.flatnonzero((w.per_row > 0) & (w.per_row < SHINGLE))
        whole = {int(r): int(w.first_word[r]) for r in short}
        h = h >> np.uint64(1)
        if common is not None:
            h = h | (_marked(common, h).astype(np.uint64) << np.uint64(63))
        cuts = np.searchsorted(w.row[at], np.arange(rows.num_rows + 1))
        out = []
        for r in range(rows.num_rows):
            s = np.unique(h[cuts[r] : cuts[r + 1]])
            if r in whole:
                n, a = int(w.per_row[r]), whole[r]
                x = w.hash[a : a + n]
                one = mixed(np.array([n], np.uint64))
                for v in x:
                    one = mixed(one ^ v)
                s = one >> np.uint64(1)
            out.append(s)
        yield rows, out


def _marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is in a map of bits."""
    at = h % np.uint64(len(marks) * 8)
    return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _both_names(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others."""
    plain = s & ~_TOP
    a, b = mixed(plain), mixed(plain ^ np.uint64(0x5851F42D4C957F2D))
    both = np.array([a.sum(dtype=np.uint64) + np.uint64(len(s)), b.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(a) if len(s) else 0], np.uint64)
    return tuple(mixed(both).view(np.int64).tolist())


def _name(s: np.ndarray, shared: frozenset[int]) -> int:
    """The node of a set: equal for equal sets. shared: first names that different sets have."""
    first, other = _both_names(s)
    return other if first in shared else first


def need(n: int, m: int) -> int:
    """Least overlap with which sets of n and m elements link."""
    return -(-NUM * (n + m) // (NUM + DEN))


def lead(n: int) -> int:
    """How many of a set's first shingles hold one that any set it links with has among its own."""
    return n - -(-NUM * n // DEN) + 1


def lead_up(n: int) -> int:
    """The same for sets it links with that aren't smaller."""
    return n - need(n, n) + 1


def _shares(s: np.ndarray) -> bytes:
    """How many shingles fall into each of PARTS parts, 255 for that or more."""
    return np.minimum(np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def _marks(sets: list[np.ndarray]) -> np.ndarray:
    """A map of 64 * MARKS bits of each set, in MARKS words."""
    out = np.zeros((len(sets), MARKS * 64), np.uint8)
    for i, s in enumerate(sets):
        out[i, ((s >> np.uint64(20)) % np.uint64(MARKS * 64)).astype(np.int64)] = 1
    return np.packbits(out, axis=1, bitorder="little").view("<i8")


def _names(batches):
    for rows, sets in _sets(batches):
        marks, names = _marks(sets), [_both_names(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array([x[k] if x else None for x in names], pa.int64()) for k in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_shares(s) if len(s) else None for s in sets], pa.binary()), *(pa.array(marks[:, k]) for k in range(MARKS))], ["doc_id", "node", "other", "n", "shares", *(f"m{k}" for k in range(MARKS))])


def _leads(batches):
    """Shingles at the beginning of each different set of a task, with counts."""
    none: frozenset[int] = frozenset()
    seen, held, size = set(), [], 0

    def out():
        k, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "m"])

    for _, sets in _sets(batches):
        for s in sets:
            if len(s) > 1 and (name := _name(s, none)) not in seen:
                seen.add(name)
                held.append(s[: lead(len(s))])
                size += len(held[-1])
        if len(seen) > 500_000:
            seen.clear()
        if size > 2_000_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def boundary(m1: float, m2: float, most: int = 400) -> int:
    """The largest size up to which subsets of two cost less than list entries; m1, m2: sum of the lists' lengths and of their squares."""
    others = max(0.0, m2 / m1 - 1) / 2 if m1 else 0.0
    cheap = [n for n in range(2, most) if (p := lead(n) + 1) * (p - 1) / 2 <= lead(n) * (1 + COMPARE * others)]
    return max(cheap, default=1)


def _signatures(common, small: int, shared: frozenset[int]):
    """A row for each signature of each different set of a task: part, node, size, place, and whether sets no smaller find it there."""

    def run(batches):
        seen: set[int] = set()
        for _, sets in _sets(batches, common.value):
            sig, node, info, hot = [], [], [], []
            for s in sets:
                n = len(s)
                if n < 2 or (name := _name(s, shared)) in seen:
                    continue
                seen.add(name)
                p, up = lead(n), lead_up(n)
                if n <= small:
                    i, j = np.triu_indices(min(n, p + 1), 1)
                    sig.append(mixed(s[i] * np.uint64(3) + mixed(s[j])))
                    info.append((n << 32) | ((j + 1) << 2) | (j < up + 1))
                    hot.append((s[i] & s[j]) >= _TOP)
                    node.append(np.full(len(i), name))
                if n > small or DEN * n > NUM * small:
                    p = p if n > small else up
                    i = np.arange(p)
                    sig.append(mixed(s[:p]))
                    info.append((n << 32) | ((i + 1) << 2) | 2 | (i < up))
                    hot.append(s[:p] >= _TOP)
                    node.append(np.full(p, name))
            if len(seen) > 500_000:
                seen.clear()
            if sig:
                salt = np.where(np.concatenate(hot), np.concatenate(node) & 31, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(salt.astype(np.int8)), pa.array(np.concatenate(node)), pa.array(np.concatenate(info).astype(np.int64))], ["sig", "salt", "node", "info"])

    return run


def _may(a: tuple[int, int], b: tuple[int, int], small: int) -> bool:
    """Whether entries (node, info) of one signature, a no larger than b, can be the first that linked sets share."""
    n, m = a[1] >> 32, b[1] >> 32
    if DEN * n < NUM * m or not a[1] & 1 or (single := bool(a[1] & 2)) and m <= small:
        return False
    i, j = (a[1] >> 2) & 0x3FFFFFFF, (b[1] >> 2) & 0x3FFFFFFF
    return (1 if single else 2) + min(n - i, m - j) >= need(n, m)


def _pairs(small: int):
    """Of rows in order of signature, salt, place and info: pairs to compare, and all entries of lists of more than FEW sets or that are salted.

    In a long list the sets with the least before the signature come first: of near copies those that
    differ least from the others. The first of each band of sizes is the pivot of that and the next bands.
    """

    def run(batches):
        key, held, pivots, long = None, [], {}, False
        pairs, entries = set(), []

        def close():
            if not long:
                held.sort(key=lambda h: h[1] >> 32)
                pairs.update((x[0], y[0]) for i, x in enumerate(held) for y in held[i + 1 :] if _may(x, y, small))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs] + [None] * len(entries), pa.int64()), pa.array([p[1] for p in pairs] + [e[1] for e in entries], pa.int64()), pa.array([None] * len(pairs) + [e[0] for e in entries], pa.int64()), pa.array([None] * len(pairs) + [e[2] for e in entries], pa.int64())], ["a", "b", "sig", "info"])
            pairs.clear()
            entries.clear()
            return out

        def listed(s: int, v: int, f: int):
            n = f >> 32
            band = int(math.log(n) / math.log(DEN / NUM))
            pivots.setdefault(band, (v, n))
            for u, m in (pivots[k] for k in (band - 1, band, band + 1) if k in pivots):
                if u != v and DEN * min(n, m) >= NUM * max(n, m):
                    pairs.add((u, v))
            entries.append((s, v, f))

        for batch in batches:
            sig, salt, node, info = (np.asarray(batch.column(c)) for c in ("sig", "salt", "node", "info"))
            # Entries alone under their signature are most; the first and last may go on in other batches.
            same = (sig[1:] == sig[:-1]) & (salt[1:] == salt[:-1])
            keep = np.zeros(len(sig), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[[0, -1]] = True
            keep |= salt >= 0
            at = np.flatnonzero(keep)
            for s, x, v, f in zip(sig[at].tolist(), salt[at].tolist(), node[at].tolist(), info[at].tolist(), strict=True):
                if (s, x) != key:
                    close()
                    key, held, pivots, long, last = (s, x), [], {}, x >= 0, None
                if v == last:
                    continue
                last = v
                if long:
                    listed(s, v, f)
                    continue
                held.append((v, f))
                if len(held) > FEW:
                    long = True
                    for h in held:
                        listed(s, *h)
                    held = []
            if len(pairs) + len(entries) > 50_000:
                yield flush()
        close()
        if pairs or entries:
            yield flush()

    return run


def _chosen(which, whose, kind: str, shared: frozenset[int]):
    """(node, shingles) of the sets in a map, each once a task, from texts whose hashed doc_id is in another; a kind narrower than the hashes keeps their last bits."""

    def run(batches):
        seen: set[int] = set()
        own = (b.filter(pa.array(_marked(whose.value, np.asarray(b.column("who")).view(np.uint64)))) for b in batches if b.num_rows)
        for _, sets in _sets(own):
            out = []
            for s in sets:
                if len(s) > 1 and _marked(which.value, np.array([name := _name(s, shared)]).view(np.uint64))[0] and name not in seen:
                    seen.add(name)
                    out.append((name, np.sort(s.astype(kind)).tobytes()))
            if len(seen) > 500_000:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["node", "s"])

    return run


def _linked(kind: str):
    """Pairs whose overlap is what they need. Of narrow hashes a larger overlap may be counted, never a smaller one."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(int((y[at] == x).sum()) >= need(len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _possible(batches):
    """Pairs whose counts by part leave enough room for the overlap they need."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(c)), np.uint8).reshape(-1, PARTS) for c in ("x", "y"))
        n, m = np.asarray(batch.column("n")), np.asarray(batch.column("m"))
        low = np.minimum(x, y)
        most = np.where((low == 255).any(axis=1), np.minimum(n, m), low.sum(axis=1, dtype=np.int64))
        keep = most >= -(-NUM * (n + m) // (NUM + DEN))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def _size(n: int) -> int:
    """Bits of a map of n hashes."""
    return min(MOST_BITS, max(MAP_BITS, 1 << (16 * n - 1).bit_length() if n else 0))


def _at(c: str, bits: int):
    """(block, bit) of a hash in a map."""
    x = F.expr(f"`{c}` & {bits - 1}")
    return (x / 32768).cast("int"), x % 32768


def _map(rows, bits: int) -> np.ndarray:
    marks = np.zeros(bits // 8, np.uint8)
    for r in rows:
        if r["bits"] is not None:
            marks[r["at"] * 4096 : (r["at"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return marks


def _mapped(df: DataFrame, c: str, n: int):
    """The hashes of a column, about n different ones, as a broadcast map."""
    block, bit = _at(c, bits := _size(n))
    return df.sparkSession.sparkContext.broadcast(_map(df.groupBy(block.alias("at")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect(), bits))


def _verified(docs: DataFrame, shares: DataFrame, pairs: DataFrame, shared: frozenset[int]) -> DataFrame:
    """Those of the pairs (a, b) whose sets link.

    Counts by part rule out most others, 16 bits of each shingle nearly all of the rest; whole hashes
    leave the scan for what is left alone. Neither of the first two loses a link. One text of each set is
    cut up again, not its copies.
    """
    side = lambda node, n, x: shares.select(F.col("node").alias(node), F.col("n").alias(n), F.col("shares").alias(x))
    pairs = cut(pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").mapInArrow(_possible, "a long, b long"))
    for kind in ("<u2", "<u8"):
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        whose = nodes.distinct().join(shares.select("node", "who"), "node")
        n = 2 * pairs.count()
        sets = docs.select("text", F.xxhash64("doc_id").alias("who")).mapInArrow(_chosen(_mapped(nodes, "node", n), _mapped(whose, "who", n), kind, shared), "node long, s binary").dropDuplicates(["node"])
        rows = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
        pairs = cut(rows.mapInArrow(_linked(kind), "a long, b long"))
    return pairs


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the set's size and the smallest doc_id that links reach.

    Words are runs of anything but the space and the characters 9 to 13, A to Z lower-cased. Fewer words
    than a shingle's make one shingle of their own; a text that is null or has none makes an empty set,
    which links with nothing. Sets are told apart by 128 bits and shingles by 63. Rows without doc_id link
    like others; rows that repeat one are each a row. An empty table gives none.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    docs = docs.select("doc_id", "text")
    marks = [f"m{k}" for k in range(MARKS)]
    kinds = [(c, T.LongType()) for c in ("node", "other", "n")] + [("shares", T.BinaryType())] + [(c, T.LongType()) for c in marks]
    named = kept_table(docs.mapInArrow(_names, T.StructType([docs.schema["doc_id"], *(T.StructField(c, k) for c, k in kinds)])), "sets")
    # First names of different sets: of 10 ** 10 documents, two or three are expected.
    clash = named.where("node is not null").groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y")
    shared = frozenset(r[0] for r in clash.select("node").collect())
    if shared:
        named = named.withColumn("node", F.when(F.col("node").isin([*shared]), F.col("other")).otherwise(F.col("node")))
    # who: the hashed doc_id of one text that has the set.
    shares = kept_table(named.where("node is not null").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "shares", *marks)], F.min(F.xxhash64("doc_id")).alias("who")), "shares")

    begun = shares.agg(F.sum(F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1)).first()[0] or 0
    bits = _size(int(begun) // FREQUENT)
    counts = docs.select("text").mapInArrow(_leads, "k long, m long").groupBy("k").agg(F.sum("m").alias("m"))
    (block, bit), often = _at("k", bits), F.col("m") >= FREQUENT
    found = counts.groupBy(block.alias("at")).agg(F.bitmap_construct_agg(F.when(often, bit)).alias("bits"), F.sum(F.when(~often, F.col("m"))).alias("m1"), F.sum(F.when(~often, F.col("m") * F.col("m"))).alias("m2")).collect()
    small = boundary(sum(r["m1"] or 0 for r in found), sum(r["m2"] or 0 for r in found))
    common = spark.sparkContext.broadcast(_map(found, bits))

    entries = docs.select("text").mapInArrow(_signatures(common, small, shared), "sig long, salt byte, node long, info long")
    place = lambda c: F.shiftright(c, 2).bitwiseAND(F.lit(0x3FFFFFFF))
    lists = entries.repartition("sig", "salt").sortWithinPartitions("sig", "salt", place("info"), "info", "node")
    scanned = cut(lists.mapInArrow(_pairs(small), "a long, b long, sig long, info long"))
    first = scanned.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _verified(docs, shares, first, shared)

    so_far = components(links).withColumnRenamed("node", "b")
    listed = scanned.where("sig is not null").select("sig", "b", "info").distinct().join(so_far, "b", "left").select("sig", "b", "info", F.coalesce("component", "b").alias("c"))
    several = listed.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("sig")
    # A signature may list a third of all sets: which lists go on is told to them in parts.
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    listed = listed.withColumn("salt", F.pmod("b", F.lit(SALT)).cast("int")).join(several, ["sig", "salt"], "left_semi").drop("salt").join(shares.select(F.col("node").alias("b"), *marks), "b")
    size = lambda c: F.shiftright(c, 32)
    p, q = F.col("p"), F.col("q")
    single = p.bitwiseAND(F.lit(2)) != 0
    could = (
        (DEN * size(p) >= NUM * size(q)) & (size(p) <= size(q)) & (p.bitwiseAND(F.lit(1)) != 0) & (~single | (size(q) > small))
        & (F.when(single, 1).otherwise(2) + F.least(size(p) - place(p), size(q) - place(q)) >= F.ceil(F.lit(NUM) * (size(p) + size(q)) / (NUM + DEN)))
    )
    differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"_{m}"))) for m in marks), F.lit(0))
    close = size(p) + size(q) - differ >= 2 * F.ceil(F.lit(NUM) * (size(p) + size(q)) / (NUM + DEN))
    # Sets that link are of one band of sizes or of neighbouring ones, so a list falls into bands before it is paired.
    band = lambda c: F.floor(F.log(size(c).cast("double")) / math.log(DEN / NUM) + 1e-9).cast("int")
    one = listed.select("sig", band(F.col("info")).alias("band"), F.col("b").alias("a"), F.col("info").alias("p"), F.col("c").alias("ca"), *marks)
    other = listed.select("sig", F.explode(F.array(band(F.col("info")) - 1, band(F.col("info")))).alias("band"), "b", F.col("info").alias("q"), F.col("c").alias("cb"), *[F.col(m).alias(f"_{m}") for m in marks])
    across = one.join(other, (one["sig"] == other["sig"]) & (one["band"] == other["band"]) & (F.col("ca") != F.col("cb")) & could & close)
    rest = cut(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if rest.isEmpty():
        whole = so_far.withColumnRenamed("b", "node")
    else:
        whole = components(links.unionByName(_verified(docs, shares, rest, shared)))

    lows = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    # A component may hold a third of all sets: its smallest doc_id goes back to it in parts.
    own = cut(lows.join(whole, "node").withColumn("salt", F.pmod("node", F.lit(SALT)).cast("int")))
    lowest = own.groupBy("component").agg(F.min("low").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    linked = own.join(lowest, ["component", "salt"]).select("node", "component_id")
    ids = lows.join(linked, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    return named.join(ids, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked documents, that of the smallest doc_id; rows without words all stay.

    Rows that repeat a doc_id are one document: one of them stays.
    """
    found = cut(groups(docs))
    kept = found.where((F.col("doc_id") == F.col("component_id")) | F.col("doc_id").isNull())
    out = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    if not kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
    return out.select(docs.columns)
