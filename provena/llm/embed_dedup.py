"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are projected on leading principal dimensions and ordered by the cells of a grid as wide as
the distance that the least cosine allows, label by label. Runs of that order are blocks with a bounding
box. Blocks that come near by the cells of two dimensions and whose boxes are near by all leading ones
meet in one task, which halves both again and again, skips what the boxes prove distant, and multiplies
what is left in double precision. A block is sent once for each set of blocks that come to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import components, cut, modest_batches

LEAST_COSINE = 0.98
#: Vectors in a block; a pair of blocks is what one row brings to a task.
BLOCK = 512
LEAF = 64
#: Leading dimensions in boxes, and those of them that order the grid.
LEADING, ORDERED = 16, 4
#: Sets in which the blocks that come to one block are dealt, by their number.
SPREAD = 8
#: The principal dimensions are fitted on at most so many vectors; any basis gives the same links.
BASIS_SAMPLE = 20_000


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = np.asarray(col.flatten(), np.float64)
    return flat.reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    by_size: dict[int, list] = {}
    draw = F.pmod(F.xxhash64("rep", F.lit("basis")), F.lit(1 << 40)) / (1 << 40)
    n = vectors.count()
    for (v,) in vectors.where(draw < 0.8 * BASIS_SAMPLE / max(1, n)).select("vec").limit(BASIS_SAMPLE).collect():
        by_size.setdefault(len(v), []).append(v)
    out = {}
    for size, rows in by_size.items():
        x = _unit(np.array(rows, np.float64))
        _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=len(x) < size)
        out[size] = vt[:LEADING]
    return out


def _leading(x: np.ndarray, bases: dict[int, np.ndarray]) -> np.ndarray:
    basis = bases.get(x.shape[1])
    p = x[:, :LEADING] if basis is None else x @ basis.T
    return np.pad(p, ((0, 0), (0, LEADING - p.shape[1])))


def _ordered(bases, width: float):
    """Adds each vector's grid cells."""

    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            cells = np.zeros((batch.num_rows, ORDERED), np.int32)
            for s in np.unique(sizes):
                own = np.flatnonzero(sizes == s)
                x = _matrix(batch.column("vec").take(pa.array(own)))
                cells[own] = np.floor(_leading(_unit(x), bases.value)[:, :ORDERED] / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, k]) for k in range(ORDERED))], [*batch.schema.names, *(f"c{k}" for k in range(ORDERED))])

    return run


def _packed(bases, kind: str):
    """Consecutive vectors of a label and size as blocks with their box; vectors in the kind of number that they came in."""

    def block(part: pa.Table, n: int) -> dict:
        x = _matrix(part.column("vec").combine_chunks())
        p = _leading(_unit(x), bases.value)
        first = part.slice(0, 1).to_pylist()[0]
        return {"label": first["label"], "size": first["size"], "lo": p.min(axis=0).tolist(), "hi": p.max(axis=0).tolist(), "ids": np.asarray(part.column("rep")).astype("<i8").tobytes(), "times": np.asarray(part.column("times")).astype("<i8").tobytes(), "x": x.astype(kind).tobytes()}

    schema = pa.schema([("label", pa.string()), ("size", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("times", pa.binary()), ("x", pa.binary())])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            labels, sizes = t.column("label").to_numpy(zero_copy_only=False), np.asarray(t.column("size"))
            ends = [*(np.flatnonzero((labels[1:] != labels[:-1]) | (sizes[1:] != sizes[:-1])) + 1), len(t)]
            out, at = [], 0
            for end in ends:
                while end - at >= BLOCK or at < end < len(t):
                    out.append(block(t.slice(at, min(BLOCK, end - at)), len(out)))
                    at += min(BLOCK, end - at)
            rest = t.slice(at) if at < len(t) else None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if rest is not None:
            yield pa.RecordBatch.from_pylist([block(rest, 0)], schema=schema)

    return run


def _boxes(p: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The box of each interval that halving makes."""
    out, todo = {}, [(0, len(p))]
    while todo:
        a, b = todo.pop()
        out[a, b] = (p[a:b].min(axis=0), p[a:b].max(axis=0))
        if b - a > LEAF:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def _near(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, ux: np.ndarray, uy: np.ndarray, same: bool, least: float) -> np.ndarray:
    """Which rows of x and y link, by joining intervals recursively."""
    bx, by, most = _boxes(px), _boxes(py), 2 - 2 * least + 1e-9
    out, todo = np.zeros((len(x), len(y)), bool), [((0, len(x)), (0, len(y)))]
    while todo:
        i, j = todo.pop()
        if same and i[0] > j[0]:
            continue
        (alo, ahi), (blo, bhi) = bx[i], by[j]
        gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
        if gap @ gap > most:
            continue
        if max(i[1] - i[0], j[1] - j[0]) > LEAF:
            halves = [[(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > LEAF else [(a, b)] for a, b in (i, j)]
            todo += [(u, v) for u in halves[0] for v in halves[1]]
            continue
        c = ux[i[0] : i[1]] @ uy[j[0] : j[1]].T
        for a, b in zip(*np.nonzero(np.abs(c - least) < 1e-10), strict=True):
            u, v = x[i[0] + a], y[j[0] + b]
            c[a, b] = (u @ v) / (np.sqrt(u @ u) * np.sqrt(v @ v))
        out[i[0] : i[1], j[0] : j[1]] = c >= least
        if same:
            out[j[0] : j[1], i[0] : i[1]] = out[i[0] : i[1], j[0] : j[1]].T
    if same:
        np.fill_diagonal(out, False)
    return out


def _joined(bases, least: float, kind: str):
    """Of rows in order of block a and set, a's own first: how often each vector links, and each linked vector's smallest partner in the pair's own components."""

    def block(batch, r: int) -> tuple:
        ids, times, x, d = (batch.column(c)[r].as_py() for c in ("ids", "times", "x", "size"))
        x = np.frombuffer(x, kind).reshape(-1, d).astype(np.float64)
        u = _unit(x)
        return np.frombuffer(ids, "<i8"), np.frombuffer(times, "<i8"), x, u, _leading(u, bases.value)

    def compared(a: tuple, b: tuple, same: bool):
        (ia, ta, x, ux, px), (ib, tb, y, uy, py) = a, b
        s = _near(x, y, px, py, ux, uy, same, least)
        na, nb = s @ tb, (0 if same else 1) * (s.T @ ta)
        la, lb, big = ia.copy(), ib.copy(), np.iinfo(np.int64).max
        while s.any():
            na_l = np.minimum(la, np.where(s, lb[None, :], big).min(axis=1))
            nb_l = np.minimum(lb, np.where(s, na_l[:, None], big).min(axis=0))
            if same:
                na_l = nb_l = np.minimum(na_l, nb_l)
            if (na_l == la).all() and (nb_l == lb).all():
                break
            la, lb = na_l, nb_l
        has = np.concatenate([s.any(axis=1), s.any(axis=0) & (not same)])
        ids, n, low = np.concatenate([ia, ib]), np.concatenate([na, nb]), np.concatenate([la, lb])
        if has.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(n[has].astype(np.int64)), pa.array(low[has])], ["rep", "n", "low"])

    def run(batches):
        own = None
        for batch in batches:
            a, b, alone = (batch.column(c).to_pylist() for c in ("a", "b", "alone"))
            for r in range(batch.num_rows):
                here = block(batch, r)
                if a[r] == b[r]:
                    own = here
                    if alone[r]:
                        yield from compared(own, own, True)
                else:
                    yield from compared(own, here, False)

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: n_links (others linked directly), component_id (smallest id reachable) and kept.

    Vectors meet only under equal labels that are not null and with as many components. A vector that is
    null, empty, zero, or has a null or non-finite component links with nothing; so does one without a
    label. Equal vectors are compared once and count as often as they come.
    """
    spark = vectors.sparkSession
    modest_batches(spark)
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.col("label").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.md5(F.concat_ws(",", F.col("vec").cast("array<string>")))))
    good = rows.where(F.col("key").isNotNull())
    reps = good.groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.min_by("vec", "id").alias("vec"))
    reps = cut(reps.withColumn("size", F.size("vec")))
    bases = spark.sparkContext.broadcast(_bases(reps))
    width = float(np.sqrt(2 - 2 * least)) or 1e-6

    cells = ", ".join(f"c{k} int" for k in range(ORDERED))
    order = ["label", "size", *(f"c{k}" for k in range(ORDERED)), "rep"]
    plain = reps.select("label", "size", "rep", "times", "vec")
    grid = plain.mapInArrow(_ordered(bases, width), f"label string, size int, rep long, times long, vec array<double>, {cells}")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    run = grid.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = run.mapInArrow(_packed(bases, kind), "label string, size int, lo array<double>, hi array<double>, ids binary, times binary, x binary")
    blocks = cut(packed.withColumn("block", F.monotonically_increasing_id()))

    cell = lambda c, k: F.floor(F.col(c)[k] / width).cast("int")
    cells_of = lambda more: F.explode(F.flatten(F.transform(F.sequence(cell("lo", 0) - more, cell("hi", 0) + more), lambda i: F.transform(F.sequence(cell("lo", 1) - more, cell("hi", 1) + more), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    left = blocks.select(F.col("block").alias("a"), "label", "size", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), cells_of(0).alias("cell"))
    right = blocks.select(F.col("block").alias("b"), "label", "size", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), cells_of(1).alias("cell"))
    gap = F.aggregate(
        F.zip_with(F.zip_with("lo_a", "hi_b", lambda p, q: p - q), F.zip_with("lo_b", "hi_a", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0))),
        F.lit(0.0),
        lambda s, g: s + g * g,
    )
    pairs = cut(left.join(right, ["label", "size", "cell"]).where((F.col("a") <= F.col("b")) & (gap <= 2 - 2 * least + 1e-9)).select("a", "b").distinct())
    group = F.pmod("b", F.lit(SPREAD)).cast("int").alias("set")
    data = blocks.select("block", "size", "ids", "times", "x")
    come = pairs.where("a <> b").join(data.withColumnRenamed("block", "b"), "b").select("a", group, "b", F.lit(False).alias("alone"), "size", "ids", "times", "x")
    own = pairs.select("a", group).distinct().join(data.withColumnRenamed("block", "a"), "a").select("a", "set", F.col("a").alias("b"), (F.pmod("a", F.lit(SPREAD)) == F.col("set")).alias("alone"), "size", "ids", "times", "x")
    # Without this many parts, one task could get many of the few, large rows.
    near = own.unionByName(come).repartition(parts * 4, "a", "set").sortWithinPartitions("a", "set", F.col("a") != F.col("b"))
    found = cut(near.mapInArrow(_joined(bases, least, kind), "rep long, n long, low long"))

    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    whole = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    classes = reps.select("label", "key", "rep", "times").join(linked, "rep", "left").join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "label", "key").join(classes, ["label", "key"], "left")
    component = F.coalesce("component_id", "id").cast("long")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
