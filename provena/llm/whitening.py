"""Embedding whitening: components by spectral divide and conquer, whose projectors come from polar decompositions.

A first pass sums the different vectors exactly, a second one their centred products; both leave each task as
one row for each dimension, which rows of the same dimension are added to in other tasks, so what reaches the
driver is one matrix of the dimension. There the polar factor of the covariance less a shift (by dynamically
weighted Halley steps, each a QR decomposition) has eigenvalues 1 and -1; half of it and the identity projects
on the space above the shift, which splits the matrix in two, and so on in the parts where leading components
are, until each is alone. Means and components go to every task, which whitens its rows.

Vectors that are null, empty, or hold null or non-finite entries are left out, and so are those of another
length than most (of as many, the greater length). Rows that repeat are as many rows and count once in the fit.
Components of which nothing is left but rounding (an eigenvalue of at most 1e-12 of the largest) can't be
whitened and have no rows; so has a table with one different vector, or none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import kept_table, modest_batches, named, tidy

#: Entries are fitted in steps of 1 / SCALE.
SCALE = 256
#: Components that are told.
COMPONENTS = 4
#: Eigenvalues of at most so much of the largest are rounding.
LEAST = 1e-12

_EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley steps. Eigenvalues within rounding of 0 may stay between -1 and 1."""
    n = len(a)
    x, low, eye = a / np.linalg.norm(a), _EPS / n, np.eye(n)
    for _ in range(100):
        s = low * low
        d = np.cbrt(4 * (1 - s) / (s * s))
        w = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - s) / (s * np.sqrt(1 + d)))
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = (b / c) * x + (w - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (w + b * s) / (1 + c * s))
        moved, x = np.linalg.norm(new - x), new
        if moved <= 10 * _EPS * np.sqrt(n) or (low >= 1 - 4 * _EPS and moved <= np.cbrt(_EPS)):
            break
    return x


def _shifts(a: np.ndarray):
    """Shifts to try: the mean of all eigenvalues, which has some on either side unless all are the same, then others within their span."""
    mean, spread = np.trace(a) / len(a), np.linalg.norm(a - np.trace(a) / len(a) * np.eye(len(a))) / np.sqrt(len(a))
    yield mean
    yield float(np.median(np.diag(a)))
    for k in range(1, 40):
        yield mean + spread * (0.37 * ((k * 0.6180339887498949) % 1.0) - 0.185) * 2


def _halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if all eigenvalues are the same but for rounding."""
    n = len(a)
    if np.linalg.norm(a - np.trace(a) / n * np.eye(n)) <= 4 * n * _EPS * scale:
        return None
    best = None
    for shift in _shifts(a):
        p = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(p)))
        if not 0 < k < n:
            continue
        # The projector's own columns, the longest first, and the complement: a subspace step that is done when it is begun.
        q, _ = np.linalg.qr(p[:, np.argsort(-np.linalg.norm(p, axis=0), kind="stable")[:k]], mode="complete")
        for _ in range(3):
            q, _ = np.linalg.qr(np.hstack([p @ q[:, :k], q[:, k:] - p @ q[:, k:]]))
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = (left, q[:, :k], q[:, k:])
        if left <= 8 * n * _EPS * scale:
            break
    if best is None or best[0] > 1e-10 * scale:
        return None
    return best[1], best[2]


def leading(a: np.ndarray, m: int, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The m largest eigenvalues of a symmetric matrix in falling order, and unit eigenvectors as columns."""
    n, m = len(a), min(m, len(a))
    scale = np.linalg.norm(a) if scale is None else scale
    if not m:
        return np.zeros(0), np.zeros((n, 0))
    parts = _halves(a, scale) if n > 1 and scale else None
    if parts is None:
        order = np.argsort(-np.diag(a), kind="stable")[:m]
        return np.diag(a)[order], np.eye(n)[:, order]
    values, vectors = [], []
    for q in parts:
        part = q.T @ a @ q
        e, v = leading((part + part.T) / 2, m - sum(map(len, values)), scale)
        values.append(e)
        vectors.append(q @ v)
    return np.concatenate(values), np.hstack(vectors)


def _vectors(col: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of whole numbers."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _sums(batches):
    n, high, low = 0, None, None
    for batch in batches:
        if batch.num_rows:
            x = _vectors(batch.column(0))
            # In halves of 32 bits, which don't overflow.
            h, w = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            n, high, low = n + len(x), h if high is None else high + h, w if low is None else low + w
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(high)), pa.int32()), pa.array([n] * len(high), pa.int64()), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - sums / n: whole numbers first, so that large ones lose nothing."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


def _products(sums: list[int], n: int):
    def run(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                y = _centred(_vectors(batch.column(0)), sums, n)
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            part = TaskContext.get().partitionId()
            for i in range(len(sums)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([total[i].tolist()], pa.list_(pa.float64()))], ["dim", "part", "row"])
        tidy()

    return run


def _added(batches):
    """Rows of one dimension after the other, in order of tasks: their sums."""
    now, total = None, None
    for batch in batches:
        for dim, row in zip(batch.column("dim").to_pylist(), batch.column("row"), strict=True):
            row = row.values.to_numpy()
            if dim != now and now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["dim", "row"])
            total = row.copy() if dim != now else total + row
            now = dim
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["dim", "row"])


def whole(vector: Column) -> Column:
    """The vector in steps of 1 / SCALE; null if it is null, empty or holds what is no finite number. What no long can hold becomes the nearest long."""
    is_finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    fits = F.when((F.size(vector) > 0) & F.forall(vector, is_finite), vector)
    most = float(1 << 62)
    return F.transform(fits, lambda c: F.floor(F.least(F.greatest(F.lit(float(SCALE)) * c.cast("double"), F.lit(-most)), F.lit(most))).cast("long"))


class Fit:
    """n different vectors, their exact sums by dimension, the leading eigenvalues and components of their covariance, its trace."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, components: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.components, self.trace = n, sums, values, components, trace


def covariance(different: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, exact sums, covariance of divisor n) of different vectors x of one length."""
    found = different.select("x").mapInArrow(_sums, "dim int, n long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).orderBy("dim").collect()
    if not found:
        return 0, [], np.zeros((0, 0))
    n, sums = found[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in found]
    rows = different.select("x").mapInArrow(_products(sums, n), "dim int, part int, row array<double>").repartition("dim").sortWithinPartitions("dim", "part").mapInArrow(_added, "dim int, row array<double>")
    v = np.zeros((len(sums), len(sums)))
    for r in rows.toLocalIterator():
        v[r["dim"]] = r["row"]
    v /= n
    return n, sums, (v + v.T) / 2


def fit(different: DataFrame, most: int = COMPONENTS) -> Fit:
    n, sums, v = covariance(different)
    values, components = leading(v, most) if n else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")
    values, components = values[order], components[:, order]
    real = values > LEAST * max(values.max(initial=0), 0)
    values, components = values[real], components[:, real]
    # Of the two signs, the one whose largest entry is positive.
    signs = np.sign(components[np.abs(components).argmax(0), np.arange(len(values))]) if len(values) else np.ones(0)
    return Fit(n, sums, values, components * signs, float(np.trace(v)))


def _whitener(made: Fit, spark, exact: bool):
    shared = spark.sparkContext.broadcast((made.n, made.sums, made.components / np.sqrt(made.values)))

    def run(vectors: pa.Array) -> pa.Array:
        n, sums, to = shared.value
        x = _vectors(vectors) if len(vectors) else np.zeros((0, len(sums)), np.int64)
        w = _centred(x, sums, n) @ to
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * to.shape[1], pa.int32()), pa.array(w.ravel()))
        if not exact:
            return lists
        most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
        if most * most * max(1, len(sums)) < 1 << 62:
            far = ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
        else:  # beyond a long: whole numbers of any size; null where the sum itself is no long
            far = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
            far = [v if v < 1 << 63 else None for v in far]
        return pa.StructArray.from_arrays([pa.array(far, pa.int64()), lists], ["deviation", "whitened"])

    return F.arrow_udf(run, "struct<deviation:long,whitened:array<double>>" if exact else "array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each usable row and each component up to `most`.

    identity_error is the largest difference of an entry of the whitened vectors' covariance from the
    identity's, over the different vectors. deviation is null where it is no long.
    """
    spark = vectors.sparkSession
    modest_batches(spark)
    i, v = named([id_col, vector_col])
    rows = kept_table(vectors.select(i.alias("id"), whole(v).alias("x")).where("x is not null"), "vectors")
    lengths = rows.groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    rows = rows.where(F.size("x") == (lengths["k"] if lengths else 0))
    different = kept_table(rows.select("x").distinct(), "fit")
    made = fit(different, most)
    m = len(made.values)
    if not m:
        kinds = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return rows.limit(0).select(F.col("id").alias(id_col), *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    over_fit = different.select(_whitener(made, spark, False)("x").alias("w")).select(*[F.get("w", F.lit(k)).alias(f"w{k}") for k in range(m)])
    pairs = [(a, b) for a in range(m) for b in range(a, m)]
    entries = over_fit.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    error = max(abs(entries[k] - (a == b)) for k, (a, b) in enumerate(pairs))
    shares = F.array(*[F.lit(float(e / made.trace)) for e in made.values])
    each = rows.select("id", _whitener(made, spark, True)("x").alias("r")).select("id", F.col("r.deviation").alias("deviation"), F.posexplode("r.whitened").alias("k", "whitened"))
    return each.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(float(error)).alias("identity_error"))
