"""What several operators share: scratch storage, Arrow text buffers, word hashes, components."""

from __future__ import annotations

import ctypes
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators.storage import modest_batches  # noqa: F401

#: Text bytes that one numpy pass takes at once, under a power of two that tables of powers are as long as (a longer text is a pass of its own).
SLICE_BYTES = 500_000

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_KEYS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names like the stems that no column of df has, for columns that come and go within an operator."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"{stem}_{k}" for k in range(len(taken) + 1)) if n not in taken) for stem in stems]


def named(columns: list[str]) -> list[Column]:
    """The columns of these very names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """df's columns as one column `row`, beside which an operator's own can have any name."""
    return F.struct(*named(df.columns if columns is None else columns)).alias("row")


def unpacked(columns: list[str]) -> list[Column]:
    """The columns that packed() took."""
    return [F.col("row").getField(c).alias(c) for c in columns]


def without(df: DataFrame, *columns: str) -> DataFrame:
    """df without columns of these names."""
    gone = {c.lower() for c in columns}
    return df.select(*named([c for c in df.columns if c.lower() not in gone]))


def ready_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir; where that is unset, to an own one if all runs on this machine, else it's an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="provena-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared checkpoint folder, so that a lost executor doesn't cost it."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


_libc = ctypes.CDLL(None)
#: What workers keep between tasks, and when each was last asked for.
_kept: dict[int, tuple[dict, float]] = {}
#: Seconds after which what nobody asked for is forgotten.
FORGET_AFTER = 20.0


def remembered(cache: dict) -> dict:
    """The cache, which is forgotten when a worker does other work for some time."""
    _kept[id(cache)] = (cache, time.monotonic())
    return cache


def tidy() -> None:
    """Gives memory that a worker no longer uses back to the machine: workers stay for the next task, and several of them share an executor's memory with its JVM."""
    for k, (cache, asked) in list(_kept.items()):
        if time.monotonic() - asked > FORGET_AFTER:
            cache.clear()
            del _kept[k]
    trim()


def trim() -> None:
    """Gives freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `most` bytes of text: (rows, UTF-8 bytes, offsets). A null text has no bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        if not pa.types.is_large_string(col.type):
            col = col.cast(pa.large_string())
        if col.null_count:
            col = pc.fill_null(col, "")
        ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to
    tidy()


def binary_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """text_slices() of a binary column."""
    for batch in batches:
        col = batch.column(column).cast(pa.large_binary())
        if col.null_count:
            col = pc.fill_null(col, b"")
        ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The runs of data between the offsets as a binary column, without a copy for each."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads each bit of a 64-bit word over all."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)])) for b in (_B, _B_INV)]
    return _POWERS[0], _POWERS[1]


def range_hashes(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of keys[start:end] for each range, by prefix sums of a polynomial."""
    up, down = _powers(len(keys) + 1)
    sums = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(keys * up[: len(keys)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of texts that lie one after the other in a byte array.

    `kept` maps each byte to the byte that stands for it in a word, 0 for a separator. A word never
    crosses the end of a text. starts and ends are byte positions, row tells the text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kept: np.ndarray):
        self.bytes = kept[data]
        inside = self.bytes != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        heads = offsets[:-1][np.diff(offsets) > 0]
        first[heads] = inside[heads]
        tails = heads[1:] - 1
        last[tails] = inside[tails]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.per_row = np.diff(np.searchsorted(self.starts, offsets))
        self.row = np.repeat(np.arange(len(offsets) - 1), self.per_row)
        self.first_word = np.concatenate([[0], np.cumsum(self.per_row)])
        self.hash = range_hashes(_BYTE_KEYS[self.bytes], self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of all n consecutive words of a text."""
        at = np.arange(max(0, len(self.starts) - n + 1))
        at = at[self.row[at] == self.row[at + n - 1]]
        return at, range_hashes(self.hash, at, at + n)

    def joined(self, at: int, n: int) -> bytes:
        return b" ".join(self.bytes[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + n))


def lowered(is_word: np.ndarray) -> np.ndarray:
    """For Words: A to Z as a to z, and 0 where is_word, asked after that, is false."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return np.where(is_word[low], low, 0).astype(np.uint8)


#: Up to so many links, a fixed number, one task joins what rounds over the cluster would.
FEW_LINKS = 1 << 16


def _joined(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            u, v = find(u), find(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """(node, component): the smallest node that links reach, for each node that has a link.

    Large-star and small-star rounds as joins and aggregates: no neighbour list is ever gathered, so a
    node with very many links costs a partial minimum and a join that adaptive execution may split. Each
    round's edges are checkpointed; the rounds end when a round changes nothing. Where only `few` edges
    are there, or left, one task of that bounded size does the same.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct()
    edges = cut(edges)
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_joined, "node long, component long")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = cut(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (now["n"], now["h"]):
            break
        if now["n"] <= few:
            return edges.coalesce(1).mapInArrow(_joined, "node long, component long")
        state = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: for results with many narrow rows, which checkpoint() would store wide."""
    import uuid

    spark = df.sparkSession
    ready_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
