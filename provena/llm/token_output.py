"""Token sequences in training order, as shards of fixed stride.

Texts become ids, ids sequences of one length; every sequence has a dense number, and a keyed Feistel
permutation, walked along its cycle until it falls into range, gives that number its slot in training
order. Sequences are dealt by ranges of slots; a shard holds consecutive slots in one run of bytes, so
a reader finds slot s in shard s // SHARD at (s % SHARD) * stride and resumes anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.bpe import read_ranks
from provena.llm.common import binary_array, binary_slices, kept_table, mixed, modest_batches, remembered, text_slices

#: Tokens of a sequence, and sequences of a shard.
LENGTH = 512
SHARD = 2048
#: Bytes of sequences that one task puts in order.
RANGE_BYTES = 64 << 20
_known: dict = {}


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slot of each index below n: a permutation of range(n) that the key chooses."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & ((1 << 64) - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for k in keys:
            a, b = b, a ^ (mixed(b + k) & mask)
        return (a << half) | b

    out = once(index.astype(np.uint64))
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = once(out[far])
    return out.astype(np.int64)


def _encoder(ranks, pattern: str):
    import base64

    import tiktoken

    name, raw = ranks.value
    if (name, pattern) not in remembered(_known):
        own = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        _known[name, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={}), max(own.values()) + 1
    return _known[name, pattern]


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary < 1 << 16 else "<u4"


def numbered(docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, ids, part, first): the ids of each text that has any, then one that ends it, and the number of its first sequence within its part."""
    from pyspark import TaskContext

    ranks = read_ranks(docs.sparkSession, ranks_path)

    def run(batches):
        encoder, end = _encoder(ranks, pattern)
        part, first, kind = TaskContext.get().partitionId(), 0, width(end + 1)
        for rows, _, _ in text_slices(batches):
            own, at, ids = rows.column("doc_id").to_pylist(), [], []
            out = []
            for doc, text in zip(own, rows.column("text").to_pylist(), strict=True):
                if text:
                    x = np.append(np.asarray(encoder.encode_to_numpy(text, disallowed_special=())), end).astype(kind)
                    out.append(doc)
                    ids.append(x.tobytes())
                    at.append(first)
                    first += -(-len(x) // length)
            yield pa.RecordBatch.from_arrays([pa.array(out, rows.schema.field("doc_id").type), pa.array(ids, pa.binary()), pa.array([part] * len(out), pa.int32()), pa.array(at, pa.int64())], ["doc_id", "ids", "part", "first"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, part int, first long")


def shards(docs: DataFrame, ranks_path: str, pattern: str, key: int = 20240607, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(shard, first_slot, n, stride, doc_ids, places, tokens, data), written to the shared checkpoint folder and read again.

    data has n sequences of stride bytes one after the other, in order of slots: little-endian ids, 16 bits
    each where the vocabulary allows, else 32. The last sequence of a text is filled up with the id that
    ends texts, the number of the vocabulary's ids. places counts a text's sequences, tokens their ids
    without filling. Null and empty texts have no sequence; rows that repeat a doc_id have their own.
    Numbers follow the parts that the input is read in, so an unchanged input keeps its order.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    ranks = read_ranks(spark, ranks_path)
    flat = kept_table(numbered(docs, ranks_path, pattern, length), "token-ids")
    size = int(width(sum(1 for line in ranks.value[1].splitlines() if line.strip()) + 1)[-1])
    count = F.ceil(F.octet_length("ids") / (size * length)).cast("long")
    per_part = sorted((r["part"], r["n"]) for r in flat.groupBy("part").agg(F.sum(count).alias("n")).collect())
    before, n = {}, 0
    for part, k in per_part:
        before[part] = n
        n += k
    shipped, stride = spark.sparkContext.broadcast(before), size * length

    kind_of, per_shard = f"<u{size}", shard
    whole_shards = -(-n // per_shard)
    # Slots are dense and evenly spread, so ranges of shards need no sampling: as many as there are tasks, more where a task had too many bytes.
    ranges = max(1, min(whole_shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * stride // RANGE_BYTES))))

    def dealt(batches):
        for rows, data, ends in binary_slices(batches, "ids"):
            ids, ends = data.view(kind_of), ends // size
            k = -(-np.diff(ends) // length)
            first = np.concatenate([[0], np.cumsum(k)])
            if not first[-1]:
                continue
            out = np.full(int(first[-1]) * length, ids[-1], kind_of)
            out[np.arange(len(ids)) + np.repeat(first[:-1] * length - ends[:-1], np.diff(ends))] = ids
            place = np.arange(first[-1]) - np.repeat(first[:-1], k)
            start = np.array([shipped.value[p] for p in rows.column("part").to_pylist()], np.int64) + np.asarray(rows.column("first"))
            slot = feistel(np.repeat(start, k) + place, n, key)
            tokens = np.minimum(length, np.repeat(np.diff(ends), k) - place * length)
            doc = rows.column("doc_id").take(pa.array(np.repeat(np.arange(len(k)), k)))
            yield pa.RecordBatch.from_arrays([pa.array((slot // per_shard * ranges // whole_shards).astype(np.int32)), pa.array(slot), doc, pa.array(place.astype(np.int32)), pa.array(tokens.astype(np.int32)), binary_array(out.view(np.uint8), np.arange(first[-1] + 1) * stride)], ["range", "slot", "doc_id", "place", "tokens", "data"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = flat.mapInArrow(dealt, f"range int, slot long, doc_id {kind}, place int, tokens int, data binary")
    ordered = rows.repartitionById(ranges, "range").sortWithinPartitions("slot").drop("range")

    def packed(batches):
        held: list[pa.RecordBatch] = []

        def out():
            slot, doc, place, tokens, data = (pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in ("slot", "doc_id", "place", "tokens", "data"))
            m = len(slot)
            whole = data.buffers()[2][data.offset * stride : (data.offset + m) * stride]
            lists = [pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), x) for x in (doc, place, tokens)]
            return pa.RecordBatch.from_arrays([pa.array([slot[0].as_py() // per_shard]), slot.slice(0, 1), pa.array([m]), pa.array([stride]), *lists, pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, m * stride], np.int32)), whole])], ["shard", "first_slot", "n", "stride", "doc_ids", "places", "tokens", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.asarray(batch.column("slot")) // per_shard
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column("slot")[0].as_py() // per_shard != own[a]:
                    yield out()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return kept_table(ordered.mapInArrow(packed, f"shard long, first_slot long, n long, stride long, doc_ids array<{kind}>, places array<int>, tokens array<int>, data binary"), "shards")


def read_on(written: DataFrame, slot: int, shard: int = SHARD) -> DataFrame:
    """(slot, doc_id, place, tokens, data) of the sequences from that slot on; earlier shards aren't read."""
    own = written.where(F.col("shard") >= slot // shard)
    rows = own.select("first_slot", "stride", "data", F.posexplode(F.arrays_zip("doc_ids", "places", "tokens")).alias("i", "of"))
    out = rows.select((F.col("first_slot") + F.col("i")).alias("slot"), F.col("of.doc_ids").alias("doc_id"), F.col("of.places").alias("place"), F.col("of.tokens").alias("tokens"), F.substring("data", (F.col("i") * F.col("stride") + 1).cast("int"), F.col("stride").cast("int")).alias("data"))
    return out.where(F.col("slot") >= slot)


def report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """A row for each sequence as the shards hold it."""
    out = read_on(shards(docs, ranks_path, pattern), 0)
    return out.select("slot", "doc_id", F.col("place").cast("long").alias("place"), F.col("tokens").cast("long").alias("n_tokens"), F.sha2("data", 256).alias("data_sha256"))
