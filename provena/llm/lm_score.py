"""Cross-entropy difference: how much likelier a text is under a target's model than under the background's.

Two bigram models, alike in vocabulary, order and smoothing: the target's counts come from the documents
that are chosen, the background's from all. The models keep every word and every pair at every size, so they
grow with the input; they are never in one place. Chunks of documents ask buckets of hashes for counts: a
bucket adds up what all chunks have of its keys, and answers each chunk with the sums of the keys it asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import Words, lowered, mixed, modest_batches, text_slices

#: Weights of pair, word and uniform distribution.
MIX = (0.6, 0.35, 0.05)
#: Up to so many chosen documents, their ids go to every task; beyond that they are joined.
MOST_IDS = 4_000_000
#: Bytes of text of a chunk (one longer text is a chunk of its own); of text for which there is a bucket; words that one pass scores.
CHUNK_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000
PASS_WORDS = 250_000
#: What stands before a text's first word.
_START = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0x9E3779B97F4A7C15)

_is_word = np.zeros(256, bool)
_is_word[0x30:0x3A] = _is_word[0x61:0x7B] = _is_word[0x80:] = True
_KEPT = lowered(_is_word)


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, target): whether each document is among the ids, which must be whole numbers; a null is among none."""
    spark, ids = docs.sparkSession, ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    docs = docs.select("doc_id", "text")
    if ids.count() > MOST_IDS:
        return docs.join(ids.select(F.col("doc_id").alias("_id"), F.lit(True).alias("target")), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    own = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in ids.collect()], np.int64)))

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64)
            hit = np.isin(x, own.value) & np.asarray(batch.column("doc_id").is_valid())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], ["doc_id", "text", "target"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, target boolean")


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes: first all lowest bytes, then all next ones, as small or sorted numbers compress best."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(n, 8).T.tobytes() for x in columns)
    return n.to_bytes(8, "little") + (pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True) if n else b"")


def _unpacked(blob: bytes, columns: int) -> np.ndarray:
    """(columns, n) of what _packed() made."""
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros((columns, 0), np.uint64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], decompressed_size=n * 8 * columns), np.uint8)
    return np.ascontiguousarray(planes.reshape(columns, 8, n).transpose(0, 2, 1)).view("<u8")[:, :, 0]


def _summed(key: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    """[sorted distinct keys, sums of each weight]."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return [key[at], *[np.add.reduceat(w[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for w in weights]]


class Chunk:
    """Words of rows (text, target): own and pair keys, text of each word, whether it ends its text."""

    def __init__(self, batches: list[pa.RecordBatch]):
        own, pair, row, per_row, target = ([np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int32, np.int64, bool))
        texts = 0
        for rows, data, offsets in text_slices(iter(batches)):
            w = Words(data, offsets, _KEPT)
            before = np.concatenate([[_START], w.hash[:-1]]) if len(w.hash) else w.hash
            before[w.first_word[:-1][w.per_row > 0]] = _START
            own.append(w.hash)
            pair.append(mixed(mixed(before) * _PAIR + w.hash))
            row.append((w.row + texts).astype(np.int32))
            per_row.append(w.per_row)
            target.append(np.asarray(rows.column("target")).astype(bool))
            texts += rows.num_rows
        self.own, self.pair, self.row, self.per_row, self.target = map(np.concatenate, (own, pair, row, per_row, target))
        self.bounds = np.concatenate([[0], np.cumsum(self.per_row)])

    def asked(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """([words, occurrences, the target's, followed ones, the target's], [pairs, occurrences, the target's])."""
        target, has = self.target[self.row], self.per_row > 0
        inner = np.ones(len(self.own), bool)
        inner[self.bounds[1:][has] - 1] = False
        starts, its = np.full(has.sum(), _START), self.target[has]
        all_targets, followed = np.concatenate([target, its]), np.concatenate([inner, np.ones(len(its), bool)])
        words = _summed(np.concatenate([self.own, starts]), np.ones(len(followed), bool), all_targets, followed, followed & all_targets)
        return words, _summed(self.pair, np.ones(len(target), bool), target)

    def losses(self, words: np.ndarray, pairs: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mean negative log-probability of a word, by model and text; what a text itself gave to a model's counts doesn't count for it.

        words and pairs are the models' counts for what asked() has, in its order; size has the number of
        distinct words, of words, and of the target's words.
        """
        known, known_pairs = np.unique(np.append(self.own, _START) if (self.per_row > 0).any() else self.own), np.unique(self.pair)
        if len(known) != words.shape[1] or len(known_pairs) != pairs.shape[1]:
            raise RuntimeError("a chunk's answer doesn't fit its words")
        words, pairs = words.astype(float), pairs.astype(float)
        start, even = np.searchsorted(known, _START), 1 / (size[0] + 1)
        out, at, texts = np.zeros((2, len(self.per_row))), 0, len(self.per_row)
        while at < texts:
            to = max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + PASS_WORDS, side="right")) - 1)
            a, b = self.bounds[at], self.bounds[to]
            if a < b:
                own, pair, row = np.searchsorted(known, self.own[a:b]), np.searchsorted(known_pairs, self.pair[a:b]), self.row[a:b].astype(np.int64) - at
                n, firsts = self.per_row[at:to], (self.bounds[at:to] - a)[self.per_row[at:to] > 0]
                last = np.zeros(to - at, np.int64)
                last[n > 0] = own[(self.bounds[at + 1 : to + 1] - a)[n > 0] - 1]

                def tally(k: np.ndarray, kinds: int) -> np.ndarray:
                    _, group, times = np.unique(row * kinds + k, return_inverse=True, return_counts=True)
                    return times[group]

                own_pair, own_word = tally(pair, len(known_pairs)), tally(own, len(known))
                before, own_context = np.concatenate([[start], own[:-1]]), np.concatenate([[1], own_word[:-1]])
                before[firsts], own_context[firsts] = start, 1
                own_followed = own_context - ((before == last[row]) & (before != start))
                for m in (0, 1):
                    less = self.target[at:to].astype(float)[row] if m == 0 else 1.0
                    single, followed, double, total = (words[1], words[3], pairs[1], size[2]) if m == 0 else (words[0], words[2], pairs[0], size[1])
                    context = single[before] - less * own_context
                    safe = np.maximum(context, 1)
                    share = np.where(context > 0, (followed[before] - less * own_followed) / safe, 0)
                    others = total - less * n[row]
                    word = np.where(others > 0, (single[own] - less * own_word) / np.maximum(others, 1), even)
                    p = MIX[0] * (double[pair] - less * own_pair) / safe + (MIX[1] + MIX[0] * (1 - share)) * word + MIX[2] * even
                    out[m, at:to] = np.bincount(row, weights=-np.log(p), minlength=to - at) / np.maximum(n, 1)
            at = to
        return out


_ASKED = "bucket int, chunk long, words binary, pairs binary, size binary, texts binary"


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "chunk", "words", "pairs", "size", "texts"])


def _asking(bits: int, chunk_bytes: int):
    """Each chunk's texts as one row, and its keys with their counts in it, a row a bucket (the first bits of a key)."""

    def sent(held: list[pa.RecordBatch], chunk: int):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        yield from _rows([(int(mixed(np.array([chunk + 1], np.uint64))[0] >> np.uint64(64 - bits)), chunk, None, None, None, sink.getvalue().to_pybytes())]).to_batches()
        words, pairs = Chunk(held).asked()
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        cuts = [[0, *np.searchsorted(x[0], edges), len(x[0])] for x in (words, pairs)]
        parts = [[_packed(*[c[i:j] for c in x]) for i, j in zip(cut, cut[1:], strict=False)] for x, cut in zip((words, pairs), cuts, strict=True)]
        yield from _rows([(k, chunk, w, p, None, None) for k, (w, p) in enumerate(zip(*parts, strict=True))]).to_batches()

    def run(batches):
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for rows, data, _ in text_slices(batches):
            if held and size + len(data) > chunk_bytes:
                yield from sent(held, chunk)
                chunk, held, size = chunk + 1, [], 0
            held.append(rows)
            size += len(data)
        if held:
            yield from sent(held, chunk)

    return run


def _answered(asked: pa.Table) -> pa.Table:
    """A bucket's sums for each chunk, in the order in which the chunk asked; texts as they came."""
    bucket, chunk, words, pairs, _, texts = (asked.column(i).to_pylist() for i in range(6))
    out = [(bucket[i], chunk[i], None, None, None, texts[i]) for i in range(len(chunk)) if texts[i] is not None]
    at = [i for i in range(len(chunk)) if texts[i] is None]
    size, back = b"", []
    for blobs, columns in ((words, 5), (pairs, 3)):
        parts = [_unpacked(blobs[i], columns) for i in at]
        ends = np.cumsum([0, *[x.shape[1] for x in parts]])
        own = np.concatenate(parts, axis=1) if parts else np.zeros((columns, 0), np.uint64)
        del parts
        key, place = np.unique(own[0], return_inverse=True)
        total = np.stack([np.bincount(place, weights=x, minlength=len(key)) for x in own[1:]]).astype(np.uint64)
        if columns == 5:
            real = key != _START
            size = np.array([real.sum(), total[0][real].sum(), total[1][real].sum()], "<i8").tobytes()
        back.append([_packed(*total[:, place[i:j]]) for i, j in zip(ends, ends[1:], strict=False)])
    out += [(bucket[i], chunk[i], w, p, size, None) for i, w, p in zip(at, *back, strict=True)]
    return _rows(out)


def _scored(answers: pa.Table) -> pa.Table:
    """Scores of a chunk's texts, from its texts and the answers of all buckets."""
    texts = next(x.as_py() for x in answers.column("texts") if x.is_valid)
    rows = pa.ipc.open_stream(texts).read_all()
    answers = answers.filter(answers.column("texts").is_null()).sort_by("bucket")
    words, pairs = (np.concatenate([_unpacked(x.as_py(), n) for x in answers.column(c)], axis=1) for c, n in (("words", 4), ("pairs", 2)))
    size = np.sum([np.frombuffer(x.as_py(), "<i8") for x in answers.column("size")], axis=0)
    chunk = Chunk(rows.to_batches())
    loss, none = chunk.losses(words, pairs, size), chunk.per_row == 0
    return pa.table([rows.column("doc_id"), pa.array(chunk.per_row), *[pa.array(x, mask=none) for x in (*loss, loss[0] - loss[1])]], names=["doc_id", "n_words", "loss_target", "loss_background", "score"])


def score(marked: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Of rows (doc_id, text, target): (doc_id, n_words, loss_target, loss_background, score): losses a word in nats, score their difference, below 0 for texts like the target's.

    A text that is null or has no words has n_words 0 and null losses.
    """
    modest_batches(marked.sparkSession)
    size = marked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A number of buckets that holds over a wide range of sizes, as each chunk asks each bucket.
    bits = max(8, int(size // BUCKET_BYTES).bit_length())
    asked = marked.select("doc_id", "text", "target").coalesce(1 + size // chunk_bytes).mapInArrow(_asking(bits, chunk_bytes), _ASKED)
    answers = asked.groupBy("bucket").applyInArrow(_answered, _ASKED)
    return answers.groupBy("chunk").applyInArrow(_scored, f"doc_id {marked.schema['doc_id'].dataType.simpleString()}, n_words long, loss_target double, loss_background double, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents; the target is what labels call good."""
    return score(chosen(docs, labels.where("quality = 1")))
