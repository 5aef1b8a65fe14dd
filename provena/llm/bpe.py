"""Byte-level BPE over Arrow batches: encode with offsets, decode by the reversed byte table.

A text is split into pieces by the pattern; the tokenizers library merges each different piece of a
task once, and a text's ids are its pieces' ids in order. The library ranks each pair on its own, while
the rank file ranks what a pair makes: where a piece could hold two pairs that make the same token
and overlap, its ids are held against a merge by rank and that one's are taken.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import binary_array, binary_slices, fresh, modest_batches, named, remembered, text_slices, trim, without

#: The file of ranks is broadcast; no vocabulary in use comes near this size.
MOST_RANK_BYTES = 64 << 20
#: Pieces whose ids a worker remembers; beyond that it forgets all and goes on. Each takes about 250 bytes.
REMEMBERED = 60_000
#: Text bytes, and bytes of ids, that are encoded and decoded at once: their pieces and places take tens of times as much.
AT_ONCE = 100_000
#: Stands between pieces that go to the library in one string; a piece that has it is merged by rank.
BETWEEN = "\U0010ffff"

_codecs: dict[str, Codec] = {}
_decoders: dict[str, Decoder] = {}


def read_ranks(spark, path: str):
    """The file of ranks, read by the driver and broadcast within a bound."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > MOST_RANK_BYTES:
        raise ValueError(f"{path} has {len(raw)} bytes, over {MOST_RANK_BYTES}")
    return spark.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Decoder:
    """The bytes of a vocabulary's tokens, by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one token after the other; a character may be split over tokens."""
        if len(ids) and int(ids.max()) >= len(self.lengths):
            raise ValueError(f"id {int(ids.max())} is not in the vocabulary")
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at]


def _ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class Codec(Decoder):
    """One vocabulary in a worker that encodes."""

    def __init__(self, raw: bytes, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = _ranks_of(raw)
        super().__init__(ranks)
        sign = byte_alphabet()
        name = {t: "".join(sign[b] for b in t) for t in ranks}
        merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.library = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(BETWEEN, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.raw, self.ranked = raw, None
        # The rank files' own library takes the Unicode property White_Space for \s.
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        # x, y, z with x + y == y + z: the bytes begin with a repetition and one byte more of it.
        self.overlap = re.compile(rb"(.)(.*?)\1\2\1", re.DOTALL).search
        self.ids: dict[str, bytes] = {}
        # What it was made from is several times what stays.
        del name, merges, ranks
        trim()

    def by_rank(self, piece: str) -> list[int]:
        """A piece's ids, merged by rank; what does it is made when the first piece asks for it."""
        if self.ranked is None:
            import tiktoken

            self.ranked = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=_ranks_of(self.raw), special_tokens={}).encode_ordinary
            trim()
        return self.ranked(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        new = list({p for pieces in split for p in pieces if p not in self.ids})
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            done = self.library.encode_batch_fast([BETWEEN.join(p for p in some if BETWEEN not in p)], add_special_tokens=False)[0]
            ids = np.array(done.ids, "<u4")
            # A piece ends with the token that has its last byte.
            last_byte = np.cumsum([len(p.encode()) for p in some if BETWEEN not in p])
            ends = iter((np.searchsorted(np.cumsum(self.lengths[ids]), last_byte) + 1) * 4)
            whole, at_byte = ids.tobytes(), 0
            for p in some:
                if BETWEEN in p:
                    self.ids[p] = np.array(self.by_rank(p), "<u4").tobytes()
                    continue
                end = int(next(ends))
                own, at_byte = whole[at_byte:end], end
                if len(own) > 8 and self.overlap(p.encode()):
                    own = np.array(self.by_rank(p), "<u4").tobytes()
                self.ids[p] = own
        return [b"".join(map(self.ids.__getitem__, pieces)) for pieces in split]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token; tokens that share a character both have it."""
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        ends = np.cumsum(self.lengths[ids])
        return char[ends - self.lengths[ids]], char[ends - 1] + 1


def codec(ranks, pattern: str) -> Codec:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    name, raw = ranks.value
    own = remembered(_codecs)
    if (key := f"{name} {pattern}") not in own:
        own[key] = Codec(raw, pattern)
    return own[key]


def decoder(ranks) -> Decoder:
    name, raw = ranks.value
    own = remembered(_decoders)
    if name not in own:
        own[name] = Decoder(_ranks_of(raw))
    return own[name]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", offsets: bool = False) -> DataFrame:
    """docs with the ids of the whole text: binary, little-endian unsigned 32-bit integers.

    offsets adds char_starts and char_ends, each token's characters. A null or empty text has no ids
    (empty binary). No special tokens: their strings are ordinary text. Other columns stay and don't leave
    the JVM; a column that is named like a new one is replaced. Rows that repeat a doc_id have ids each.
    """
    modest_batches(docs.sparkSession)
    ranks = read_ranks(docs.sparkSession, ranks_path)

    def run(texts: pa.Array) -> pa.Array:
        own, ids, spans = codec(ranks, pattern), [], []
        for rows, _, _ in text_slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), most=AT_ONCE):
            some = [t or "" for t in rows.column(0).to_pylist()]
            new = own.encode(some)
            ids += new
            if offsets:
                spans += [own.spans(t, np.frombuffer(x, "<u4")) if x else ((), ()) for t, x in zip(some, new, strict=True)]
        parts = [pa.array(ids, pa.binary())]
        if offsets:
            parts += [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
        return pa.StructArray.from_arrays(parts, ["ids", "char_starts", "char_ends"][: len(parts)])

    kind = "ids binary, char_starts array<int>, char_ends array<int>" if offsets else "ids binary"
    found = F.arrow_udf(run, kind)(F.col(text_col))
    if not offsets:
        return docs.withColumn(ids_col, found["ids"])
    frame = without(docs, ids_col, "char_starts", "char_ends")
    (own,) = fresh(frame, "encoded")
    return frame.withColumn(own, found).select(*named(frame.columns), F.col(f"{own}.ids").alias(ids_col), f"{own}.char_starts", f"{own}.char_ends")


def _decoded(own: Decoder, ids: pa.Array) -> pa.Array:
    out = []
    for _, data, ends in binary_slices(iter([pa.RecordBatch.from_arrays([ids], ["ids"])]), "ids", AT_ONCE):
        own_ids = data.view("<u4").astype(np.int64)
        bytes_before = np.concatenate([[0], np.cumsum(own.lengths[own_ids])]) if len(own_ids) else np.zeros(1, np.int64)
        out.append(binary_array(own.decode(own_ids), bytes_before[ends // 4]))
    return pa.concat_arrays(out) if out else pa.array([], pa.binary())


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """docs with the bytes that the ids stand for; null ids are as none. Ids outside the vocabulary raise an error. Other columns stay."""
    modest_batches(docs.sparkSession)
    ranks = read_ranks(docs.sparkSession, ranks_path)

    def run(ids: pa.Array) -> pa.Array:
        return _decoded(decoder(ranks), ids)

    return docs.withColumn(bytes_col, F.arrow_udf(run, "binary")(F.col(ids_col)))


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """docs with the ids of encode() and the bytes of decode() of these ids, in one Python worker a task."""
    modest_batches(docs.sparkSession)
    ranks = read_ranks(docs.sparkSession, ranks_path)

    def run(texts: pa.Array) -> pa.Array:
        own, parts = codec(ranks, pattern), []
        for rows, _, _ in text_slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), most=AT_ONCE):
            parts.append(pa.array(own.encode([t or "" for t in rows.column(0).to_pylist()]), pa.binary()))
        made = pa.concat_arrays(parts) if parts else pa.array([], pa.binary())
        return pa.StructArray.from_arrays([made, _decoded(own, made)], ["ids", "bytes"])

    frame = without(docs, ids_col, bytes_col)
    (own,) = fresh(frame, "both")
    found = docs.select(*named(frame.columns), F.arrow_udf(run, "ids binary, bytes binary")(F.col(text_col)).alias(own))
    return found.select(*named(frame.columns), F.col(f"{own}.ids").alias(ids_col), F.col(f"{own}.bytes").alias(bytes_col))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes that they decode to."""
    both = encode_and_decode(docs.select("doc_id", "text"), ranks_path, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
