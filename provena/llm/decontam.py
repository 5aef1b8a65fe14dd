"""Benchmark decontamination: a hash set of the test windows goes to every task, which scans its texts.

The set is broadcast in parts of at most `part_bytes` of window text (one part for usual benchmarks); a
larger benchmark is scanned part after part: what one part found is written to the shared checkpoint
folder before the next is broadcast, so no more than one part is in a task or the driver at a time.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import Words, kept_table, lowered, modest_batches, packed, text_slices

WINDOW = 10
PART_BYTES = 24 << 20

_is_word = np.zeros(256, bool)
_is_word[0x30:0x3A] = _is_word[0x61:0x7B] = _is_word[0x80:] = True
_KEPT = lowered(_is_word)


def windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, words) for each window of each item; an item of fewer words, but not none, is one window."""

    def cut_up(batches):
        for rows, data, offsets in text_slices(batches):
            w, out = Words(data, offsets, _KEPT), []
            ids = rows.column("item").to_pylist()
            for r, k in enumerate(w.per_row):
                n = min(int(k), window)
                out += [(ids[r], n, w.joined(int(w.first_word[r]) + i, n)) for i in range(k - n + 1) if n]
            item, n, words = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(n, pa.int32()), pa.array(words, pa.binary())], ["item", "n", "words"])

    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(cut_up, "item string, n int, words binary").distinct()


def _in_order(items: set) -> list:
    """Names of items in order, a null one first."""
    return sorted(items, key=lambda x: (x is not None, x or ""))


class _Index:
    """Windows of one part, by length and hash; equal hashes keep all their windows."""

    def __init__(self, rows: list[tuple[str, int, bytes]]):
        items = defaultdict(set)
        for item, n, words in rows:
            items[n, bytes(words)].add(item)
        self.by_n = {}
        for n in {n for n, _ in items}:
            texts = [words for m, words in items if m == n]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            w = Words(data, offsets, _KEPT)
            _, hashes = w.grams(n)
            table = defaultdict(list)
            for h, t in zip(hashes.tolist(), texts, strict=True):
                table[h].append((t, _in_order(items[n, t])))
            sieve = np.zeros(1 << 20, bool)
            sieve[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_n[n] = (np.unique(hashes), sieve, dict(table))


_KIND = "struct<n_words:long,spans:array<struct<lo:long,hi:long,`from`:long,`to`:long>>,items:array<string>>"
_SPANS = pa.list_(pa.struct([(k, pa.int64()) for k in ("lo", "hi", "from", "to")]))


def _marked(index: _Index, texts: pa.Array, before: pa.Array | None = None) -> pa.Array:
    """Words of the texts, and what this part hits added to what earlier parts hit."""
    words, spans, found = [], [], []
    for rows, data, offsets in text_slices(iter([pa.RecordBatch.from_arrays([texts, *[before] * (before is not None)], ["text", "before"][: 1 + (before is not None)])])):
        w = Words(data, offsets, _KEPT)
        hit = defaultdict(list)
        for n, (keys, sieve, table) in index.by_n.items():
            at, h = w.grams(n)
            maybe = np.flatnonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])
            maybe = maybe[np.isin(h[maybe], keys)]
            for i, key in zip(at[maybe].tolist(), h[maybe].tolist(), strict=True):
                own = w.joined(i, n)
                for text, items in table[key]:
                    if text == own:
                        hit[int(w.row[i])].append((i, i + n, items))
        earlier = rows.column("before").to_pylist() if before is not None else [None] * rows.num_rows
        for r, old in enumerate(earlier):
            f, base, merged, items = int(w.first_word[r]), int(offsets[r]), [], set(old["items"] if old else ())
            for lo, hi, of in sorted([*hit.get(r, ()), *((x["lo"] + f, x["hi"] + f, ()) for x in (old["spans"] if old else ()))], key=lambda x: x[:2]):
                items.update(of)
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            spans.append([{"lo": lo - f, "hi": hi - f, "from": int(w.starts[lo]) - base, "to": int(w.ends[hi - 1]) - base} for lo, hi in merged])
            found.append(_in_order(items))
        words.append(w.per_row)
    return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *words]), pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.string()))], ["n_words", "spans", "items"])


def _marker(rows, first: bool):
    made = []

    def index() -> _Index:
        if not made:
            made.append(_Index(rows.value))
        return made[0]

    def start(texts: pa.Array) -> pa.Array:
        return _marked(index(), texts)

    def go_on(texts: pa.Array, before: pa.Array) -> pa.Array:
        return _marked(index(), texts, before)

    # As one that may differ from call to call, so that a filter on what follows from it does not call it twice.
    return F.arrow_udf(start if first else go_on, _KIND).asNondeterministic()


def marked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, item_col: str = "item_id") -> DataFrame:
    """(row: docs' columns, found: n_words, spans (words lo to hi, bytes from to to, ends exclusive, merged) and items).

    A null or empty text, or one without words, has no words and no hits; an item without words, or an
    empty benchmark, hits nothing. Items of the same words are all named; items whose id is null count as one,
    which has no name. Columns may have any name.
    """
    modest_batches(docs.sparkSession)
    spark, found = docs.sparkSession, windows(benchmark, window, item_col)
    size = found.agg(F.sum(F.length("words") + F.coalesce(F.length("item"), F.lit(0)) + 16)).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    if parts > 1:
        found = kept_table(found, "windows")
    out = docs.select(packed(docs))
    text = F.col("row").getField(text_col)
    for p in range(parts):
        rows = found.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == p) if parts > 1 else found
        index = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])
        out = out.select("row", (_marker(index, True)(text) if p == 0 else _marker(index, False)(text, F.col("found"))).alias("found"))
        if p + 1 < parts:
            out = kept_table(out, "marked")
            index.destroy()
    return out


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document: words, words hit, items found in it, and whether it is contaminated."""
    found = marked(docs.select("doc_id", "text"), benchmark, **how).select("row.doc_id", "found.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    names = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", **how) -> DataFrame:
    """docs without what the benchmark holds: mode "spans" cuts each hit run of words, "documents" drops rows with a hit.

    Rows without a hit stay as they are, null texts too. What is left on either side of a cut is joined
    by a line break. Columns of docs stay; n_chars, if present, follows a changed text.
    """
    if mode not in ("spans", "documents"):
        raise ValueError(f"mode: {mode}")
    found = marked(docs, benchmark, **how)
    spans, text, changed = F.col("found.spans"), F.col("row").getField("text"), {}
    hit = F.size(spans) > 0
    if mode == "documents":
        found = found.where(~hit)
    else:
        raw = F.encode(text, "UTF-8")
        ends = F.arrays_zip(
            F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["to"])).alias("a"),
            F.concat(F.transform(spans, lambda s: s["from"]), F.array(F.octet_length(text).cast("long"))).alias("b"),
        )
        pieces = F.transform(ends, lambda x: F.decode(F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "UTF-8"))
        found = found.withColumn("left", F.when(hit, F.array_join(F.filter(pieces, lambda x: F.trim(x) != ""), "\n")).otherwise(text))
        changed["text"] = F.col("left")
        if "n_chars" in docs.columns:
            changed["n_chars"] = F.when(hit, F.length("left")).otherwise(F.col("row").getField("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
