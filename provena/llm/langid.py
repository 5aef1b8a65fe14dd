"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character pairs and triples of lower-cased words (a word's ends count as a character) fall into
2 ** BITS buckets. Document frequencies come from all documents that may be learned from; weights from a
bounded sample of them, by follow-the-regularised-leader with an elastic-net penalty in a few shards
whose weights are averaged; one temperature, fitted on sampled rows kept out of that, scales the logits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import fresh, modest_batches, named, text_slices, without

BITS = 16
SHARDS = 4
UNKNOWN = "und"
#: Rows a language gives to the sample that weights are learned from.
SAMPLE_PER_LANGUAGE = 1500
#: More values of lang than this are no languages: weights are a table of this many columns at most, which goes to every task.
MOST_LANGUAGES = 512
#: Bytes of text that one pass looks at.
PASS_BYTES = 250_000

_SCALE = 40.0
_letters: list[np.ndarray] = []


def _grams(rows: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(row, bucket)] of the pairs, then of the triples, in order of rows."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x32000)]))
    text = pc.utf8_lower(pc.fill_null(rows.column("text").cast(pa.large_string()), ""))
    starts = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(text)) + 1)])
    code = np.frombuffer(("\n" + "\n".join(text.to_pylist()) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[0][np.minimum(code, 0x31FFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:] & ~letter[:-1]
    at = np.flatnonzero(keep)
    c = np.where(letter, code, 0)[at].astype(np.uint64)
    row = np.repeat(np.arange(len(starts)), np.diff(np.searchsorted(at, np.concatenate([starts, [len(code)]]))))
    row = np.minimum(row, rows.num_rows - 1)
    key, shift, n = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS), len(c)
    out = []
    if n > 1:
        a, b = c[:-1], c[1:]
        # Element at - 1 of a text is the line break before it, so a pair belongs to the text of its letter.
        own = np.flatnonzero((a != 0) | (b != 0))
        of = np.where(a[own] != 0, own, own + 1)
        out.append((row[of], ((((a[own] << np.uint64(21)) | b[own] | np.uint64(1 << 62)) * key) >> shift).astype(np.int64)))
    if n > 2:
        own = np.flatnonzero(c[1:-1] != 0)
        x = (c[own] << np.uint64(42)) | (c[own + 1] << np.uint64(21)) | c[own + 2]
        out.append((row[own + 1], ((x * key) >> shift).astype(np.int64)))
    return out


def _by_row(rows: pa.RecordBatch) -> list[np.ndarray]:
    """All buckets of each row."""
    parts = [np.split(b, np.searchsorted(r, np.arange(1, rows.num_rows))) for r, b in _grams(rows)]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(rows.num_rows)]


def _frequencies(batches):
    seen, total = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int64)
    for rows, _, _ in text_slices(batches, most=PASS_BYTES):
        for b in _by_row(rows):
            seen[:] = False
            seen[b] = True
            total += seen
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def _sparse(batches):
    for rows, _, _ in text_slices(batches, most=PASS_BYTES):
        found = [np.unique(b, return_counts=True) for b in _by_row(rows)]
        yield pa.RecordBatch.from_arrays([rows.column("lang"), rows.column("part"), pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([(f[1] / max(1, f[1].sum())).astype("<f4").tobytes() for f in found], pa.binary())], ["lang", "part", "at", "tf"])


def _weights(z: np.ndarray, n: np.ndarray, alpha: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / alpha + l2))


def fit_leader(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 3, alpha: float = 0.3, l1: float = 0.002, l2: float = 0.001, seed: int = 5) -> np.ndarray:
    """Weights (bucket, class) after follow-the-regularised-leader steps over rows (class, buckets, values)."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, at, x = rows[i]
            w = _weights(z[at], n[at], alpha, l1, l2)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return _weights(z, n, alpha, l1, l2)


@dataclass(frozen=True)
class Model:
    """languages, and for each bucket and language the weight times idf over the temperature; its size is fixed by BITS and the languages."""

    languages: list[str]
    weights: np.ndarray

    def predict(self, rows: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        n, k = rows.num_rows, len(self.languages)
        s, size = np.zeros((n, k)), np.zeros(n)
        for row, bucket in _grams(rows):
            size += np.bincount(row, minlength=n)
            for j in range(k):
                s[:, j] += np.bincount(row, weights=self.weights[j][bucket], minlength=n)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        s /= np.maximum(size, 1)[:, None]
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[b] if m else UNKNOWN for b, m in zip(best, size, strict=True)], np.where(size > 0, p[np.arange(n), best], 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from text and lang of the rows that are not held out and have both; without such rows the model knows no language.

    More than MOST_LANGUAGES values of lang raise an error.
    """
    modest_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    if not counts:
        return Model([], np.zeros((0, 1 << BITS)))
    languages, total = sorted(counts), sum(counts.values())
    df = np.zeros(1 << BITS)
    for r in rows.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    idf = (np.log((1 + total) / (1 + df)) + 1) * _SCALE

    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / (1 << 40)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(SHARDS * 10)).cast("int")
    # The least draws of all tasks, so that rows which repeat a doc_id can't make the sample grow and no order of reading changes it.
    drawn = rows.where(draw < share).orderBy(draw, "doc_id", "text", "lang").limit(2 * per_language * len(languages))
    sample = drawn.select("lang", "text", part.alias("part")).mapInArrow(_sparse, "lang string, part int, at binary, tf binary")
    number = {k: i for i, k in enumerate(languages)}

    def learn(group: pa.Table) -> pa.Table:
        own = []
        for r in group.to_pylist():
            at = np.frombuffer(r["at"], "<i4")
            if len(at):
                own.append((number[r["lang"]], at, np.frombuffer(r["tf"], "<f4") * idf[at]))
        return pa.table({"w": pa.array([fit_leader(own, len(languages)).T.astype("<f4").tobytes()], pa.binary())})

    sample = sample.withColumn("shard", F.when(F.col("part") % 10 == 0, -1).otherwise(F.col("part") % SHARDS))
    made = sample.where("shard >= 0").groupBy("shard").applyInArrow(learn, "w binary").collect()
    shape = (len(languages), 1 << BITS)
    w = (np.mean([np.frombuffer(r["w"], "<f4").reshape(shape) for r in made], axis=0) if made else np.zeros(shape)) * idf
    kept_out = [(number[r["lang"]], w[:, np.frombuffer(r["at"], "<i4")] @ np.frombuffer(r["tf"], "<f4")) for r in sample.where("shard < 0").collect()]
    return Model(languages, w / _temperature(kept_out))


def _temperature(rows: list[tuple[int, np.ndarray]]) -> float:
    """The temperature under which the rows' (class, logits) are most likely; 1 without rows."""
    if not rows:
        return 1.0
    y, s = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])

    def loss(t: float) -> float:
        x = s / t
        return float(np.mean(np.logaddexp.reduce(x, axis=1) - x[np.arange(len(y)), y]))

    return min(np.exp(np.linspace(-3, 3, 121)), key=loss)


def predicted(docs: DataFrame, model: Model):
    """A column of docs' text: struct (lang, score). Only the text goes to Python, and nothing but the struct comes back."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shipped.value
        for batch in texts:
            lang, score = [], [np.zeros(0)]
            for rows, _, _ in text_slices(iter([pa.RecordBatch.from_arrays([batch], ["text"])]), most=PASS_BYTES):
                best, p = own.predict(rows)
                lang += best
                score.append(p)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score))], ["lang", "score"])

    return F.arrow_udf(run, "lang string, score double")(F.col("text"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, which replace columns of those names. A text that is null or has no letters is `und` with score 0."""
    frame = without(docs, "lang_pred", "score")
    (own,) = fresh(frame, "found")
    return frame.withColumn(own, predicted(frame, model)).select(*named(frame.columns), F.col(f"{own}.lang").alias("lang_pred"), F.col(f"{own}.score").alias("score"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: whether it was held out from learning, the predicted language, and the calibrated score."""
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs without the rows that are `und` or whose best language scores under `least`; no column is changed, whatever its name."""
    (own,) = fresh(docs, "found")
    found = docs.withColumn(own, predicted(docs, train(docs)))
    return found.where((F.col(f"{own}.lang") != UNKNOWN) & (F.col(f"{own}.score") >= least)).select(*named(docs.columns))
