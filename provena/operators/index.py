"""A kept index of texts by content: what containment makes of a text is made once, for all checks and all corpora.

Contents are named by 128 bits of their SHA-256. A content's normalised text and the least hashes of its windows of
runs of words are written once, in a part of the index, in slots by leading bits, so that a use reads the slots that its
anchors and candidates fall in. A corpus is a table of ids and contents. A manifest, written last, says which
parts and corpora hold: what died before it is as if it hadn't begun.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions.text import PLACEHOLDER, normalise
from provena.operators import containment, needles
from provena.operators.storage import kept, modest_batches

#: A slot has about so many bytes of text, or of hashes.
SLOT_BYTES = 32 << 20
#: At most 2 to the power of so many slots a part, whose numbers the driver may hold.
MOST_BITS = 16

#: Words of a run, and runs of a window, of which the least hash is kept: two kept of five runs, about.
RUN, WINDOW = 3, 4
#: The form of the hashes; a part with those of another can't be used before it is compacted.
HASHES = 2
#: Bytes of texts that one numpy pass takes; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20

_TEXTS = "content binary, no long, text string, slot int"
_RUNS = "h long, no long, slot int"


def content(text: Column) -> Column:
    """The name of a text's content; null is as empty."""
    return F.substring(F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)), 1, 16)


def least_of_windows(text: Column) -> Column:
    """The least hash of each window of runs of words of a normalised text, each once, windows with a placeholder left out; words within a text have a window's least hash wherever they stand."""

    def run(texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        sizes, values, at = [], [], 0
        while at < len(texts):
            # As many texts as a slice has, one at least.
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            own, h = _least(texts.slice(at, to - at))
            sizes.append(own)
            values.append(h)
            at = to
        starts = np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([np.empty(0, np.int64), *values])))

    return F.arrow_udf(run, "array<long>")(text)


def _least(texts) -> tuple[np.ndarray, np.ndarray]:
    """least_of_windows() of an Arrow array of texts: how many hashes each has, and the hashes."""
    import pandas as pd
    import pyarrow.compute as pc

    words, span = pc.split_pattern(texts, " "), RUN + WINDOW - 1
    of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    if len(of) < span:
        return np.zeros(len(texts), np.int64), np.empty(0, np.int64)
    coded = words.flatten().dictionary_encode()
    hole = pc.match_substring(coded.dictionary, containment.HOLE).to_numpy(zero_copy_only=False)
    # Each different word is hashed once.
    w = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy()]
    holes = np.cumsum(np.concatenate([[False], hole[coded.indices.to_numpy()]]))
    h = np.zeros(len(w) - RUN + 1, np.uint64)
    for j in range(RUN):
        h = (h ^ w[j : len(h) + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    n = len(w) - span + 1
    least = h[:n].copy()
    for j in range(1, WINDOW):
        np.minimum(least, h[j : n + j], out=least)
    at = np.flatnonzero((of[:n] == of[span - 1 :]) & (holes[span:] == holes[:n]))
    # Most that are the same are next to each other, so that few are sorted.
    own, least = _without_repeats(of[at], least[at])
    order = np.lexsort((least, own))
    own, least = _without_repeats(own[order], least[order])
    # What is least begins with zeros: mixed again, so that slots by leading bits are of one size.
    return np.bincount(own, minlength=len(texts)), (least * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _without_repeats(own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (least[1:] != least[:-1])
    return own[first], least[first]


def _slot_of_hash(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def _slot_of_text(no: Column) -> Column:
    """The task that numbered and wrote a text: what monotonically_increasing_id has in front."""
    return F.shiftrightunsigned(no, 33).cast("int")


def _bits(size: int) -> int:
    return min(MOST_BITS, max(0, (size // SLOT_BYTES).bit_length()))


class Index:
    """An index in a folder that driver and executors share. One writer at a time: of two, the later one's manifest is an error."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        modest_batches(spark)
        self.state = {"version": 0, "parts": [], "corpora": {}}
        try:
            last = spark.read.schema("version int, state string").json(f"{self.folder}/manifest/*").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        if last:
            self.state = json.loads(last["state"])

    def _say(self, state: dict) -> None:
        state["version"] += 1
        row = self.spark.createDataFrame([(state["version"], json.dumps(state))], "version int, state string")
        row.coalesce(1).write.mode("errorifexists").json(f"{self.folder}/manifest/v{state['version']}")
        self.state = state

    def corpus(self, name: str) -> DataFrame:
        """(id, content) of a corpus, an id of whatever type and name it was put with."""
        return self.spark.read.parquet(f"{self.folder}/corpora/{self.state['corpora'][name]}").drop("bytes")

    def _contents(self) -> DataFrame:
        out = self.spark.createDataFrame([], _TEXTS)
        for part in self.state["parts"]:
            out = out.unionByName(self.spark.read.schema(_TEXTS).parquet(f"{self.folder}/texts/{part['name']}"))
        return out

    def put(self, texts: DataFrame, text_id: str, name: str) -> int:
        """Makes texts (text_id, text) the corpus of this name, instead of the one before; the number of contents that were new.

        Every text is hashed; only contents that no corpus had are normalised and indexed, copies once. Ids may
        be null or come more than once. Contents that no corpus has any more stay, and are found for none.
        """
        named, state = uuid.uuid4().hex, json.loads(json.dumps(self.state))
        texts = texts.select(text_id, "text").withColumn("content", content(F.col("text")))
        texts.select(text_id, "content", F.octet_length("text").cast("long").alias("bytes")).write.parquet(f"{self.folder}/corpora/{named}")
        members = self.spark.read.parquet(f"{self.folder}/corpora/{named}")
        # One row stands for a content, so that a text with many copies travels once, or as often as its row is repeated.
        new = members.groupBy("content").agg(F.min(text_id).alias("_id"), F.max("bytes").alias("bytes")).join(self._contents().select("content"), "content", "left_anti")
        new = kept(new)
        n, size = new.agg(F.count("*"), F.sum("bytes")).first()
        if n:
            one = new.select(F.col("content").alias("_c"), "_id")
            one = F.broadcast(one) if n <= containment.BROADCAST_ANCHORS else one
            own = texts.join(one, (F.col("content") == F.col("_c")) & F.col(text_id).eqNullSafe(F.col("_id")))
            state["parts"].append(self._part(own.select("content", normalise(F.col("text")).alias("text")), size or 0))
        state["corpora"][name] = named
        self._say(state)
        return n

    def _part(self, new: DataFrame, size: int) -> dict:
        """A part of contents (content, text), of which some rows may be repeated; size: their texts' bytes, about."""
        name, bits = uuid.uuid4().hex, _bits(size)
        # A slot is a task, so that a text's number tells its slot.
        texts = new.repartition(1 << bits, "content").dropDuplicates(["content"])
        texts = texts.select("content", F.monotonically_increasing_id().alias("no"), "text", F.spark_partition_id().alias("slot"))
        texts.write.partitionBy("slot").parquet(f"{self.folder}/texts/{name}")
        texts = self.spark.read.schema(_TEXTS).parquet(f"{self.folder}/texts/{name}")
        # A hash and a number for each fifteen bytes or so.
        run_bits = _bits(size)
        runs = texts.select("no", least_of_windows(F.col("text")).alias("_a")).select("no", F.explode("_a").alias("h")).withColumn("slot", _slot_of_hash(F.col("h"), run_bits))
        # Rebalanced, not repartitioned: the slot of a run that all texts have is split where it gets too large.
        runs.hint("rebalance", "slot").write.partitionBy("slot").parquet(f"{self.folder}/runs/{name}")
        return {"name": name, "bits": bits, "run_bits": run_bits, "hashes": HASHES}

    def _read(self, what: str, schema: str, part: dict, slots: DataFrame, bits: int) -> DataFrame:
        """A part's rows in the slots that are named; their numbers, bounded by MOST_BITS, are all that the driver gets."""
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{what}/{part['name']}")
        asked = [r[0] for r in slots.distinct().collect()]
        return rows if len(asked) == 1 << bits else rows.where(F.col("slot").isin(asked))

    def _seen(self, anchors: DataFrame) -> DataFrame:
        """(_h, _at): the texts, by part and number, that have the anchors."""
        every, out = containment.different(anchors), self.spark.createDataFrame([], "_h long, _at struct<part:int,no:long>")
        for i, part in enumerate(self.state["parts"]):
            if part.get("hashes") != HASHES:
                raise ValueError("the index has hashes of an older form; compact() makes them anew")
            rows = self._read("runs", _RUNS, part, anchors.select(_slot_of_hash(F.col("_h"), part["run_bits"])), part["run_bits"])
            out = out.unionByName(rows.select(F.col("h").alias("_h"), F.struct(F.lit(i).alias("part"), "no").alias("_at")).join(every, "_h"))
        return kept(out)

    def containing(self, passages: DataFrame, name: str, passage_id: str) -> DataFrame:
        """(passage_id, id) of each passage whose normalised text stands in a text of the corpus, as containment.containing has it of the texts themselves.

        The corpus isn't read, but its ids and contents are. Of the index, a use reads the slots with anchors of
        passages and with candidates' texts; passages without an anchor, of fewer than RUN + WINDOW - 1
        words between the first and the last, or with placeholders that leave no such stretch, are looked for
        by an automaton in all its normalised texts. A passage without an id has no row.
        """
        members = self.corpus(name)
        p = containment.prepared(passages, passage_id).withColumn("_a", least_of_windows(F.array_join(F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))), " ")))
        p = kept(p.where(F.col(passage_id).isNotNull()).select(passage_id, "_p", "_n", "_a"))
        found = self.spark.createDataFrame([], T.StructType([p.schema[passage_id], T.StructField("content", T.BinaryType())]))
        own, short = p.select(passage_id, F.explode("_a").alias("_h")), p.where(F.size("_a") == 0)
        # A text in which a passage stands has all its anchors, whatever other corpora have.
        near = kept(containment.by_rarest(own, self._seen(own), passage_id, "_at")).select(passage_id, "_at.part", "_at.no")
        for i, part in enumerate(self.state["parts"]):
            here = near.where(F.col("part") == i)
            texts = self._read("texts", _TEXTS, part, here.select(_slot_of_text(F.col("no"))), part["bits"])
            # Texts that are no candidates stay where they are.
            some = kept(here.select("no").distinct())
            texts = texts.join(F.broadcast(some) if some.count() <= containment.BROADCAST_ANCHORS else some, "no", "left_semi")
            both = here.join(texts.select("content", "no", F.col("text").alias("_t")), "no").join(p.select(passage_id, "_p", "_n"), passage_id)
            found = found.unionByName(both.where(containment.stands()).select(passage_id, "content"))
        if not short.isEmpty():
            t = self._contents().select("content", F.col("text").alias("_t"))
            found = found.unionByName(needles.standing(short, t, passage_id, "content", "_p", "_t", "_n", PLACEHOLDER, containment.SHORT_BYTES))
        return found.join(members, "content").select(passage_id, *[c for c in members.columns if c != "content"])

    def compact(self) -> None:
        """All parts as one, with hashes of the present form and without the contents that no corpus has. Files of the old parts stay until the folder is cleared."""
        if len(self.state["parts"]) < 2 and all(p.get("hashes") == HASHES for p in self.state["parts"]):
            return
        state, held = json.loads(json.dumps(self.state)), None
        for name in state["corpora"]:
            own = self.corpus(name).select("content")
            held = own if held is None else held.unionByName(own)
        left = self._contents().select("content", "text").join(held, "content", "left_semi")
        state["parts"] = [self._part(left, self._contents().agg(F.sum(F.octet_length("text"))).first()[0] or 0)]
        self._say(state)
