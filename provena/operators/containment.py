"""Which texts hold which passages: normalised containment, hints, shares of confirmed expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import PLACEHOLDER, needle_pattern, normalise, percent
from provena.operators import needles
from provena.operators.storage import kept

HOLE = "\u0001"
#: Words of an anchor: the most of these that a passage has in one run. Shorter ones may be in every text: two names that each are common make a rare run only together.
ANCHORS = (6, 3, 1)
#: Up to so many different anchors, 16 bytes each, go to every task; more are joined by a shuffle of hashes.
BROADCAST_ANCHORS = 1 << 21
#: Passages without an anchor go to every task, in parts of about so many bytes.
SHORT_BYTES = needles.PART_BYTES


def _hashes(words: Column, k: int, first: Column, last: Column) -> Column:
    """Hashes of the runs of k words that begin at the places from first to last, counted from 0."""
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def anchors(p: DataFrame, passage_id: str, k: int) -> DataFrame:
    """(passage_id, _h) of the runs of k words inside prepared passages that no placeholder is in."""
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - k - 1), lambda i: F.struct(F.array_join(F.slice("_w", i + 1, k), " ").alias("r"), F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(k)]).alias("h")))
    free = F.transform(F.filter(runs, lambda r: ~F.contains(r["r"], F.lit(HOLE))), lambda r: r["h"])
    return p.select(passage_id, F.explode(F.array_distinct(free)).alias("_h"))


def different(anchors: DataFrame) -> DataFrame:
    """Each anchor once, broadcast where they are few enough."""
    every = anchors.select("_h").distinct()
    return F.broadcast(every) if every.count() <= BROADCAST_ANCHORS else every


def runs_of(t: DataFrame, text_id: str, ks: list[int]) -> DataFrame:
    """(text_id, _h) of the different runs of so many words, for each of ks, of normalised texts `_t`."""
    words = t.select(text_id, F.split("_t", " ").alias("_w"))
    runs = [F.coalesce(_hashes(F.col("_w"), k, F.lit(0), F.size("_w") - k), F.array().cast("array<bigint>")) for k in ks]
    return words.select(text_id, F.explode(F.array_distinct(F.concat(*runs))).alias("_h"))


def by_rarest(anchors: DataFrame, seen: DataFrame, passage_id: str, text_id: str) -> DataFrame:
    """(passage_id, text_id) of the texts that have a passage's rarest anchor; seen (text_id, _h) has the anchors' texts."""
    often = seen.groupBy("_h").agg(F.count("*").alias("_n"))
    # An anchor that no text has rules its passage out; of the others the rarest makes fewest candidates.
    rarest = anchors.join(often, "_h", "left").groupBy(passage_id).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_h").alias("h"))).alias("_r"))
    rarest = rarest.where("_r.n > 0").select(passage_id, F.col("_r.h").alias("_h"))
    return seen.join(rarest, "_h").select(passage_id, text_id)


def _candidates(p: DataFrame, t: DataFrame, passage_id: str, text_id: str, ks: list[int]) -> DataFrame:
    """(passage_id, text_id) of the texts that have a passage's rarest anchor of `_k` words. Only hashes and ids are shuffled."""
    own = None
    for k in ks:
        some = anchors(p.where(F.col("_k") == k), passage_id, k)
        own = some if own is None else own.unionByName(some)
    own = kept(own)
    seen = kept(runs_of(t, text_id, ks).join(different(own), "_h"))
    return by_rarest(own, seen, passage_id, text_id)


def prepared(passages: DataFrame, passage_id: str) -> DataFrame:
    """Passages normalised (`_p`), with holes for placeholders, in words (`_w`), as a pattern where they have placeholders (`_n`), and with the words of an anchor (`_k`; 0: none)."""
    p = passages.select(passage_id, normalise(F.col("text")).alias("_p")).where("_p <> ''").withColumn("_q", F.regexp_replace("_p", PLACEHOLDER, HOLE))
    p = p.withColumn("_w", F.split("_q", " ")).withColumn("_n", F.when(F.contains("_q", F.lit(HOLE)), needle_pattern(F.col("_p"))))
    clean = F.transform(F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))), lambda w: ~F.contains(w, F.lit(HOLE)))
    run = lambda k: F.exists(F.sequence(F.lit(0), F.greatest(F.size("_w") - 2 - k, F.lit(0))), lambda i: (F.size("_w") - 2 >= k) & F.forall(F.slice(clean, i + 1, k), lambda x: x))
    return p.withColumn("_k", F.coalesce(*[F.when(run(k), k) for k in ANCHORS], F.lit(0)))


def stands() -> Column:
    """Whether a prepared passage stands in a normalised text `_t`."""
    return F.contains("_t", "_p") | F.coalesce(F.regexp_like("_t", F.col("_n")), F.lit(False))


def containing(passages: DataFrame, texts: DataFrame, passage_id: str, text_id: str) -> DataFrame:
    """(passage_id, text_id) of each passage whose normalised text stands in a normalised text; a placeholder in it also stands for a number.

    The words in a passage but its first and last are whole words wherever it stands, so a run of them that
    no placeholder is in is an anchor that its text has too: an equi join on hashes finds all candidates.
    Passages without such words, one or two in all, are looked for by an automaton of all of them. Empty
    passages stand nowhere.
    """
    p = kept(prepared(passages, passage_id))
    sizes = {r["_k"] for r in p.select("_k").distinct().collect()}
    t = texts.select(text_id, normalise(F.col("text")).alias("_t"))
    out = None
    if ks := [k for k in ANCHORS if k in sizes]:
        near = _candidates(p, t, passage_id, text_id, ks)
        # Texts are normalised again where they are candidates, which few are.
        found = near.join(p.select(passage_id, "_p", "_n"), passage_id).join(texts.select(text_id, F.col("text").alias("_raw")), text_id)
        out = found.withColumn("_t", normalise(F.col("_raw"))).where(stands()).select(passage_id, text_id)
    if 0 in sizes:
        found = needles.standing(p.where("_k = 0"), t, passage_id, text_id, "_p", "_t", "_n", PLACEHOLDER, SHORT_BYTES)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else p.select(passage_id).where("false").join(t.select(text_id).where("false"))


def first_found(passages: DataFrame, hits: DataFrame, passage_id: str, text_id: str, hinted: Column) -> DataFrame:
    """passages with found_in: the first text that `hinted` holds for, else the first of all, else null."""
    found = hits.join(passages, passage_id).groupBy(passage_id).agg(F.coalesce(F.min(F.when(hinted, F.col(text_id))), F.min(text_id)).alias("found_in"))
    return passages.join(found, passage_id, "left")


def confirmed(found: DataFrame, group: Column, label: Column, rules: DataFrame | None = None) -> DataFrame:
    """By group: expectations, confirmed ones, their share (0.0 of none), and the others' labels in order.

    rules (rule) adds those without expectations. The labels are one text a rule: a rule's own predictions
    are few; misses() has them as rows, whatever their number.
    """
    ok = F.col("found_in").isNotNull()
    out = found.groupBy(group.alias("rule")).agg(F.count("*").alias("total"), F.count_if(ok).alias("confirmed"), F.array_join(F.array_sort(F.collect_list(F.when(~ok, label))), ",").alias("unconfirmed"))
    if rules is not None:
        out = rules.select("rule").distinct().join(out, "rule", "left").fillna({"total": 0, "confirmed": 0, "unconfirmed": ""})
    return out.withColumn("share", percent(F.col("confirmed"), F.col("total"), 0.0))


def misses(found: DataFrame, group: Column, label: Column) -> DataFrame:
    """(rule, label) of the expectations that no text confirms."""
    return found.where("found_in is null").select(group.alias("rule"), label.alias("label"))
