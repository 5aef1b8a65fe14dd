"""Mixing sources to target weights: a low-discrepancy schedule of blocks, by DataFrame functions alone.

Each source's documents are laid end to end in a shuffled order and cut into blocks of equal words. The
points of van der Corput's sequence, mapped through the sources' cumulative shares, say which source each
slot of the mix is from; the k-th slot of a source takes the k-th block of its documents, which begin anew
where they are at their end. So every stretch of the mix has the sources in their shares, up to about the
logarithm of its length, and the whole has them to the word.

Shares weigh the sources; no source is taken more than `MOST` times over, what it can't give is shared by
the others. Nothing here has the size of a source in one task: documents are put in order within buckets of
a hash, buckets by their sums; a slot's rank within its source is a sum over the bits of its number.

Nulls: a null source is a source of its own, the last; a null text has no words; null ids are ids. A row
without words is in no block. Rows that repeat in id, source and text are as many documents. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import cut, kept_table, named
from provena.operators.reconcile import dense

# Fixed value: the weights of the sources in order, which repeat.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more often.
MOST = 3
#: Words of a block.
BLOCK = 1024
SEED = 20240607
#: Documents that are put in order by one window, about; sources that are summed by one.
DOC_BUCKET, BUCKET_ROWS = 1 << 12, 1 << 14
#: Up to so many rows that say which sources a stretch of the schedule has, of about 40 bytes each, go to every task; more are joined by a shuffle.
BROADCAST_CELLS = 1 << 17

_SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """How many runs without white space a text has. Each run, with the white space before it, becomes one letter, so that no list of them is made."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.length(F.rtrim(runs, F.lit(_SPACE))).cast("long")


def _spread(hashed: Column, n: int) -> Column:
    """The bucket of n, in the order of the hashes."""
    return F.least(F.floor(hashed / F.lit(float(1 << 63)) * n), F.lit(n - 1)).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, no_source, source, size, hash): documents without their texts, written once; repeated ones with how many there are in `copies`."""
    # The hash is of id and text, 63 bits of it: copies of a text under other ids are anywhere.
    i, t, s = named([id_col, text_col, source_col])
    rows = docs.select(i.alias("id"), s.isNull().alias("no_source"), F.coalesce(s.cast("string"), F.lit("")).alias("source"), words(t).alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit(SEED), i, t), 1).alias("hash"))
    return kept_table(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "mix-sizes")


def _before(rows: DataFrame, order: str, value: Column, n_rows: int) -> DataFrame:
    """rows, numbered from 0 by `order`, with `before`: the sum of what comes earlier. Buckets of BUCKET_ROWS have a window each, and their sums one."""
    part = rows.withColumn("_b", F.floor(F.col(order) / BUCKET_ROWS))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.withColumn("before", own)
    if n_rows <= BUCKET_ROWS:
        return part.drop("_b")
    sums = part.groupBy("_b").agg(F.sum(value).alias("_s"))
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return part.join(sums, "_b").withColumn("before", F.col("before") + F.col("_base")).drop("_b", "_base")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(no_source, source, number, source_size, weight, target) of the sources.

    The level is what a weight of one gets. It rises from everyone's share: what sources that are full can't
    take is shared by the others, until no further source is full.
    """
    found = sizes.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    found = cut(dense(found, "no_source", "source").withColumn("weight", weight))
    room, full, level = F.col("source_size") * most, 0, None
    total = found.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total[0] or 0) / (total[1] or 1)
    while total[0]:
        over = room < F.col("weight") * level
        now = found.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, room)), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if now[0] == full:
            break
        full, level = now[0], (total[0] - now[1]) / now[2]
    return found.withColumn("target", F.least(room.cast("double"), F.col("weight") * level))


def _reversed(i: Column, bits: int) -> Column:
    """The number whose `bits` binary digits are those of i from the last to the first."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def _rank(i: Column, point: Column, lo: Column, hi: Column, bits: int) -> Column:
    """How many numbers below i have their point from lo up to hi.

    The numbers below i fall apart into one run for each binary digit 1 of i, and the points of such a run
    are evenly spaced.
    """
    rank = F.lit(0).cast("long")
    for b in range(bits):
        step = 1 << (bits - b)
        off = point.bitwiseAND(F.lit((1 << (bits - 1 - b)) - 1).cast("long"))
        upto = lambda end, off=off, step=step, b=b: F.shiftright(end - off + F.lit(step - 1).cast("long"), bits - b)
        rank = rank + F.when(F.shiftright(i, b).bitwiseAND(F.lit(1).cast("long")) == 1, upto(hi) - upto(lo)).otherwise(F.lit(0).cast("long"))
    return rank


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, number, rank) for sources (number, take): slot after slot of the mix, the source that it is from, and the how-manieth of that source it is.

    Slots are numbered by the sequence's own numbers, of which those with points past the last share are left
    out, so up to half of the numbers are missing.
    """
    n_sources, slots = sources.agg(F.count("*"), F.coalesce(F.sum(F.ceil(F.col("take") / block)), F.lit(0)).cast("long")).first()
    bits = max(0, int(slots) - 1).bit_length()
    shares = _before(sources.select("number", F.ceil(F.col("take") / block).cast("long").alias("n")), "number", F.col("n"), n_sources).where("n > 0")
    shares = shares.select("number", F.col("before").cast("long").alias("lo"), (F.col("before") + F.col("n")).cast("long").alias("hi"))
    # Cells are stretches of the unit line, four for each source, so that a point is held against the few sources of its own cell only.
    narrow = max(0, bits - (4 * n_sources).bit_length())
    cells = shares.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", narrow), F.shiftright(F.col("hi") - 1, narrow))))
    if n_sources + (int(slots) >> narrow) + 1 <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    points = sources.sparkSession.range(1 << bits if slots else 0).select(F.col("id").alias("slot")).withColumn("point", _reversed(F.col("slot"), bits)).where(F.col("point") < int(slots))
    hit = points.withColumn("cell", F.shiftright("point", narrow)).join(cells, "cell").where("point >= lo and point < hi")
    return hit.select("slot", "number", _rank(F.col("slot"), F.col("point"), F.col("lo"), F.col("hi"), bits).alias("rank"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with words (id, hash, size) and their source's (number, source, source_size, target, take), with `at`: the words of their source before them in its shuffled order.

    A hash puts them in order: within buckets by a window, buckets by their sums.
    """
    has = sizes.where("size > 0")
    n = max(1, has.count() // DOC_BUCKET)
    row = has.withColumn("bucket", _spread(F.col("hash"), n))
    key = ["no_source", "source", "bucket"]
    all_words = F.col("size") * F.col("copies")
    own = F.coalesce(F.sum(all_words).over(Window.partitionBy(*key).orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = row.groupBy(*key).agg(F.sum(all_words).alias("_s"))
    base = F.coalesce(F.sum("_s").over(Window.partitionBy("no_source", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_base", base).join(sources.select("no_source", "source", "number", "source_size", "target", "take"), ["no_source", "source"]).drop("_s")
    out = row.withColumn("_own", own).join(sums, key).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    at = (F.col("_own") + F.col("_base") + F.col("copy") * F.col("size")).cast("long")
    return out.select("id", "hash", "no_source", "source", "number", "size", "source_size", "target", "take", at.alias("at"))


def _cut_up(docs: DataFrame, block: int) -> DataFrame:
    """The parts that blocks take of documents: each time over that the source is taken, each block that the document reaches into."""
    over = docs.withColumn("_over", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col("take") - F.col("at")) / F.col("source_size")) - 1, F.lit(0)).cast("long"))))
    over = over.where("take > at").withColumn("_from", F.col("_over") * F.col("source_size") + F.col("at"))
    over = over.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("take"))).where("_to > _from")
    each = over.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    first, last = F.greatest("_from", F.col("rank") * block), F.least("_to", (F.col("rank") + 1) * block)
    return each.select("*", (first - F.col("rank") * block).alias("place"), (first - F.col("_from")).alias("first"), (last - first).alias("n"))


def planned(docs: DataFrame, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, documents in place): what the mix and its report are made of."""
    sizes = measured(docs, id_col, text_col, source_col)
    take = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most).cast("long")
    sources = cut(targets(sizes, weights, most).withColumn("take", take))
    return sizes, sources, kept_table(placed(sizes, sources), "mix-places")


def _mixed(sources: DataFrame, docs: DataFrame, block: int) -> DataFrame:
    return _cut_up(docs, block).join(schedule(sources, block), ["number", "rank"])


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: (slot, place, id, hash, source, first, n, size). Words `first` to `first + n` of a document, counted from 0, stand at word `place` of a slot.

    Slots have `block` words, but the last one of a source may have fewer. In order of slot and place it is
    the training order; texts() adds the words.
    """
    _, sources, placed_docs = planned(docs, block, weights, most, id_col, text_col, source_col)
    return _mixed(sources, placed_docs, block).select("slot", "place", "id", "hash", F.when(~F.col("no_source"), F.col("source")).alias("source"), "first", "n", "size")


def texts(mixed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix with the words of each part, one space between two. Documents are found by their hash of id and text."""
    i, t = named([id_col, text_col])
    own = docs.select(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), i, t), 1).alias("hash"), i.alias("id"), t.alias("_text")).dropDuplicates(["hash", "id"])
    found = mixed.join(own, (mixed["hash"] == own["hash"]) & mixed["id"].eqNullSafe(own["id"]), "left").select(*[mixed[c] for c in mixed.columns], "_text")
    runs = F.regexp_extract_all("_text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    return found.withColumn("words", F.array_join(F.slice(runs, (F.col("first") + 1).cast("int"), F.col("n").cast("int")), " ")).drop("_text")


def report(docs: DataFrame, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id_col, size, source_size, target of its source, and `taken`: its words in the mix, repeats counted."""
    sizes, sources, docs_in_place = planned(docs, block, weights, most, id_col, text_col, source_col)
    parts = _mixed(sources, docs_in_place, block)
    doc = ["id", "number", "at", "no_source", "source", "size", "source_size", "target"]
    counted = docs_in_place.select(*doc, F.lit(0).cast("long").alias("n")).unionByName(parts.select(*doc, "n")).groupBy(*doc).agg(F.sum("n").alias("taken"))
    none = sizes.where("size = 0").join(sources.select("no_source", "source", "source_size", "target"), ["no_source", "source"])
    none = none.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("taken", F.lit(0).cast("long"))
    out = ["id", "size", "source_size", "target", "taken", F.when(~F.col("no_source"), F.col("source")).alias("source")]
    return counted.select(*out).unionByName(none.select(*out)).withColumnRenamed("id", id_col)
