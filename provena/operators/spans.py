"""Joins of points with spans and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import blank, line_count, quoted_in, squash
from provena.operators.storage import kept

#: Lines by which a quote may be off.
TOLERANCE = 3
#: Up to so many spans of a key, each of its points meets them all.
FEW_SPANS = 32


def _bits(c: Column) -> Column:
    """The largest power of two, as its exponent, that a number above 0 has."""
    return F.length(F.bin(c)) - 1


def nodes(lo: Column, hi: Column) -> Column:
    """The fewest (level, node) whose dyadic stretches, node * 2 ** level and so many from there, make up lo to hi: at most two a level, whatever the length."""
    shift = lambda c, level: F.call_function("shiftright", c, level)

    def of(level: Column) -> Column:
        first, end = -shift(-lo, level), shift(hi + 1, level)
        there = first < end
        node = lambda n: F.struct(level.alias("level"), n.alias("node"))
        odd = lambda c: c.bitwiseAND(F.lit(1).cast("long")) == 1
        return F.array(F.when(there & odd(first), node(first)), F.when(there & odd(end), node(end - 1)))

    levels = F.sequence(F.lit(0), _bits(hi - lo + 1))
    return F.filter(F.flatten(F.transform(levels, of)), lambda x: x.isNotNull())


def ancestors(at: Column, top: int) -> Column:
    """The (level, node) up to level `top` that a point lies in: one a level."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("node")) for k in range(top + 1)])


def _top(spans: DataFrame, lo: str, hi: str) -> int:
    """The highest level that nodes() of these spans can have."""
    return spans.agg(F.max(_bits(F.col(hi) - F.col(lo) + 1))).first()[0] or 0


def overlaps(items: DataFrame, ranges: DataFrame, key: str, tolerance: int = 0, how: str = "left_semi") -> DataFrame:
    """items (key, start, end) that some range (key, start, end) overlaps; how="left_anti" for the others, "flag" for all with a column `hit`.

    Two stretches overlap where one has the other's start. A stretch is a few dyadic nodes, a start has one
    ancestor a level, so both cases are equi joins on (key, level, node), for stretches of any length: no
    row for each bucket and no comparison besides. Stretches that end before they start overlap nothing.
    """
    if how not in ("left_semi", "left_anti", "flag"):
        raise ValueError(how)
    r = ranges.select(F.col(key).alias("_k"), (F.col("start") - tolerance).cast("long").alias("_lo"), (F.col("end") + tolerance).cast("long").alias("_hi")).where("_lo <= _hi")
    numbered = items.withColumn("_id", F.struct(key, "start", "end"))
    i = numbered.select("_id", F.col(key).alias("_k"), F.col("start").cast("long").alias("_lo"), F.col("end").cast("long").alias("_hi")).where("_lo <= _hi").distinct()
    on = ["_k", "level", "node"]
    each = lambda df, array, *more: df.select(*more, "_k", F.explode(array).alias("_x")).select(*more, "_k", "_x.level", "_x.node")
    inside = each(i, ancestors(F.col("_lo"), _top(r, "_lo", "_hi")), "_id").join(each(r, nodes(F.col("_lo"), F.col("_hi"))).distinct(), on, "left_semi")
    around = each(i, nodes(F.col("_lo"), F.col("_hi")), "_id").join(each(r, ancestors(F.col("_lo"), _top(i, "_lo", "_hi"))).distinct(), on, "left_semi")
    ids = inside.select("_id").unionByName(around.select("_id")).distinct()
    if how == "flag":
        return numbered.join(ids.withColumn("hit", F.lit(True)), "_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("_id")
    return numbered.join(ids, "_id", how).drop("_id")


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, point_id: str, name: str, order: str) -> DataFrame:
    """For each point the name of the smallest span (key, start, end) around it; of equal ones that of the last `order`. Null if there is none.

    A key's spans, where they are few, meet the key's points as they are. Of more, the best span of each dyadic
    node is found first, so a point meets one row for each level however many spans are around it.
    """
    size, late = (F.col("_hi") - F.col("_lo")).alias("size"), (-F.col("_order")).alias("late")
    s = spans.where(F.col("start") <= F.col("end")).select(F.col(key).alias("_k"), F.col("start").cast("long").alias("_lo"), F.col("end").cast("long").alias("_hi"), F.col(name).alias("_name"), F.col(order).alias("_order"))
    p = points.select(F.col(point_id).alias("_id"), F.col(key).alias("_k"), F.col(at).cast("long").alias("_at")).where("_k is not null")
    many = kept(s.where("_k is not null").groupBy("_k").agg(F.count("*").alias("_n")).where(F.col("_n") > FEW_SPANS).select("_k"))
    some = not many.isEmpty()
    few_s, few_p = (x.join(many, "_k", "left_anti") if some else x for x in (s, p))
    near = few_p.join(few_s, "_k").where("_at between _lo and _hi")
    found = near.select("_id", F.struct(size, late).alias("_rank"), "_name")
    if some:
        s, p = (x.join(many, "_k", "left_semi") for x in (s, p))
        cut_up = s.select("_k", F.struct(size, late).alias("_rank"), "_name", F.explode(nodes(F.col("_lo"), F.col("_hi"))).alias("_x"))
        best = cut_up.groupBy("_k", F.col("_x.level").alias("level"), F.col("_x.node").alias("node")).agg(F.min("_rank").alias("_rank"), F.min_by("_name", "_rank").alias("_name"))
        each = p.select("_id", "_k", F.explode(ancestors(F.col("_at"), _top(s, "_lo", "_hi"))).alias("_x")).select("_id", "_k", "_x.level", "_x.node").distinct()
        found = found.unionByName(each.join(best, ["_k", "level", "node"]).select("_id", "_rank", "_name"))
    found = found.groupBy("_id").agg(F.min_by("_name", "_rank").alias(name)).withColumnRenamed("_id", point_id)
    return points.join(found, point_id, "left")


#: What of a document's lines a later part needs: those that still count, with the name that each leads to.
_STACK = "array<struct<indent:int,name:string>>"


def _walk(key_type, n_type):
    """Lines in order to rows: answers (k, n, name), with `limit` where what came before the task's own lines decides, and the stack that a task's first and last document end with."""
    import pyarrow as pa

    stack_type = pa.list_(pa.struct([("indent", pa.int32()), ("name", pa.string())]))
    names = ["k", "n", "name", "part", "limit", "stack"]

    def run(batches):
        from pyspark import TaskContext

        part, keys, last, stack = TaskContext.get().partitionId(), 0, None, []  # stack: (indent, name of it or of the nearest named one before it that still counts)

        def told(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, n_type, pa.string(), pa.int32(), pa.int32(), stack_type], strict=True)], names)

        for batch in batches:
            out = []
            # Runs of one document, then its lines: numbers from Arrow's own buffers.
            indents, counts, asked = (batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in (2, 3, 5))
            ks, ns, said = batch.column(0).to_pylist(), batch.column(1), batch.column(4).to_pylist()
            for j, k in enumerate(ks):
                if not keys or k != last:
                    if keys == 1:
                        out.append((last, None, None, part, None, stack))
                    last, stack, keys = k, [], keys + 1
                indent = indents[j]
                if asked[j]:
                    i = len(stack)
                    while i and stack[i - 1][0] >= indent:
                        i -= 1
                    name = stack[i - 1][1] if i else None
                    limit = min(indent, stack[0][0]) if stack else indent
                    out.append((k, ns[j].as_py(), name, part, limit if name is None and keys == 1 else None, None))
                if counts[j]:
                    while stack and stack[-1][0] >= indent:
                        stack.pop()
                    stack.append((indent, said[j] if said[j] is not None else stack[-1][1] if stack else None))
            yield told(out)
        if keys:
            yield told([(last, None, None, part, None, stack)])

    return run


def _brought(pdf):
    """For each part of a document the stack that the parts before it leave: of theirs what a later part's least indent doesn't end, then its own."""
    import pandas as pd

    pdf, now, out = pdf.sort_values("part"), [], []
    for stack in pdf["stack"]:
        out.append([{"indent": i, "name": x} for i, x in now])
        own = [(x["indent"], x["name"]) for x in stack]
        if own:
            now = [x for x in now if x[0] < own[0][0]]
            over = now[-1][1] if now else None
            now = now + [(i, x if x is not None else over) for i, x in own]
    return pd.DataFrame({"k": pdf["k"], "part": pdf["part"], "brought": out})


def nearest_preceding(targets: DataFrame, lines: DataFrame, key: str, declared: Column, parts: int | None = None) -> DataFrame:
    """For each target line (key, n) the declaration it stands in, going up by indent alone.

    lines has (key, n, line, indent). Going up from a target, only lines that aren't blank and are indented less than all between count; the first of them that `declared` names is the answer.
    Lines are in ranges of (key, n), so a long document is in many tasks. One pass over a task's lines keeps
    those that still count. What a part of a document leaves is a summary that can be put after another's; by
    it the targets are answered that no line of their own part decides.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    wanted = targets.select(F.col(key).alias("_k"), F.col("n").alias("_n")).distinct().withColumn("_wanted", F.lit(True))
    rows = lines.select(F.col(key).alias("_k"), F.col("n").alias("_n"), F.col("indent").cast("int").alias("_indent"), (~blank(F.col("line"))).alias("_counts"), declared.alias("_name"))
    rows = rows.join(wanted, ["_k", "_n"], "left").withColumn("_wanted", F.col("_wanted").isNotNull()).select("_k", "_n", "_indent", "_counts", "_name", "_wanted")
    rows = rows.repartitionByRange(*([parts] if parts else []), "_k", "_n").sortWithinPartitions("_k", "_n")
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = f"k {kinds['_k'].simpleString()}, n {kinds['_n'].simpleString()}, name string, part int, limit int, stack {_STACK}"
    found = kept(rows.mapInArrow(_walk(to_arrow_type(kinds["_k"]), to_arrow_type(kinds["_n"])), schema))
    brought = found.where("stack is not null").groupBy("k").applyInPandas(_brought, f"k {kinds['_k'].simpleString()}, part int, brought {_STACK}")
    before = F.element_at(F.filter("brought", lambda x: x["indent"] < F.col("limit")), -1)["name"]
    own = found.where("n is not null and limit is null").select("k", "n", "name")
    # Few: those in the first document of a task with nothing named above them in it.
    open_ones = found.where("limit is not null").select("k", "n", "part", "limit").join(brought, ["k", "part"])
    late = open_ones.select("k", "n", F.when(F.exists("brought", lambda x: x["indent"] < F.col("limit")), before).alias("name"))
    return targets.join(own.unionByName(late).withColumnsRenamed({"k": key}), [key, "n"], "left")


def window_text(lines: Column, start: Column, end: Column, more: Column) -> Column:
    """The lines from TOLERANCE before start to TOLERANCE after end plus `more`, of an array of lines."""
    first = F.greatest(start - TOLERANCE, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), end + more + TOLERANCE - first + 1)), "\n")


def quote_found(lines: Column, quote: Column, start: Column, end: Column) -> Column:
    """Whether a quote stands near the lines it is said to be from. An empty quote does."""
    needle = squash(F.trim(F.trim(F.coalesce(quote, F.lit(""))), F.lit('"')))
    near = squash(window_text(lines, start, end, line_count(quote)))
    return F.when(needle == "", True).otherwise(quoted_in(needle, near))


def context(lines: Column, n: Column, around: int = TOLERANCE) -> Column:
    """The lines around line n."""
    first = F.greatest(n - around, F.lit(1))
    return F.array_join(F.slice(lines, first, n + around - first + 1), "\n")


def bound(rules: DataFrame, files: DataFrame, spans: DataFrame) -> DataFrame:
    """Each rule (id, evidence, source_file, start, end, enclosing) with the first thing that is wrong with its evidence, or null.

    files has (path, lines); spans (path, start, end, name, ord). In order: the reference isn't one, there is no such file, the line isn't in it, the quote isn't near, the enclosing function is another.
    """
    n = F.size("lines")
    inside = innermost(rules.withColumn("_at", F.col("start")), spans.withColumnRenamed("path", "source_file"), "source_file", "_at", "id", "name", "ord").select("id", F.col("name").alias("_actual"))
    out = rules.join(files.withColumnRenamed("path", "source_file"), "source_file", "left").join(inside, "id", "left")
    said = F.col("enclosing")
    free = said.isNull() | said.isin("", "UNCERTAIN")
    module = F.lower(said).isin("module", "модуль", "module-level")
    last = lambda c: F.trim(F.element_at(F.split(c, r"\.", -1), -1))
    problem = (
        F.when(F.col("start").isNull(), "bad reference")
        .when(F.col("lines").isNull(), "no such file")
        .when((F.col("start") < 1) | (F.col("start") > n), "no such line")
        .when(~quote_found(F.col("lines"), F.col("evidence"), F.col("start"), F.col("end")), "quote not found")
        .when(free, None)
        .when(F.col("_actual").isNull(), F.when(~module, "module level"))
        .when(last(said) != last(F.col("_actual")), "other function")
    )
    return out.select(*rules.columns, problem.alias("problem"))
