"""Branches and functions of source code: Python by its syntax tree, other languages by line patterns."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import line_count, lines, percent, source_ref
from provena.operators.spans import overlaps

# How branches and functions begin in other languages.
_BRANCH = r"^\s*(?:\}?\s*else\s+)?(if|match|switch|raise|throw)\b"
_FUNCTION = r"^\s*(?:public\s+|private\s+|protected\s+|static\s+|async\s+|export\s+)*(?:def|function|func|fn|sub)\s+([A-Za-z_][A-Za-z0-9_]*)"
_CALLABLE = r"^\s*(?:[\w<>\[\],.\s]+\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*\)\s*\{?\s*$"
#: Lines by which a rule may be off from a branch that a line pattern found.
OTHER_TOLERANCE = 3


def _items(source: str) -> Iterator[tuple]:
    """(what, name, line, end) of the branches, the functions under classes and functions, and the spans under classes, decorators included."""
    todo: list[tuple[ast.AST, tuple[str, ...], tuple[str, ...]]] = [(ast.parse(source), (), ())]
    while todo:
        node, outer, classes = todo.pop(0)
        kind = {ast.Raise: "raise", ast.If: "if", ast.Match: "match"}.get(type(node))
        if kind:
            yield ("branch", kind, node.lineno, node.end_lineno)
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            yield ("function", ".".join((*outer, node.name)), node.lineno, node.end_lineno)
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            yield ("span", ".".join((*classes, node.name)), first, node.end_lineno)
            outer = (*outer, node.name)
        elif isinstance(node, ast.ClassDef):
            outer, classes = (*outer, node.name), (*classes, node.name)
        todo += [(child, outer, classes) for child in ast.iter_child_nodes(node)]


#: A batch of items ends with the file that brings it to so many rows.
BATCH_ROWS = 1 << 14


def _parsed(source: str | None) -> list[tuple]:
    try:
        return [(*x, i) for i, x in enumerate(_items(source or ""))]
    except (SyntaxError, ValueError, RecursionError) as e:
        return [("error", str(e)[:200], None, None, 0)]


def _branches_by_line(source: str | None) -> list[tuple]:
    found = sorted((line, name, end) for what, name, line, end, _ in _parsed(source) if what == "branch")
    return [(i, name, line, end) for i, (line, name, end) in enumerate(found)]


def _each_file(files: DataFrame, rows_of, **columns: str) -> DataFrame:
    """path and these columns (name=type) of the rows that rows_of gives for each file's text, in Arrow batches."""

    def run(batches):
        import pyarrow as pa

        kinds = [{"string": pa.string(), "int": pa.int32()}[kind] for kind in columns.values()]

        def made(path_kind, paths, rows):
            cells = [[row[i] for row in rows] for i in range(len(kinds))]
            return pa.RecordBatch.from_arrays([pa.array(paths, path_kind), *map(pa.array, cells, kinds)], ["path", *columns])

        for batch in batches:
            path_kind, paths, rows = batch.schema.field(0).type, [], []
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                found = rows_of(text.as_py())
                rows += found
                paths += [path.as_py()] * len(found)
                if len(rows) >= BATCH_ROWS:
                    yield made(path_kind, paths, rows)
                    paths, rows = [], []
            yield made(path_kind, paths, rows)

    path_kind = files.schema["path"].dataType.simpleString()
    return files.select("path", "text").mapInArrow(run, f"path {path_kind}, " + ", ".join(f"{name} {kind}" for name, kind in columns.items()))


def python_items(files: DataFrame) -> DataFrame:
    """(path, what, name, line, end, ord) of Python files (path, text); a file that can't be parsed has one row `error`.

    what is branch, function, span or error. Nothing is registered in the session, so callers don't meet.
    """
    return _each_file(files, _parsed, what="string", name="string", line="int", end="int", ord="int")


def python_branches(files: DataFrame) -> DataFrame:
    """(path, number, name, line, end) of the branches of Python files (path, text), numbered from 0 by line and then kind. A file that can't be parsed has none."""
    return _each_file(files, _branches_by_line, number="int", name="string", line="int", end="int")


def branch_kind(line: Column) -> Column:
    """What branch a line of another language opens, or null."""
    word = F.regexp_extract(line, _BRANCH, 1)
    return F.when(word == "throw", "raise").when(word == "switch", "match").when(word != "", word)


def function_name(line: Column, calls: bool = False) -> Column:
    """The function that a line declares, or null; with `calls`, anything that looks like the head of one too."""
    name = F.nullif(F.regexp_extract(line, _FUNCTION, 1), F.lit(""))
    return F.coalesce(name, F.nullif(F.regexp_extract(line, _CALLABLE, 1), F.lit(""))) if calls else name


def line_branches(files: DataFrame) -> DataFrame:
    """(path, name, line, end) of the branches of files in other languages."""
    each = files.select("path", F.posexplode(lines(F.col("text"))).alias("n", "line"))
    return each.select("path", branch_kind(F.col("line")).alias("name"), (F.col("n") + 1).alias("line"), (F.col("n") + 1).alias("end")).where("name is not null")


def rule_ranges(rules: DataFrame) -> DataFrame:
    """(path, start, end) of the lines that rules (source, evidence) speak of: to the end of the reference, or of the quote where that is longer. Sources that are no reference have none."""
    at = source_ref(F.col("source"))
    tall = F.greatest(line_count(F.col("evidence").cast("string")) - 1, F.lit(0))
    out = rules.select(at.alias("r"), tall.alias("more")).where("r is not null")
    return out.select(F.col("r.file").alias("path"), F.col("r.start").alias("start"), F.greatest(F.col("r.end"), F.col("r.start") + F.col("more")).alias("end"))


def ranges_by_file(ranges: DataFrame) -> DataFrame:
    """(path, ranges): a file's own ranges (start, end), in order."""
    return ranges.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def coverage(items: DataFrame, ranges: DataFrame, tolerance: int = 0, paths: DataFrame | None = None) -> DataFrame:
    """For each path: branches, those that a rule's range overlaps, their share (100.0 of none). paths (path) adds those without branches."""
    found = overlaps(items.select("path", F.col("line").alias("start"), "end"), ranges, "path", tolerance, "flag")
    out = found.groupBy("path").agg(F.count("*").alias("total"), F.count_if("hit").alias("covered"))
    if paths is not None:
        out = paths.select("path").distinct().join(out, "path", "left").fillna({"total": 0, "covered": 0})
    return out.withColumn("share", percent(F.col("covered"), F.col("total"), 100.0))


def without_rules(functions: DataFrame, ranges: DataFrame) -> DataFrame:
    """functions (path, name, line, end) that no rule's range overlaps, always exactly."""
    return overlaps(functions.select("path", "name", F.col("line").alias("start"), "end"), ranges, "path", 0, "left_anti").select("path", "name", F.col("start").alias("line"), "end")


def total_coverage(by_path: DataFrame) -> DataFrame:
    """The sums over all paths."""
    n = by_path.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))
    return n.withColumn("share", percent(F.col("covered"), F.col("total"), 100.0))
