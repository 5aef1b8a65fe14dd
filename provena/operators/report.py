"""Tables and summaries as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import percent


def markdown(df: DataFrame, by: list[str]) -> str:
    """A Markdown table of a bounded report, in order of `by`."""
    rows = [df.columns, ["---"] * len(df.columns), *([str(v) for v in r] for r in df.orderBy(*by).collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def cell(items: Column, order: Column) -> Column:
    """An aggregate: the items as one comma-joined cell, in order."""
    ordered = F.array_sort(F.collect_list(F.when(items.isNotNull(), F.struct(order.alias("o"), items.alias("i")))))
    return F.array_join(F.transform(ordered, lambda x: x["i"].cast("string")), ", ")


def within_budget(texts: DataFrame, text: str, by: str, most_kb: int) -> DataFrame:
    """For each bundle its bytes of UTF-8 and whether they fit."""
    return texts.groupBy(by).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes")).withColumn("fits", F.col("bytes") <= most_kb * 1024)


def histogram(rows: DataFrame, verdict: str) -> DataFrame:
    return rows.groupBy(F.trim(verdict).alias("verdict")).agg(F.count("*").alias("n"))


def table_lines(rows: DataFrame, head: list[str], cells: list[Column], order: list[Column], title: str, total: Column | None = None) -> DataFrame:
    """(part, number, line) of a report: its title and head, a table row for each row in order, and a last line made of all rows by the aggregate `total`.

    Sort by part and number to write it; rows are numbered by ranges, so a report may be as long as its data.
    """
    from provena.operators.reconcile import dense

    spark = rows.sparkSession
    top = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    first = spark.createDataFrame([(0, i, t) for i, t in enumerate(top)], "part int, number long, line string")
    each = F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))
    made = dense(rows.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), each.alias("line")), "o")
    out = first.unionByName(made.select(F.lit(1).alias("part"), "number", "line"))
    if total is not None:
        out = out.unionByName(rows.agg(total.alias("line")).select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("number"), "line"))
    return out


def coverage_report(by_path: DataFrame, bare: DataFrame) -> DataFrame:
    """The coverage of paths (path, total, covered, share) and of each the functions without rules (path, name), few a path, in order of path."""
    names = bare.groupBy("path").agg(cell(F.concat(F.lit("`"), "name", F.lit("`")), F.col("line")).alias("names"))
    rows = by_path.join(names, "path", "left")
    cells = [F.concat(F.lit("`"), "path", F.lit("`")), F.col("total"), F.col("covered"), F.col("share"), F.coalesce("names", F.lit("—"))]
    return table_lines(rows, ["module", "branches", "covered", "%", "functions without rules"], cells, [F.col("path")], "Coverage of branches by rules", _summed("total", "covered", 100.0))


def inverse_report(by_rule: DataFrame) -> DataFrame:
    """Rules (rule, total, confirmed, share) in order of rule as text."""
    cells = [F.col("rule"), F.col("total"), F.col("confirmed"), F.col("share")]
    return table_lines(by_rule, ["rule", "predictions", "confirmed", "%"], cells, [F.col("rule").cast("string")], "Predictions against sources", _summed("total", "confirmed", 0.0))


def findings_report(found: DataFrame) -> DataFrame:
    """Findings in order of severity, artifact and path."""
    cells = [F.col(c) for c in ("severity", "artifact", "path", "expected", "got")]
    return table_lines(found, ["severity", "artifact", "path", "expected", "got"], cells, [F.col("severity"), F.col("artifact"), F.col("path"), F.col("expected"), F.col("got")], "Findings", F.concat(F.lit("**Errors: "), F.count_if(F.col("severity") == "error").cast("string"), F.lit("**")))


def _summed(total: str, part: str, empty: float) -> Column:
    n, k = F.coalesce(F.sum(total), F.lit(0)), F.coalesce(F.sum(part), F.lit(0))
    return F.concat(F.lit("**Total: "), k.cast("string"), F.lit("/"), n.cast("string"), F.lit(" = "), percent(k, n, empty).cast("string"), F.lit("%**"))


def as_json(found: DataFrame) -> DataFrame:
    """(json): each finding as a JSON object, nulls left out."""
    return found.select(F.to_json(F.struct(*found.columns)).alias("json"))
