"""Whether every rule is told once and traced: rules against stories and a trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions.text import blank
from provena.operators import needles
from provena.operators.findings import COLUMNS, finding
from provena.operators.reconcile import dense

# Fixed value: the columns of a trace.
TRACE = ["req_id", "story_id", "rule_id", "source", "confidence", "verdict_stage90"]

def occurrences(rules: DataFrame, lines: DataFrame) -> DataFrame:
    """rules (rule_id) with `times` that they stand in table lines (line); what comes before an id doesn't matter, what comes after ends it."""
    table = lines.where(F.startswith(F.ltrim("line"), F.lit("|")))
    told = needles.occurrences(rules, table, "rule_id", "line", whole=True)
    return rules.select("rule_id").distinct().join(told, "rule_id", "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))


def check(rules: DataFrame, lines: DataFrame, trace: DataFrame, header: list[str] | None, order: str, stories: str = "stories.md", traced: str = "traceability.csv", columns: list[str] = TRACE) -> DataFrame:
    """Findings: rules that stories (line) don't tell once, and what is wrong with a trace (cells: array of text, in order of `order`) with this header.

    A wrong header is all that is said of a trace. Blank rows don't count; rows of another width are in no rule's
    count. A row without source is a finding of its own, by its number among the rows that count, the header being 1.
    """
    told = occurrences(rules, lines).where("times <> 1")
    place = lambda c: F.concat(F.lit("table ("), c, F.lit(")"))
    out = told.select(*finding("completeness", F.lit(stories), place(F.col("rule_id")), F.lit("once in the table"), F.when(F.col("times") == 0, "never").otherwise(F.concat(F.col("times").cast("string"), F.lit(" times")))))
    spark = rules.sparkSession
    if header != columns:
        said = ",".join(header or []) or "(empty)"
        wrong = spark.range(1).select(*finding("completeness", F.lit(traced), F.lit("header"), F.lit(",".join(columns)), F.lit(said)))
        return out.unionByName(wrong).select(*COLUMNS)
    at = {c: i for i, c in enumerate(columns)}
    rows = dense(trace.where(F.exists("cells", lambda c: ~blank(c))), order)
    rows = rows.where(F.size("cells") == len(columns)).select("number", F.trim(F.get("cells", F.lit(at["rule_id"]))).alias("rule_id"), F.get("cells", F.lit(at["source"])).alias("source"))
    ids, known = rows.where("rule_id <> ''").select("rule_id").distinct(), rules.select("rule_id").distinct()
    one = lambda f, path, expected, got: f.select(*finding("completeness", F.lit(traced), path, expected, got))
    counts = known.agg(F.count("*").alias("n")).join(F.broadcast(ids.agg(F.count("*").alias("m")))).where("n <> m")
    name = F.concat(F.lit("rule_id ("), "rule_id", F.lit(")"))
    parts = [
        one(counts, F.lit("rule_id"), F.concat(F.col("n").cast("string"), F.lit(" different ids")), F.concat(F.col("m").cast("string"), F.lit(" different ids"))),
        one(known.join(ids, "rule_id", "left_anti"), name, F.lit("traced"), F.lit("missing")),
        one(ids.join(known, "rule_id", "left_anti"), name, F.lit("a known rule"), F.lit("unknown")),
        one(rows.where(blank(F.col("source"))), F.concat(F.lit("source (row "), (F.col("number") + 2).cast("string"), F.lit(")")), F.lit("a source"), F.lit("(empty)")),
    ]
    for p in parts:
        out = out.unionByName(p)
    return out.select(*COLUMNS)


def stats(rules: DataFrame) -> DataFrame:
    """One row with the map of what was counted."""
    return rules.agg(F.create_map(F.lit("rules_total"), F.count("*")).alias("stats"))


def stats_of(rules: DataFrame, checked: DataFrame, numbers: DataFrame, number: str) -> DataFrame:
    """One row with the map of what the checks counted: rules, those whose evidence was checked, and different numbers in use."""
    one = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")
    each = one("rules_total", rules, F.count("*")).unionByName(one("rules_checked", checked, F.count("*"))).unionByName(one("ids_used", numbers, F.count_distinct(number)))
    return each.agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("stats"))
