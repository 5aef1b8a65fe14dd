"""What checks report: one row a problem, of the same columns for all checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("check", "artifact", "path", "expected", "got", "hint", "severity")


def finding(check: str, artifact: Column, path: Column, expected: Column, got: Column, hint: str = "", severity: str | Column = "error") -> list[Column]:
    """Columns of a finding, for select()."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    values = (F.lit(check), artifact, path, expected, got, F.lit(hint), severity)
    return [v.cast("string").alias(n) for n, v in zip(COLUMNS, values, strict=True)]


def errors(found: DataFrame) -> DataFrame:
    return found.where("severity = 'error'")


def summary(found: DataFrame) -> DataFrame:
    """For each check: errors, warnings, and whether it passed."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}s")
    return found.groupBy("check").agg(n("error"), n("warning")).withColumn("ok", F.col("n_errors") == 0)


def retry_text(found: DataFrame, *by: str) -> DataFrame:
    """For each check with errors, or each group of the columns `by`, their text in order of artifact and path, for who is to mend them.

    A group's text is one string: by check alone it grows with the data, by check and artifact with what is wrong with one artifact.
    """
    one = F.concat_ws("\n", F.concat(F.lit("- "), "artifact", F.lit(" at "), "path"), F.concat(F.lit("  expected: "), "expected"), F.concat(F.lit("  got: "), "got"), F.when(F.col("hint") != "", F.concat(F.lit("  hint: "), "hint")))
    ordered = F.array_sort(F.collect_list(F.struct("artifact", "path", one.alias("text"))))
    return errors(found).groupBy(*(by or ("check",))).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def retry_pages(found: DataFrame, most: int = 100) -> DataFrame:
    """(check, page, n, text): the text of retry_text() in pages of `most` errors at most, in order of artifact and path, so no text grows with the data.

    Pages may begin with the rest of one that the check before left, as errors of all checks are numbered in one go.
    """
    from provena.operators.reconcile import dense

    numbered = dense(errors(found).select("check", "artifact", "path", "expected", "got", "hint"), "check", "artifact", "path", "expected", "got", "hint")
    paged = numbered.withColumn("page", F.floor(F.col("number") / most)).withColumn("severity", F.lit("error"))
    texts = retry_text(paged, "check", "page")
    return paged.groupBy("check", "page").agg(F.count("*").alias("n")).join(texts, ["check", "page"])
