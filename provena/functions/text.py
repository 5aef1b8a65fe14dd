"""Column functions on text, references and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)[\s\x1C-\x1F]+"
_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
# How a number is written in a prediction, and what stands for it in a source.
PLACEHOLDER = r"<\s*(?:n|num|число)\s*>"
NUMBER = r"[0-9][0-9_]*(?:\.[0-9]+)?"
#: What stands in a quote for a secret that was masked.
MASK = "***MASKED***"


def squash(c: Column) -> Column:
    """White space as single spaces, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _SPACE, " "))


def normalise(c: Column) -> Column:
    return F.lower(squash(c))


def blank(c: Column) -> Column:
    """Whether a line has nothing but white space, of whatever kind."""
    return F.regexp_like(c, F.lit(r"(?U)^[\s\x1C-\x1F]*$"))


def lines(c: Column) -> Column:
    """Lines by all Unicode breaks; a break at the end opens no further line."""
    parts = F.split(F.coalesce(c, F.lit("")), _BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(c: Column) -> Column:
    """Lines of the trimmed text; 0 for blank ones."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, _BREAKS, -1)))


def indent(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+", ""))


def source_ref(c: Column) -> Column:
    """`file:start` or `file:start-end` as (file, start, end); null if it isn't one."""
    part = lambda i: F.regexp_extract(c, r"^(.+):([0-9]+)(?:-([0-9]+))?$", i)
    start = F.try_to_number(part(2), F.lit("9999999999")).cast("int")
    end = F.when(part(3) == "", start).otherwise(F.try_to_number(part(3), F.lit("9999999999")).cast("int"))
    return F.when(part(2) != "", F.struct(part(1).alias("file"), start.alias("start"), end.alias("end")))


def escaped(c: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(c, r"([^\p{L}\p{N}_\s])", r"\\$1")


def needle_pattern(c: Column) -> Column:
    """The pattern of a prediction on normalised text: placeholders stand for numbers, all else for itself."""
    parts = F.split(normalise(c), PLACEHOLDER, -1)
    return F.array_join(F.transform(parts, escaped), NUMBER)


def quoted_in(quote: Column, window: Column) -> Column:
    """Whether a squashed quote stands in a squashed window; a mask in it is a hole that no line break is in."""
    holes = F.array_join(F.transform(F.split(quote, r"\*\*\*MASKED\*\*\*", -1), escaped), r"[^\n]*?")
    return F.when(F.contains(quote, F.lit(MASK)), F.regexp_like(window, holes)).otherwise(F.contains(window, quote))


def glob_pattern(glob: str) -> str:
    """A shell pattern as an anchored regular expression; a star crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        if ch == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out += f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]"
            i = j
        else:
            out += {"*": ".*", "?": "."}.get(ch, ch if ch.isalnum() or ch in "_/" else "\\" + ch)
        i += 1
    return f"(?s)^{out}$"


def any_glob(c: Column, globs: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs)) if globs else F.lit(False)


def percent(part: Column, total: Column, empty: float) -> Column:
    """100 * part / total to one place, ties to even; `empty` where there is nothing."""
    return F.when(total == 0, F.lit(empty)).otherwise(F.bround(100.0 * part / total, 1))


def clipped(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def without_fence(c: Column) -> Column:
    """The text without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[^\n]*\n", ""), r"\n?```\s*$", "")


def last_segment(c: Column) -> Column:
    return F.trim(F.element_at(F.split(c, r"\.", -1), -1))


def file_name(c: Column) -> Column:
    return F.element_at(F.split(F.rtrim(c, F.lit("/")), "/", -1), -1)


def module_name(c: Column) -> Column:
    """The last part of a path, without its suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(c), r"(?<=.)\.[^.]+$", "")


def padded(c: Column, width: int) -> Column:
    """Zeros in front up to a width; longer numbers stay whole."""
    return F.format_string(f"%0{width}d", c)


def rule_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"-R-([0-9]+)$", 1), F.lit("")).cast("int")


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with each {KEY} replaced, one key after the other."""
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return out
