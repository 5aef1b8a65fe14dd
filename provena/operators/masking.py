"""Masks credentials in text: passwords, tokens, connection strings, private keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.functions.text import MASK

# The patterns are this library's own. Group 1 and 2 stay around what is masked.
PATTERNS = {
    "private key": r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)[^-]+(-----END [A-Z ]*PRIVATE KEY-----)",
    "connection string": r"([a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@]+:)[^\s@/*]+(@)",
    "password": r"""((?i:password|passwd|pwd)\s*[:=]\s*["']?)[^\s"'*]{4,}(["']?)""",
    "token": r"""((?i:token|secret|api_?key)\s*[:=]\s*["']?)[A-Za-z0-9+/_.-]{8,}(["']?)""",
}


def masked(text: Column) -> Column:
    """The text with each credential replaced by the mask; masking again changes nothing."""
    for pattern in PATTERNS.values():
        text = F.regexp_replace(text, pattern, rf"$1{MASK}$2")
    return text


def kinds(text: Column) -> Column:
    """How many credentials of each kind a text has."""
    return F.map_from_arrays(F.array(*map(F.lit, PATTERNS)), F.array(*[F.regexp_count(text, F.lit(p)) for p in PATTERNS.values()]))
