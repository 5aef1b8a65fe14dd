"""A training corpus from documents: what language it is in, one of each group of near copies, no benchmark, no personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.llm import bpe, decontam, jaccard_join, langid, pii
from provena.llm.common import fresh, kept_table, named, table, without
from provena.llm.queries import vocabulary

#: SQL can't express the learned stages; a test holds all stages' rows and texts against brute force.
ORACLE_SQL = None


def language(spark, docs, sf_dir):
    """Documents without letters go, and those whose best language stays under a score of 0.3."""
    return langid.keep_known(docs)


def near_copies(spark, docs, sf_dir):
    """Of documents linked by a Jaccard similarity of 0.75 of word 5-grams, directly or through others, the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark, docs, sf_dir):
    """Runs of words that ten-word windows of the benchmark cover are cut out; a document of which no word is left goes."""
    clean = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.where(F.col("text").isNull() | (F.trim("text") != ""))


def personal_data(spark, docs, sf_dir):
    """Spans of personal data give way to their kind in angle brackets."""
    return pii.redact(docs)


def token_ids(spark, docs, sf_dir):
    """Documents with their ids, and digests of the ids and of what they decode to; text and decoded bytes are the same. Columns named like these are replaced."""
    added = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    kept = without(docs, *added)
    ids, back = fresh(kept, "ids", "bytes")
    out = bpe.encode_and_decode(kept, *vocabulary(), ids_col=ids, bytes_col=back)
    same = F.encode(F.coalesce("text", F.lit("")), "UTF-8") == F.col(back)
    checked = F.when(same, F.col(ids)).otherwise(F.raise_error(F.concat(F.lit("ids of document "), F.col("doc_id").cast("string"), F.lit(" don't decode to its text"))))
    n = (F.octet_length(ids) / 4).cast("long")
    return out.select(*named(kept.columns), n.alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(back, 256).alias("decoded_sha256"), checked.alias("ids"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]


def run(spark, sf_dir):
    """All stages over documents; what a stage keeps is written to the shared checkpoint folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
