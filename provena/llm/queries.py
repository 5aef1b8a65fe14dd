"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from provena.llm import bpe, conversations, decontam, embed_dedup, html_extract, jaccard_join, langid, lm_score, mixing, pii, suffix_dedup, token_output, whitening
from provena.llm.common import table


def vocabulary() -> tuple[str, str]:
    """File of ranks and pattern of the vocabulary in use; the place of the files is public_tokenizers'."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), *vocabulary())


def op10_language_id(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op5_token_output(spark, sf_dir):
    return token_output.report(table(spark, sf_dir, "documents"), *vocabulary())


def op6_lm_scoring(spark, sf_dir):
    return lm_score.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_embedding_near_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_decontamination(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    return conversations.report(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS MATERIALIZED (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS MATERIALIZED (SELECT doc_id, grams.n, i, item_id FROM grams JOIN win USING (n, g)),
per_word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_word USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def queries():
    return {f.__name__: f for f in (op1_byte_bpe, op2_pii, op3_ngram_jaccard_join, op4_suffix_array_dedup, op5_token_output, op6_lm_scoring, op7_html_extraction, op8_embedding_near_dedup, op9_decontamination, op10_language_id, op11_source_mixing, op12_conversation_repair, op13_embedding_whitening)}


OP3_SQL = """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(least(doc_id, coalesce(m, doc_id)) AS BIGINT) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

OP4_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS MATERIALIZED (SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 100)) AS w FROM d, unnest(range(0, n - 49)) AS t(p) WHERE n >= 50),
least_doc AS MATERIALIZED (SELECT w, min(doc_id) AS m FROM win GROUP BY w),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM win JOIN least_doc USING (w) WHERE doc_id > m),
runs AS (SELECT doc_id, count(*) AS n_removed, CAST(sum(new) AS BIGINT) AS n_spans FROM (
  SELECT doc_id, CASE WHEN lag(p) OVER (PARTITION BY doc_id ORDER BY p) = p - 1 THEN 0 ELSE 1 END AS new FROM gone) GROUP BY doc_id),
remains AS (SELECT doc_id, string_agg(substr(h, CAST(2 * b.p + 1 AS BIGINT), 2), '' ORDER BY b.p) AS k
  FROM (SELECT doc_id, h, unnest(range(0, n)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM gone)) b LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN runs.doc_id IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN remains USING (doc_id)
"""

OP8_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, CAST(least(vec_id, coalesce(m, vec_id)) AS BIGINT) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def oracle_sql():
    return {"op3_ngram_jaccard_join": OP3_SQL, "op4_suffix_array_dedup": OP4_SQL, "op8_embedding_near_dedup": OP8_SQL, "op9_decontamination": OP9_SQL}
