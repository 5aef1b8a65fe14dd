"""Named queries over the driver's tables, each beside its SQL where SQL expresses it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import text as X
from provena.operators import code, completeness, containment, contracts, findings, masking, needles, reconcile, report, schemas, spans
from provena.sources import files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("long")


_NORM = "lower(trim(regexp_replace(coalesce({0}, ''), '[\\s\\x0B]+', ' ', 'g')))"
_LINES = "(SELECT doc_id, CASE WHEN list_extract(l, -1) = '' THEN l[:-2] ELSE l END AS lines FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
_PCT = "CASE WHEN {1} = 0 THEN {2} ELSE round_even(CAST(100.0 AS DOUBLE) * {0} / {1}, 1) END"


# Containment and predictions.

_HITS = f"""p AS MATERIALIZED (SELECT item_id, {_NORM.format("text")} AS p FROM benchmark),
t AS MATERIALIZED (SELECT doc_id, source, {_NORM.format("text")} AS t FROM documents),
hits AS MATERIALIZED (SELECT item_id, doc_id, source FROM p JOIN t ON p.p <> '' AND contains(t.t, p.p))"""


def _hits(spark, sf_dir):
    return containment.containing(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents"), "item_id", "doc_id")


@query(f"WITH {_HITS} SELECT item_id, doc_id FROM hits")
def passage_containment(spark, sf_dir):
    return _hits(spark, sf_dir)


def _found(spark, sf_dir):
    items = _t(spark, sf_dir, "benchmark").select("item_id")
    hits = _hits(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return containment.first_found(items, hits, "item_id", "doc_id", F.col("source") == F.concat(F.lit("src"), F.col("item_id") % 20))


_FIRST = f"""{_HITS}, f AS (SELECT item_id, coalesce(min(doc_id) FILTER (source = 'src' || (item_id % 20)), min(doc_id)) AS found_in FROM hits GROUP BY item_id),
found AS (SELECT benchmark.item_id, found_in FROM benchmark LEFT JOIN f USING (item_id))"""


@query(f"WITH {_FIRST} SELECT item_id, found_in FROM found")
def passage_hint_first(spark, sf_dir):
    return _found(spark, sf_dir)


_SHARES = f"""{_FIRST}, r AS (SELECT item_id % 5 AS rule, count(*) AS total, count(found_in) AS confirmed,
  coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) FILTER (found_in IS NULL), '') AS unconfirmed FROM found GROUP BY 1)"""


def _shares(spark, sf_dir):
    return containment.confirmed(_found(spark, sf_dir), F.col("item_id") % 5, F.col("item_id").cast("string"))


@query(f"WITH {_SHARES} SELECT rule, total, confirmed, unconfirmed, {_PCT.format('confirmed', 'total', '0.0')} AS share FROM r")
def inverse_shares(spark, sf_dir):
    return _shares(spark, sf_dir)


@query(f"WITH {_SHARES} SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(confirmed) AS BIGINT) AS confirmed, {_PCT.format('sum(confirmed)', 'sum(total)', '0.0')} AS share FROM r")
def inverse_total(spark, sf_dir):
    out = _shares(spark, sf_dir).agg(F.sum("total").alias("total"), F.sum("confirmed").alias("confirmed"))
    return out.withColumn("share", X.percent(F.col("confirmed"), F.col("total"), 0.0))


@query(f"WITH {_SHARES} SELECT rule, unconfirmed FROM r WHERE total > 0 AND confirmed < total")
def partially_confirmed(spark, sf_dir):
    return _shares(spark, sf_dir).where("total > 0 and confirmed < total").select("rule", "unconfirmed")


_NUMBER_SQL = "[0-9][0-9_]*(?:[.][0-9]+)?"


@query(
    f"""WITH t AS (SELECT p_partkey, lower('The part ' || p_partkey || ' is a ' || p_name || ' made by ' || p_brand || ' of size ' || p_size || ' at ' || p_retailprice || ' each') AS t FROM part),
q AS (SELECT DISTINCT p_name || '|' || p_brand AS prediction, lower('a ' || p_name || ' made by ' || p_brand || ' of size {_NUMBER_SQL} at {_NUMBER_SQL} each') AS n FROM part)
SELECT prediction, p_partkey FROM q JOIN t ON regexp_matches(t.t, q.n)"""
)
def placeholder_containment(spark, sf_dir):
    """Predictions with placeholders for numbers, one a name and brand, searched in a text of each part."""
    p = _t(spark, sf_dir, "part")
    texts = p.select("p_partkey", F.concat(F.lit("The part "), "p_partkey", F.lit(" is a "), "p_name", F.lit(" made by "), "p_brand", F.lit(" of  size "), "p_size", F.lit(" at "), "p_retailprice", F.lit(" each")).alias("text"))
    said = p.select(F.concat("p_name", F.lit("|"), "p_brand").alias("prediction"), F.concat(F.lit("A "), "p_name", F.lit(" made by "), "p_brand", F.lit(" of size <n> at < NUM > each")).alias("text")).distinct()
    return containment.containing(said, texts, "prediction", "p_partkey")


@query(
    f"""WITH p AS MATERIALIZED (SELECT item_id, {_NORM.format("text")} AS p FROM benchmark),
t AS MATERIALIZED (SELECT 'd' || doc_id AS id, {_NORM.format("text")} AS t FROM documents UNION ALL SELECT 'c' || conv_id || '/' || turn, {_NORM.format("text")} FROM conversations)
SELECT item_id, id FROM p JOIN t ON p.p <> '' AND contains(t.t, p.p)"""
)
def indexed_containment(spark, sf_dir):
    """Where benchmark passages stand, by an index of documents and conversations that is put together in two goes and opened again for its use."""
    import uuid

    from provena.operators.index import Index
    from provena.operators.storage import shared_folder

    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    docs = _t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = _t(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), "text")
    Index(spark, folder).put(docs, "id", "all")
    Index(spark, folder).put(docs.unionByName(turns), "id", "all")
    return Index(spark, folder).containing(_t(spark, sf_dir, "benchmark"), "all", "item_id")


@query(f"""WITH {_FIRST}, r AS (SELECT 'src' || (item_id % 20) AS rule, count(*) AS total, count(found_in) AS confirmed FROM found GROUP BY 1), s AS (SELECT DISTINCT source AS rule FROM documents WHERE source IS NOT NULL)
SELECT rule, coalesce(total, 0) AS total, coalesce(confirmed, 0) AS confirmed, {_PCT.format("coalesce(confirmed, 0)", "coalesce(total, 0)", "0.0")} AS share FROM s LEFT JOIN r USING (rule)""")
def inverse_by_source(spark, sf_dir):
    """Every source has a row, those without expectations too."""
    rules = _t(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("rule"))
    label = F.col("item_id").cast("string")
    return containment.confirmed(_found(spark, sf_dir), F.concat(F.lit("src"), F.col("item_id") % 20), label, rules).drop("unconfirmed")


@query(f"WITH {_FIRST} SELECT item_id % 5 AS rule, CAST(item_id AS VARCHAR) AS label FROM found WHERE found_in IS NULL")
def unconfirmed_rows(spark, sf_dir):
    return containment.misses(_found(spark, sf_dir), F.col("item_id") % 5, F.col("item_id").cast("string"))


@query(
    f"""WITH {_SHARES}, n AS (SELECT rule, total, confirmed, {_PCT.format("confirmed", "total", "0.0")} AS share, row_number() OVER (ORDER BY CAST(rule AS VARCHAR)) - 1 AS k FROM r)
SELECT 0 AS part, i AS number, ['# Predictions against sources', '', '| rule | predictions | confirmed | % |', '|---|---|---|---|'][i + 1] AS line FROM range(4) AS t(i)
UNION ALL SELECT 1, k, '| ' || rule || ' | ' || total || ' | ' || confirmed || ' | ' || share || ' |' FROM n
UNION ALL SELECT 2, 0, '**Total: ' || CAST(coalesce(sum(confirmed), 0) AS BIGINT) || '/' || CAST(coalesce(sum(total), 0) AS BIGINT) || ' = ' || {_PCT.format("coalesce(sum(confirmed), 0)", "coalesce(sum(total), 0)", "0.0")} || '%**' FROM n"""
)
def inverse_report(spark, sf_dir):
    return report.inverse_report(_shares(spark, sf_dir))


@query(
    """WITH q AS (SELECT page_id, lower(url) AS url, regexp_replace(regexp_replace(lower(url), '[0-9]+', '<n>', 'g'), '([^A-Za-z0-9_<>])', '\\\\\\1', 'g') AS needle FROM pages)
SELECT a.page_id, regexp_matches(a.url, replace(a.needle, '<n>', '[0-9][0-9_]*(?:[.][0-9]+)?')) AS own,
  coalesce(regexp_matches(b.url, replace(a.needle, '<n>', '[0-9][0-9_]*(?:[.][0-9]+)?')), false) AS next_one
FROM q a LEFT JOIN q b ON b.page_id = a.page_id + 1"""
)
def placeholder_match(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", X.normalise(F.col("url")).alias("url"), X.needle_pattern(F.regexp_replace("url", "[0-9]+", "<N>")).alias("needle"))
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("after"))
    return p.join(after, "page_id", "left").select("page_id", F.regexp_like("url", "needle").alias("own"), F.coalesce(F.regexp_like("after", F.col("needle")), F.lit(False)).alias("next_one"))


# Lines and quotes.


def _line_docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "source", X.lines(F.col("text")).alias("lines"))


@query(
    f"""WITH l AS {_LINES}, kk AS (SELECT doc_id, lines, 1 + doc_id % len(lines) AS k, 1 + doc_id % len(lines) + doc_id % 9 - 4 AS said FROM l WHERE len(lines) > 0),
q AS (SELECT *, trim(regexp_replace(trim(trim(lines[k]), '"'), '\\s+', ' ', 'g')) AS quote, greatest(said - 3, 1) AS lo, said + 1 + 3 AS hi FROM kk)
SELECT doc_id, CAST(said AS BIGINT) AS said, quote = '' OR contains(trim(regexp_replace(array_to_string(lines[lo:CASE WHEN trim(lines[k]) = '' THEN hi - 1 ELSE hi END], ' '), '\\s+', ' ', 'g')), quote) AS found FROM q"""
)
def line_window_quote(spark, sf_dir):
    d = _line_docs(spark, sf_dir).where(F.size("lines") > 0)
    at = (F.col("doc_id") % F.size("lines") + 1).cast("int")
    said = (at + F.col("doc_id") % 9 - 4).cast("int")
    return d.select("doc_id", said.cast("long").alias("said"), spans.quote_found(F.col("lines"), F.element_at("lines", at), said, said).alias("found"))


@query(f"WITH l AS {_LINES} SELECT doc_id, CAST(1 + doc_id % len(lines) AS BIGINT) AS n, array_to_string(lines[greatest(1 + doc_id % len(lines) - 3, 1):1 + doc_id % len(lines) + 3], chr(10)) AS around FROM l WHERE len(lines) > 0")
def line_context(spark, sf_dir):
    d = _line_docs(spark, sf_dir).where(F.size("lines") > 0)
    n = (F.col("doc_id") % F.size("lines") + 1).cast("int")
    return d.select("doc_id", n.cast("long").alias("n"), spans.context(F.col("lines"), n).alias("around"))


@query(
    f"""WITH l AS {_LINES}, x AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS n, unnest(lines) AS line FROM l),
y AS MATERIALIZED (SELECT doc_id, n, line, length(line) % 11 AS ind, nullif(regexp_extract(line, '^([A-Z][a-z]+)', 1), '') AS name FROM x),
t AS MATERIALIZED (SELECT y.doc_id, y.n AS target, ind AS own FROM y JOIN (SELECT doc_id, max(n) AS n FROM y GROUP BY doc_id) USING (doc_id, n)),
u AS MATERIALIZED (SELECT t.doc_id, target, own, n, ind, name, min(ind) OVER (PARTITION BY t.doc_id, target ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM t JOIN y ON t.doc_id = y.doc_id AND y.n < target AND trim(line) <> '')
SELECT t.doc_id, t.target AS n, b.name FROM t LEFT JOIN (SELECT doc_id, arg_max(name, n) AS name FROM u WHERE ind < least(own, coalesce(low, own)) AND name IS NOT NULL GROUP BY doc_id) b USING (doc_id)"""
)
def nearest_preceding(spark, sf_dir):
    d = _line_docs(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("p", "line"))
    d = d.select("doc_id", (F.col("p") + 1).cast("long").alias("n"), "line", (F.length("line") % 11).alias("indent"))
    last = d.groupBy("doc_id").agg(F.max("n").alias("n"))
    return spans.nearest_preceding(last, d, "doc_id", F.nullif(F.regexp_extract("line", "^([A-Z][a-z]+)", 1), F.lit(""))).select("doc_id", "n", "name")


_MS = """spans AS (SELECT user_id, epoch_ms(ts) AS s, epoch_ms(ts) + 1000 * (1 + CAST(floor(value * 60) AS BIGINT) * 60) AS e, event_id FROM events WHERE event_type = 'view'),
ats AS (SELECT user_id, epoch_ms(ts) AS at, event_id FROM events WHERE event_type = 'error')"""


def _milliseconds(spark, sf_dir):
    """Errors as points, and views as spans of minutes to days, both in milliseconds."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("start"), "value")
    views = e.where("event_type = 'view'").withColumn("end", F.col("start") + 1000 * (1 + F.floor(F.col("value") * 60) * 60)).drop("value")
    return e.where("event_type = 'error'").withColumn("end", F.col("start")).drop("value"), views


@query(f"WITH {_MS} SELECT a.event_id, EXISTS (SELECT 1 FROM spans v WHERE v.user_id = a.user_id AND a.at BETWEEN v.s AND v.e) AS hit FROM ats a")
def interval_levels(spark, sf_dir):
    """Errors within spans of up to days in milliseconds: a span is a few dyadic nodes, not a row for each bucket."""
    errors, views = _milliseconds(spark, sf_dir)
    return spans.overlaps(errors, views, "user_id", how="flag").select("event_id", "hit")


@query(f"WITH {_MS} SELECT event_id FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.user_id = a.user_id + 1 AND b.s <= a.e AND b.e >= a.s)")
def interval_levels_between_spans(spark, sf_dir):
    """Views of days that no view of the next user overlaps."""
    _, views = _milliseconds(spark, sf_dir)
    return spans.overlaps(views, views.withColumn("user_id", F.col("user_id") - 1), "user_id", how="left_anti").select("event_id")


@query(f"WITH {_MS} SELECT a.event_id, arg_min(v.event_id, (v.e - v.s, -v.event_id)) AS inner_id FROM ats a LEFT JOIN spans v ON v.user_id = a.user_id AND a.at BETWEEN v.s AND v.e GROUP BY a.event_id")
def innermost_levels(spark, sf_dir):
    """For each error the shortest of the views around it."""
    errors, views = _milliseconds(spark, sf_dir)
    views = views.withColumn("inner_id", F.col("event_id"))
    return spans.innermost(errors, views, "user_id", "start", "event_id", "inner_id", "inner_id").select("event_id", "inner_id")


_NEEDLES = "n AS MATERIALIZED (SELECT DISTINCT lower(split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)) AS needle FROM benchmark WHERE text IS NOT NULL)"


@query(f"WITH {_NEEDLES}, t AS MATERIALIZED (SELECT lower(text) AS t FROM documents), c AS (SELECT needle, CAST(sum((length(t) - length(replace(t, needle, ''))) // length(needle)) AS BIGINT) AS times FROM n JOIN t ON contains(t, needle) GROUP BY needle) SELECT needle, times FROM c")
def needles_in_documents(spark, sf_dir):
    """How often two words of each benchmark item stand anywhere in documents, whatever is around them."""
    words = F.split(F.lower("text"), " ", -1)
    wanted = _t(spark, sf_dir, "benchmark").select(F.concat(F.coalesce(F.get(words, F.lit(1)), F.lit("")), F.lit(" "), F.coalesce(F.get(words, F.lit(2)), F.lit(""))).alias("needle"))
    return needles.occurrences(wanted, _t(spark, sf_dir, "documents").select(F.lower("text").alias("t")), "needle", "t")


@query(
    f"""WITH p AS MATERIALIZED (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN split_part({_NORM.format("text")}, ' ', 3) ELSE split_part({_NORM.format("text")}, ' ', 4) || ' ' || split_part({_NORM.format("text")}, ' ', 5) END AS p FROM benchmark),
t AS MATERIALIZED (SELECT {_NORM.format("text")} AS t FROM documents)
SELECT item_id, count(*) AS texts FROM p JOIN t ON p.p <> '' AND contains(t.t, p.p) GROUP BY item_id"""
)
def short_passages(spark, sf_dir):
    """In how many documents passages of one and of two words stand."""
    words = F.split(X.normalise(F.col("text")), " ", -1)
    at = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    said = _t(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, at(2)).otherwise(F.concat(at(3), F.lit(" "), at(4))).alias("text"))
    return containment.containing(said, _t(spark, sf_dir, "documents"), "item_id", "doc_id").groupBy("item_id").agg(F.count("*").alias("texts"))


# Spans and coverage.

_EVENTS = """views AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) - 600 AS s, CAST(floor(epoch(ts)) AS BIGINT) + 600 AS e FROM events WHERE event_type = 'view'),
errs AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events WHERE event_type = 'error'),
marked AS (SELECT user_id, sec, EXISTS (SELECT 1 FROM views v WHERE v.user_id = errs.user_id AND sec BETWEEN s AND e) AS hit FROM errs)"""


def _points(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", F.unix_timestamp("ts").alias("at"))
    views = e.where("event_type = 'view'").select("user_id", (F.col("at") - 600).alias("start"), (F.col("at") + 600).alias("end"))
    errors = e.where("event_type = 'error'").select("user_id", F.col("at").alias("start"), F.col("at").alias("end")).distinct()
    return errors, views


def _covered(spark, sf_dir):
    errors, views = _points(spark, sf_dir)
    return code.coverage(errors.withColumnsRenamed({"user_id": "path", "start": "line"}), views.withColumnRenamed("user_id", "path")).withColumnRenamed("path", "user_id")


@query(f"WITH {_EVENTS} SELECT user_id, count(*) AS total, CAST(sum(hit::INT) AS BIGINT) AS covered, {_PCT.format('sum(hit::INT)', 'count(*)', '100.0')} AS share FROM marked GROUP BY user_id")
def interval_coverage(spark, sf_dir):
    return _covered(spark, sf_dir)


@query(f"WITH {_EVENTS} SELECT user_id, sec FROM marked WHERE NOT hit")
def interval_uncovered(spark, sf_dir):
    errors, views = _points(spark, sf_dir)
    return spans.overlaps(errors, views, "user_id", how="left_anti").select("user_id", F.col("start").alias("sec"))


@query(f"WITH {_EVENTS} SELECT count(*) AS total, CAST(coalesce(sum(hit::INT), 0) AS BIGINT) AS covered, {_PCT.format('sum(hit::INT)', 'count(*)', '100.0')} AS share FROM marked")
def coverage_total(spark, sf_dir):
    return code.total_coverage(_covered(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT user_id % 10 AS module, count(*) AS total, CAST(sum(hit::INT) AS BIGINT) AS covered FROM marked GROUP BY ROLLUP (user_id % 10)")
def coverage_rollup(spark, sf_dir):
    return _covered(spark, sf_dir).rollup((F.col("user_id") % 10).alias("module")).agg(F.sum("total").alias("total"), F.sum("covered").alias("covered"))


_ALL_USERS = f"{_EVENTS}, u AS (SELECT DISTINCT user_id FROM events), c AS (SELECT u.user_id, count(sec) AS total, CAST(coalesce(sum(hit::INT), 0) AS BIGINT) AS covered FROM u LEFT JOIN marked USING (user_id) GROUP BY u.user_id)"


def _all_covered(spark, sf_dir):
    errors, views = _points(spark, sf_dir)
    paths = _t(spark, sf_dir, "events").select(F.col("user_id").alias("path"))
    return code.coverage(errors.withColumnsRenamed({"user_id": "path", "start": "line"}), views.withColumnRenamed("user_id", "path"), 0, paths)


@query(f"WITH {_ALL_USERS} SELECT user_id, total, covered, {_PCT.format('covered', 'total', '100.0')} AS share FROM c")
def coverage_of_all(spark, sf_dir):
    """Users without errors have a row with 100.0."""
    return _all_covered(spark, sf_dir).withColumnRenamed("path", "user_id")


@query(
    f"""WITH {_ALL_USERS}, v AS (SELECT DISTINCT user_id FROM views), n AS (SELECT *, {_PCT.format("covered", "total", "100.0")} AS share, row_number() OVER (ORDER BY user_id) - 1 AS k FROM c)
SELECT 0 AS part, i AS number, ['# Coverage of branches by rules', '', '| module | branches | covered | % | functions without rules |', '|---|---|---|---|---|'][i + 1] AS line FROM range(4) AS t(i)
UNION ALL SELECT 1, k, '| `' || n.user_id || '` | ' || total || ' | ' || covered || ' | ' || share || ' | ' || CASE WHEN v.user_id IS NULL THEN '`all`' ELSE '—' END || ' |' FROM n LEFT JOIN v ON v.user_id = n.user_id
UNION ALL SELECT 2, 0, '**Total: ' || CAST(sum(covered) AS BIGINT) || '/' || CAST(sum(total) AS BIGINT) || ' = ' || {_PCT.format("sum(covered)", "sum(total)", "100.0")} || '%**' FROM n"""
)
def coverage_report(spark, sf_dir):
    """A function spans all of each user's time; it has no rule where the user never viewed."""
    views = _points(spark, sf_dir)[1].withColumnRenamed("user_id", "path")
    functions = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path")).agg(F.lit("all").alias("name"), F.min(F.unix_timestamp("ts")).alias("line"), F.max(F.unix_timestamp("ts")).alias("end"))
    bare = code.without_rules(functions, views)
    return report.coverage_report(_all_covered(spark, sf_dir), bare)


@query("SELECT 'c' || conv_id || '.py' AS path, CAST(turn + 1 AS INT) AS start, CAST(turn + 1 + greatest(len(string_split(trim(text), chr(10))) - 1, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) AS INT) AS \"end\" FROM conversations")
def rule_ranges(spark, sf_dir):
    """Ranges end where the reference or the quote does, whichever is later."""
    source = F.concat(F.lit("c"), "conv_id", F.lit(".py:"), F.col("turn") + 1, F.when(F.col("turn") % 3 == 0, F.concat(F.lit("-"), F.col("turn") + 2)).otherwise(""))
    return code.rule_ranges(_t(spark, sf_dir, "conversations").select(source.alias("source"), F.col("text").alias("evidence")))


@query("SELECT l_orderkey AS path, string_agg(l_linenumber || '-' || greatest(l_linenumber, CAST(l_quantity AS BIGINT)), ',' ORDER BY l_linenumber, greatest(l_linenumber, CAST(l_quantity AS BIGINT))) AS ranges FROM lineitem GROUP BY l_orderkey")
def ranges_by_file(spark, sf_dir):
    """The lines of each order as ranges, in order."""
    r = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("start"), F.greatest(F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")).alias("end"))
    return code.ranges_by_file(r).select("path", F.array_join(F.transform("ranges", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("ranges"))


@query(
    """SELECT o_orderkey, arg_min(l_linenumber, (2 * CAST(l_quantity AS BIGINT), -l_linenumber)) AS l_linenumber
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) BETWEEN date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) - CAST(l_quantity AS BIGINT) AND date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT)
GROUP BY o_orderkey"""
)
def innermost_span(spark, sf_dir):
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", day("o_orderdate").alias("at"), F.col("o_orderkey").alias("k"))
    s = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (day("l_shipdate") - F.col("l_quantity").cast("long")).alias("start"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("end"), "l_linenumber")
    return spans.innermost(o, s.withColumn("ord", F.col("l_linenumber")), "k", "at", "o_orderkey", "l_linenumber", "ord").select("o_orderkey", "l_linenumber")


# Keys, numbers, blocks.


@query("SELECT doc_id, CAST(count(l.doc_id) AS BIGINT) AS times, CASE count(l.doc_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'once' ELSE 'duplicate' END AS state FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY doc_id")
def exactly_once(spark, sf_dir):
    return reconcile.exactly_once(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT o_orderkey, count(l_orderkey) AS times, CASE count(l_orderkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'once' ELSE 'duplicate' END AS state FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def exactly_once_lines(spark, sf_dir):
    return reconcile.exactly_once(_t(spark, sf_dir, "orders").select("o_orderkey"), _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT o_orderkey AS k, 'left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'right' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def reconcile_both_ways(spark, sf_dir):
    return reconcile.both_ways(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT count(DISTINCT l_orderkey) AS distinct_keys, count(*) AS total, count(DISTINCT l_orderkey) = count(*) AS same FROM lineitem")
def distinct_vs_total(spark, sf_dir):
    n = _t(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey").alias("distinct_keys"), F.count("*").alias("total"))
    return n.withColumn("same", F.col("distinct_keys") == F.col("total"))


@query("SELECT conv_id, count(*) AS times, string_agg(DISTINCT role, ',' ORDER BY role) AS places FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_numbers(spark, sf_dir):
    return reconcile.collisions(_t(spark, sf_dir, "conversations"), "conv_id", "role")


@query(f"WITH d AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents) SELECT md5(t) AS t, count(*) AS times, min(doc_id) AS first FROM d GROUP BY t HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalise(F.col("text"))).alias("t"))
    return d.groupBy("t").agg(F.count("*").alias("times"), F.min("doc_id").alias("first")).where("times > 1")


@query("SELECT c_nationkey, CAST((max(c_custkey) - 1) // 100 * 100 + 101 AS BIGINT) AS block FROM customer GROUP BY c_nationkey")
def next_block(spark, sf_dir):
    return _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(reconcile.next_block(F.col("c_custkey")).alias("block"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_custkey * 100 + 1 ELSE 900001 + 100 * (row_number() OVER (PARTITION BY c_custkey % 7 = 0 ORDER BY c_custkey) - 1) END AS block FROM customer")
def block_assign(spark, sf_dir):
    m = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey") * 100 + 1).alias("own"))
    return reconcile.assigned_blocks(m, "c_custkey", "own", 900001).select("c_custkey", "block")


@query("SELECT 'CUST-R-' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(3, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS rule_id, CAST(c_custkey AS INTEGER) AS number, CAST(count(o_custkey) AS BIGINT) AS times FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def story_occurrences(spark, sf_dir):
    """Table lines made of orders, in each of which rule ids are counted; ids become tokens, so the join is on equality."""
    rule = lambda c: F.concat(F.lit("CUST-R-"), X.padded(F.col(c), 3))
    table = _t(spark, sf_dir, "orders").select(F.concat(F.lit("| "), rule("o_custkey"), F.lit(" | "), "o_orderstatus", F.lit(" |")).alias("line"))
    tokens = table.where(F.startswith(F.ltrim("line"), F.lit("|"))).select(F.explode(F.regexp_extract_all("line", F.lit(r"([\w-]+)"), 1)).alias("rule_id"))
    ids = _t(spark, sf_dir, "customer").select(rule("c_custkey").alias("rule_id"))
    return reconcile.exactly_once(ids, tokens, "rule_id").select("rule_id", X.rule_number(F.col("rule_id")).alias("number"), "times")


_TOLD = "regexp_replace('CUST-R-' || lpad(CAST({0} AS VARCHAR), CAST(greatest(3, length(CAST({0} AS VARCHAR))) AS INTEGER), '0'), '^', '')"


def _rule(c: str) -> Column:
    return F.concat(F.lit("CUST-R-"), X.padded(F.col(c), 3))


def _stories(spark, sf_dir):
    """A line for each order; a third of them have something before the id, a fifth something after it, a seventh are no table."""
    k = F.col("o_orderkey")
    line = F.concat(F.when(k % 7 == 0, "- ").otherwise("| "), F.when(k % 3 == 0, "see-v1.").otherwise(""), _rule("o_custkey"), F.when(k % 5 == 0, "-x").when(k % 5 == 1, ".").otherwise(""), F.lit(" | "), "o_orderstatus", F.lit(" |"))
    return _t(spark, sf_dir, "orders").select(line.alias("line"))


@query(f"SELECT {_TOLD.format('c_custkey')} AS rule_id, CAST(count(o_orderkey) AS BIGINT) AS times FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 GROUP BY c_custkey")
def occurrences_anywhere(spark, sf_dir):
    rules = _t(spark, sf_dir, "customer").select(_rule("c_custkey").alias("rule_id"))
    return completeness.occurrences(rules, _stories(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT c_custkey, {_TOLD.format("c_custkey")} AS rule_id FROM customer), told AS (SELECT rule_id, count(o_orderkey) AS n FROM r LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 GROUP BY rule_id),
t AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'NEW-R-' || (100 + o_orderkey) ELSE {_TOLD.format("o_custkey")} END AS rule_id, o_orderstatus = 'P' AS bare, o_orderkey % 13 = 0 AS wide FROM orders),
ids AS (SELECT DISTINCT rule_id FROM t WHERE NOT wide), f AS (
  SELECT 'stories.md' AS artifact, 'table (' || rule_id || ')' AS path, 'once in the table' AS expected, CASE WHEN n = 0 THEN 'never' ELSE n || ' times' END AS got FROM told WHERE n <> 1
  UNION ALL SELECT 'traceability.csv', 'rule_id', (SELECT count(*) FROM r) || ' different ids', (SELECT count(*) FROM ids) || ' different ids' WHERE (SELECT count(*) FROM r) <> (SELECT count(*) FROM ids)
  UNION ALL SELECT 'traceability.csv', 'rule_id (' || rule_id || ')', 'traced', 'missing' FROM r WHERE rule_id NOT IN (SELECT rule_id FROM ids)
  UNION ALL SELECT 'traceability.csv', 'rule_id (' || rule_id || ')', 'a known rule', 'unknown' FROM ids WHERE rule_id NOT IN (SELECT rule_id FROM r)
  UNION ALL SELECT 'traceability.csv', 'source (row ' || (k + 1) || ')', 'a source', '(empty)' FROM t WHERE bare AND NOT wide)
SELECT 'completeness' AS "check", artifact, path, expected, got, '' AS hint, 'error' AS severity FROM f"""
)
def completeness_check(spark, sf_dir):
    """Customers are rules, orders their stories and trace; some rows of the trace name other rules, lack a source, or are too wide."""
    rules, k = _t(spark, sf_dir, "customer").select(_rule("c_custkey").alias("rule_id")), F.col("o_orderkey")
    own = F.when(k % 11 == 0, F.concat(F.lit("NEW-R-"), k + 100)).otherwise(_rule("o_custkey"))
    cells = F.array(F.concat(F.lit("q"), k), F.lit(""), F.concat(F.lit(" "), own), F.when(F.col("o_orderstatus") == "P", "\t").otherwise("a.py:1"), F.lit("high"), F.lit(""))
    trace = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 13 == 0, F.concat(cells, F.array(F.lit("more")))).otherwise(cells).alias("cells"))
    return completeness.check(rules, _stories(spark, sf_dir), trace, completeness.TRACE, "o_orderkey")


@query("SELECT 'completeness' AS \"check\", 'traceability.csv' AS artifact, 'header' AS path, 'req_id,story_id,rule_id,source,confidence,verdict_stage90' AS expected, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS got, '' AS hint, 'error' AS severity FROM orders LIMIT 1")
def completeness_header(spark, sf_dir):
    """A trace with another header: that is all that is said of it. Stories tell each rule once."""
    rules, orders = _t(spark, sf_dir, "customer").select(_rule("c_custkey").alias("rule_id")), _t(spark, sf_dir, "orders")
    return completeness.check(rules, rules.select(F.concat(F.lit("| "), "rule_id").alias("line")), orders.select("o_orderkey", F.array("o_orderstatus").alias("cells")), orders.columns, "o_orderkey")


@query("SELECT c_nationkey AS number, c_mktsegment AS place, count(*) AS times FROM customer GROUP BY ALL")
def used_numbers(spark, sf_dir):
    return reconcile.used(_t(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "number"), "number", "c_mktsegment")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) - 1 AS place FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def open_intents(spark, sf_dir):
    """Orders without lines, the latest first."""
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return reconcile.dense(o.select("o_orderkey", (-F.unix_date(F.col("o_orderdate").cast("date"))).alias("late")), "late", "o_orderkey").select("o_orderkey", F.col("number").alias("place"))


@query("SELECT c_mktsegment, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS rows_without FROM customer WHERE c_acctbal < 0 GROUP BY c_mktsegment")
def blank_rows(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").where("c_acctbal < 0")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("rows_without"))


@query("SELECT c_mktsegment, c_custkey FROM customer WHERE c_acctbal < 0")
def blank_row_keys(spark, sf_dir):
    """What blank_rows lists, a row a customer."""
    return _t(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_mktsegment", "c_custkey")


# Tiers, filters, plans.

# A plan's prefixes.
_TIERS = [("/en", "L0"), ("/en/", "L1"), ("/de", "L2"), ("/fr", "L0"), ("/fr/1", "L2"), ("/es/", "L1")]
_TIER_SQL = ", ".join(f"('{p}', '{t}', {i})" for i, (p, t) in enumerate(_TIERS))
_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


def _tiered(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "").alias("path"))
    tiers = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(_TIERS)], "prefix string, tier string, ord int")
    return reconcile.tier_of(p, "path", tiers, "L0")


_TIERED = f"""p AS (SELECT page_id, {_PATH} AS path FROM pages), tiers AS (SELECT * FROM (VALUES {_TIER_SQL}) AS v(prefix, tier, ord)),
best AS (SELECT page_id, path, coalesce(arg_max(tier, (length(rtrim(prefix, '/')), ord)), 'L0') AS tier
  FROM p LEFT JOIN tiers ON rtrim(path, '/') = rtrim(prefix, '/') OR starts_with(rtrim(path, '/'), rtrim(prefix, '/') || '/') GROUP BY page_id, path)"""


@query(f"WITH {_TIERED} SELECT page_id, path, tier FROM best")
def longest_prefix_tier(spark, sf_dir):
    return _tiered(spark, sf_dir).select("page_id", "path", "tier")


@query(f"WITH {_TIERED}, s AS (SELECT * FROM (VALUES ('0', 0), ('1', 0), ('2', 1), ('3', 1), ('4', 2), ('77', 2)) AS v(stage, least)) SELECT stage, CAST(count(*) FILTER (CAST(tier[2:2] AS INT) >= least) AS BIGINT) AS allowed FROM best, s GROUP BY stage")
def stages_allowed(spark, sf_dir):
    stages = F.explode(F.array(*map(F.lit, ("0", "1", "2", "3", "4", "77"))))
    return _tiered(spark, sf_dir).groupBy("tier").count().select("tier", "count", stages.alias("stage")).groupBy("stage").agg(_long(F.sum(F.when(reconcile.stage_allowed(F.col("stage"), F.col("tier")), F.col("count")))).alias("allowed"))


@query(f"WITH {_TIERED} SELECT max(tier) AS tier, count(*) FILTER (tier = 'L2') AS deep FROM best")
def run_tier(spark, sf_dir):
    return _tiered(spark, sf_dir).agg(F.max_by("tier", reconcile.tier_rank(F.col("tier"))).alias("tier"), F.count_if(F.col("tier") == "L2").alias("deep"))


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^.*/en/.*$|^.*\\.html$', 's')")
def glob_exclude(spark, sf_dir):
    return _t(spark, sf_dir, "pages").where(~X.any_glob(F.col("url"), ["**/en/*", "*.html"])).select("page_id")


@query("SELECT doc_id FROM documents WHERE coalesce(try_cast(CASE WHEN doc_id % 5 = 0 THEN 'about ' || n_chars WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS INT) >= 1000, true)")
def min_size(spark, sf_dir):
    said = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("about "), "n_chars")).when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("n_chars").cast("string"))
    return _t(spark, sf_dir, "documents").where(F.coalesce(said.try_cast("int") >= 1000, F.lit(True))).select("doc_id")


@query(
    """SELECT conv_id, CAST(turn AS INT) AS pos, CASE WHEN turn % 2 = 0 THEN 'src/' || role || '/' || turn || '.py' ELSE role || turn END AS path FROM conversations
WHERE role <> 'system' AND NOT (turn % 2 = 0 AND turn % 4 <> 2 AND length(text) < 200)"""
)
def module_plan(spark, sf_dir):
    """An inventory for each conversation, its turns as modules: objects with a size or something that is none, and bare strings."""
    t = F.col("turn")
    entry = F.when(t % 2 == 0, F.to_json(F.struct(F.concat(F.lit("src/"), "role", F.lit("/"), t, F.lit(".py")).alias("path"), F.when(t % 4 == 2, F.lit("about 9")).otherwise(F.length("text").cast("string")).alias("approx_size")))).otherwise(F.concat(F.lit('"'), "role", t, F.lit('"')))
    made = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: F.parse_json(x["e"])).alias("modules"))
    return reconcile.planned(made, ["src/system/*", "system*"], 200, "conv_id")


@query(
    """WITH o AS (SELECT conv_id, count(*) FILTER (role = 'user') AS there, count(*) FILTER (role = 'user' AND length(text) < 40) AS bad FROM conversations GROUP BY conv_id)
SELECT conv_id AS tag, CASE WHEN there > 0 AND bad = 0 THEN 'skipped' ELSE 'run' END AS state FROM o"""
)
def skip_if_valid(spark, sf_dir):
    """A task a conversation, its outputs the user's turns; a turn under 40 characters is an error, other short ones a warning."""
    c = _t(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "tag")
    outputs, n = c.where("role = 'user'").select("tag", F.col("turn").alias("path")), F.length("text")
    found = c.where("role = 'user'").select("tag", F.when(n < 40, "error").when(n < 80, "warning").otherwise("info").alias("severity"))
    return reconcile.to_run(c.select("tag").distinct(), outputs, found)


@query("SELECT conv_id AS tag, string_agg(turn || '.md', ' | ' ORDER BY turn || '.md') AS paths FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0")
def not_written(spark, sf_dir):
    """Expected is a file a turn, there are those of the system's turns; tasks without any of theirs are listed."""
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tag"), F.concat("turn", F.lit(".md")).alias("path"), "role")
    return reconcile.not_written(c.select("tag", "path"), c.where("role = 'system'"))


@query("SELECT doc_id FROM documents WHERE source IN (SELECT 'src' || (item_id % 20) FROM benchmark)")
def referenced_files(spark, sf_dir):
    rules = _t(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 20, F.lit(":"), F.col("item_id") + 1).alias("source"))
    return reconcile.referenced(rules, _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"))).select("doc_id")


# Files. Tables stand for source trees.


def _files(spark, sf_dir):
    k = F.col("doc_id")
    folder = F.when(k % 7 == 0, "node_modules/").when(k % 11 == 0, ".pytest_cache/").when(k % 13 == 0, "README").otherwise("")
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), folder, k, F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".md").otherwise(".bin")).alias("path"), "text")


_FILES = "f AS (SELECT doc_id, source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'node_modules/' WHEN doc_id % 11 = 0 THEN '.pytest_cache/' WHEN doc_id % 13 = 0 THEN 'README' ELSE '' END || doc_id || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.bin' END AS path, coalesce(text, '') AS text FROM documents)"


@query(f"WITH {_FILES} SELECT doc_id, path FROM f WHERE doc_id % 7 <> 0 AND doc_id % 3 < 2 AND path IS NOT NULL")
def source_tree(spark, sf_dir):
    return files.sources(_files(spark, sf_dir)).select("doc_id", "path")


@query(f"WITH {_FILES} SELECT doc_id FROM f WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 = 0 AND regexp_matches(path, '^README')")
def manifests(spark, sf_dir):
    """Manifests by name in the root alone."""
    k = _files(spark, sf_dir)
    return files.manifests(k).select("doc_id")


@query(
    f"""WITH {_FILES}, l AS (SELECT path, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines, row_number() OVER (ORDER BY string_split(path, '/')) AS k, count(*) OVER () AS n
  FROM f WHERE doc_id % 7 <> 0 AND (doc_id % 11 <> 0) AND path IS NOT NULL)
SELECT path, CAST(lines AS BIGINT) AS lines FROM l WHERE k <= 5000 UNION ALL SELECT DISTINCT '… ' || (n - 5000) || ' more', NULL FROM l WHERE n > 5000"""
)
def tree_listing(spark, sf_dir):
    return files.listing(_files(spark, sf_dir).where("path is not null"))


@query("SELECT 'c' || conv_id AS path, 'width' AS problem, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS row FROM conversations QUALIFY turn % 4 = 3 UNION ALL SELECT DISTINCT 'c' || conv_id, 'header', 0 FROM conversations WHERE conv_id % 9 = 0")
def csv_widths(spark, sf_dir):
    """A CSV text a conversation, quoted cells with line breaks and commas; each fourth row lacks a cell, some headers are others."""
    c = _t(spark, sf_dir, "conversations")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat("turn", F.lit(","), "role", F.when(F.col("turn") % 4 == 3, "").otherwise(F.concat(F.lit(","), quoted)))
    head = F.when(F.col("conv_id") % 9 == 0, "turn,text,role").otherwise("turn,role,text")
    made = c.groupBy("conv_id").agg(F.concat_ws("\n", head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x["r"]), "\n")).alias("text"))
    return files.csv_text_problems(made.select(F.concat(F.lit("c"), "conv_id").alias("path"), "text"), ["turn", "role", "text"])


@query("SELECT conv_id, CAST(turn AS INT) AS turn, role, text FROM conversations")
def csv_round_trip(spark, sf_dir):
    """Conversations written as CSV to the shared folder and read again, line breaks, commas and quotes in cells included."""
    import uuid

    from provena.operators.storage import shared_folder

    where = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").write.csv(where, header=True, escape='"', quoteAll=True)
    return files.csv_rows(spark, where).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text")


@query("SELECT doc_id, coalesce(source, '') AS source, octet_length(encode(coalesce(text, ''))) AS bytes, md5(coalesce(text, '')) AS digest FROM documents")
def csv_in_chunks(spark, sf_dir):
    """Documents as CSV files, every cell quoted, read again by chunks whose borders stand anywhere, in quoted line breaks too."""
    import uuid

    from provena.operators.storage import shared_folder
    from provena.sources.chunks import csv_file_cells

    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    own = _t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    own.write.csv(folder, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    cells = csv_file_cells(spark, folder, "*.csv", 1 << 20).where("n > 0").select(*[F.get("cells", i).alias(c) for i, c in enumerate(own.columns)])
    return cells.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.octet_length("text").cast("long").alias("bytes"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("SELECT conv_id, CAST(turn AS INT) AS turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS role, CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) END AS n, turn % 5 = 4 AS broken FROM conversations")
def yaml_fields(spark, sf_dir):
    """A YAML document a turn; each fifth can't be read."""
    c = _t(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 5 == 4, "role: [user").otherwise(F.concat(F.lit("role: "), "role", F.lit("\nn: "), F.length("text"), F.lit("\nlist:\n  - a\n")))
    docs = files.yaml_documents(c.select(F.concat_ws("/", "conv_id", "turn").alias("path"), text.alias("text")))
    v, at = F.try_parse_json("document"), F.split("path", "/")
    return docs.select(at[0].cast("long").alias("conv_id"), at[1].cast("int").alias("turn"), F.try_variant_get(v, "$.role", "string").alias("role"), F.try_variant_get(v, "$.n", "long").alias("n"), F.col("problem").isNotNull().alias("broken"))


@query("SELECT page_id, 'Page ' || page_id || ' at ' || url || ', again ' || page_id || ' {OTHER}' AS text FROM pages")
def template_fill(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", X.filled("Page {ID} at {URL}, again {ID} {OTHER}", {"ID": F.col("page_id").cast("string"), "URL": F.col("url")}).alias("text"))


@query("SELECT conv_id, turn, true AS own, length(text) < 12 OR contains(replace(text, chr(10), ' '), replace(text[:6], chr(10), ' ')) AS holed FROM conversations")
def masked_quotes(spark, sf_dir):
    """A quote with a masked middle stands in the text it is from; the mask stands for anything within a line."""
    c = _t(spark, sf_dir, "conversations").withColumn("line", F.get(X.lines(F.col("text")), F.lit(0)))
    text = X.squash(F.col("line"))
    holed = F.concat(F.left(text, F.lit(6)), F.lit(X.MASK), F.right(text, F.lit(3)))
    return c.select("conv_id", "turn", X.quoted_in(text, text).alias("own"), F.when(F.length(text) < 12, True).otherwise(X.quoted_in(holed, text)).alias("holed"))


@query("SELECT doc_id, regexp_replace(text, '((?i:token|secret|api_?key)\\s*[:=]\\s*[\"'']?)[A-Za-z0-9+/_.-]{8,}([\"'']?)', '\\1***MASKED***\\2', 'g') AS text FROM documents WHERE contains(text, 'token')")
def mask_secrets(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(F.contains("text", F.lit("token"))).select("doc_id", masking.masked(F.col("text")).alias("text"))


_MASKED = "text"
for _pattern in masking.PATTERNS.values():
    _MASKED = "regexp_replace({0}, '{1}', '\\1***MASKED***\\2', 'g')".format(_MASKED, _pattern.replace("'", "''"))


@query(f"SELECT doc_id, {_MASKED} AS text FROM documents")
def mask_documents(spark, sf_dir):
    """Every document, all kinds of credentials."""
    return _t(spark, sf_dir, "documents").select("doc_id", masking.masked(F.col("text")).alias("text"))


@query("SELECT n_regionkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) WHERE (r - 1) % 3 = 0")
def every_third(spark, sf_dir):
    """A sampling operator: every third nation; the 25 nations are all there are."""
    return reconcile.dense(_t(spark, sf_dir, "nation"), "n_nationkey").where("number % 3 = 0").select("n_regionkey", "n_name")


@query("SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS r FROM orders) WHERE (r - 1) % 3 = 0")
def every_third_order(spark, sf_dir):
    """A sampling operator: every third order by date, numbered by ranges."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderdate").cast("date").alias("day"))
    return reconcile.dense(o, "day", "o_orderkey").where("number % 3 = 0").select("o_orderkey", "o_orderdate")


@query(f"WITH {_TIERED} SELECT page_id, path FROM best WHERE tier = 'L2'")
def deep_modules(spark, sf_dir):
    return _tiered(spark, sf_dir).where(F.col("tier") == "L2").select("page_id", "path")


@query("SELECT conv_id, count(*) FILTER (turn % 3 = 0) AS kept, count(*) AS given FROM conversations GROUP BY conv_id")
def object_elements(spark, sf_dir):
    """Of a list of objects, numbers and texts, the objects."""
    t = F.col("turn")
    one = F.when(t % 3 == 0, F.to_json(F.struct("turn"))).when(t % 3 == 1, t.cast("string")).otherwise(F.concat(F.lit('"'), "role", F.lit('"')))
    made = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.collect_list(one), lambda x: F.parse_json(x)).alias("all"))
    return made.select("conv_id", F.size(reconcile.objects(F.col("all"))).cast("long").alias("kept"), F.size("all").cast("long").alias("given"))


@query("SELECT conv_id AS module, string_agg(text, chr(10) ORDER BY turn) AS statements FROM conversations WHERE role = 'user' GROUP BY conv_id")
def module_statements(spark, sf_dir):
    """The statements of each module, a conversation; modules without any have no row."""
    of = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text"))))
    made = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("module")).agg(of.alias("s"))
    return made.where(F.size("s") > 0).select("module", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("statements"))


@query("SELECT count(*) AS rules_total FROM customer")
def stats_map(spark, sf_dir):
    return completeness.stats(_t(spark, sf_dir, "customer")).select(F.col("stats")["rules_total"].alias("rules_total"))


@query(
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'order ' || o_orderkey ELSE 'f' || o_custkey || '.py:' || o_orderkey END AS source FROM orders)
SELECT (SELECT count(*) FROM orders) AS rules_total, count(*) FILTER (regexp_matches(source, '^.+:[0-9]+(-[0-9]+)?$')) AS rules_checked, (SELECT count(DISTINCT o_custkey) FROM orders) AS ids_used FROM s"""
)
def stats_of_checks(spark, sf_dir):
    """All three counts: orders are rules, of which pending ones have no reference; customers' numbers are in use."""
    o = _t(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("order "), "o_orderkey")).otherwise(F.concat(F.lit("f"), "o_custkey", F.lit(".py:"), "o_orderkey"))
    checked = o.select(X.source_ref(source).alias("r")).where("r is not null")
    found = completeness.stats_of(o, checked, o, "o_custkey")
    return found.select(*[F.col("stats")[k].alias(k) for k in ("rules_total", "rules_checked", "ids_used")])


_ROOTED = "f AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'README' || doc_id || '.md' WHEN 'de' THEN '.github/workflows/' || source || '.yml' WHEN 'fr' THEN source || '/README.md' ELSE source || '.txt' END AS path FROM documents)"


@query(f"WITH {_ROOTED} SELECT doc_id, path FROM f WHERE regexp_matches(path, '^(README.*|[.]github/workflows/.*[.]ya?ml|requirements.*[.]txt|Dockerfile.*)$')")
def manifests_in_root(spark, sf_dir):
    """Of files named after documents' languages and sources those that are manifests: by name in the root, and workflows in their folder."""
    own = F.when(F.col("lang") == "en", F.concat(F.lit("README"), "doc_id", F.lit(".md"))).when(F.col("lang") == "de", F.concat(F.lit(".github/workflows/"), "source", F.lit(".yml")))
    path = own.when(F.col("lang") == "fr", F.concat("source", F.lit("/README.md"))).otherwise(F.concat("source", F.lit(".txt")))
    return files.manifests(_t(spark, sf_dir, "documents").select("doc_id", path.alias("path")))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'does not run' WHEN event_id % 4 = 1 THEN 'says nothing' WHEN event_id % 4 = 2 THEN 'says something else' END AS failure FROM events")
def doc_examples(spark, sf_dir):
    """Examples of documentation and how each failed."""
    k = F.col("event_id") % 4
    said = F.when(k == 1, " ").when(k == 2, "other").otherwise(F.concat(F.lit(" "), "props"))
    return _t(spark, sf_dir, "events").select("event_id", reconcile.doc_failure(F.col("event_type") != "error", said, F.col("props")).alias("failure"))


@query(
    """WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, n, n * CAST(100 AS DOUBLE) / (SELECT sum(n) FROM g) AS x FROM g),
f AS (SELECT *, row_number() OVER (ORDER BY round_even(x - floor(x), 9) DESC, lang) AS r, CAST(100 - sum(floor(x)) OVER () AS BIGINT) AS more FROM e)
SELECT lang, n, CAST(floor(x) AS BIGINT) + CASE WHEN r <= more THEN 1 ELSE 0 END AS seats FROM f"""
)
def largest_remainder(spark, sf_dir):
    g = _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return reconcile.largest_remainder(g, "n", 100)


# Attempts, verdicts, differences.


@query(
    """WITH a AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
b AS (SELECT *, min(n) FILTER (ok) OVER (PARTITION BY user_id) AS f FROM a WHERE n <= 2)
SELECT user_id, CASE WHEN max(f) IS NULL THEN 'escalated' ELSE 'ok' END AS status, CAST(max(n) AS BIGINT) AS retries, CAST(NULL AS BIGINT) AS tokens FROM b WHERE f IS NULL OR n <= f GROUP BY user_id"""
)
def retry_outcome(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return reconcile.outcomes(e, "user_id", "at", "ok")


@query(
    """WITH a AS (SELECT user_id, event_type <> 'error' AS ok, CAST(value AS BIGINT) AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
b AS (SELECT *, min(n) FILTER (ok) OVER (PARTITION BY user_id) AS f FROM a WHERE n <= 2), c AS (SELECT user_id, CAST(nullif(sum(tokens), 0) AS BIGINT) AS tokens, max(f) IS NULL AS bad FROM b WHERE f IS NULL OR n <= f GROUP BY user_id)
SELECT count(*) AS tasks, CAST(coalesce(sum(bad::INT), 0) AS BIGINT) AS escalated, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN sum(bad::INT) > 0 THEN 1 ELSE 0 END AS exit_code FROM c"""
)
def run_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") != "error").alias("ok"), F.bround("value").cast("long").alias("tokens"))
    o = reconcile.outcomes(e, "user_id", "at", "ok")
    bad = F.count_if(F.col("status") == "escalated")
    return o.agg(F.count("*").alias("tasks"), bad.alias("escalated"), F.sum("tokens").alias("tokens"), F.when(bad > 0, 1).otherwise(0).alias("exit_code"))


@query(f"SELECT lang, count(*) AS total, CAST(sum(quality) AS BIGINT) AS confirmed, {_PCT.format('sum(quality)', 'count(*)', '0.0')} AS share, 100.0 * sum(quality) / count(*) >= 50 AS accepted FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def acceptance(spark, sf_dir):
    v = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.when(F.col("quality") == 1, contracts.VERDICTS[0]).otherwise(contracts.VERDICTS[1]).alias("verdict"))
    return reconcile.acceptance(v, "verdict", contracts.VERDICTS[0], 50.0, ["lang"])


@query("SELECT event_type AS verdict, count(*) AS n FROM events GROUP BY event_type")
def verdict_histogram(spark, sf_dir):
    return report.histogram(_t(spark, sf_dir, "events"), "event_type")


@query(f"SELECT lang, count(*) AS n, {_PCT.format('count(*)', '(SELECT count(*) FROM documents)', '0.0')} AS share FROM documents GROUP BY lang")
def language_share(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    total = d.agg(F.count("*").alias("total"))
    return d.groupBy("lang").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("lang", "n", X.percent(F.col("n"), F.col("total"), 0.0).alias("share"))


@query("SELECT coalesce(o_orderkey, l_orderkey) AS k, CASE WHEN o_orderkey IS NULL THEN 'added' WHEN l_orderkey IS NULL THEN 'removed' WHEN p = s THEN 'unchanged' ELSE 'modified' END AS verdict FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS p FROM orders) FULL JOIN (SELECT l_orderkey, min(l_linestatus) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def rule_differences(spark, sf_dir):
    old = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("v"))
    new = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("v"))
    return reconcile.differences(old, new, "k", "v")


@query("SELECT p_partkey, p_size > 40 AS deleted, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS rules, CASE WHEN count(l_orderkey) = 0 THEN 'not covered' WHEN p_size > 40 THEN 'deleted' ELSE 'suspect' END AS effect FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size")
def impact_map(spark, sf_dir):
    changed = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 40).alias("deleted"))
    trace = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey")
    return reconcile.impact(changed, trace, "p_partkey", "l_orderkey")


_SYNC = """o AS MATERIALIZED (SELECT CAST(o_custkey AS VARCHAR) AS file, CAST(o_orderkey AS VARCHAR) AS rule, o_orderstatus AS s, CAST(left(o_orderpriority, 1) AS INT) AS b FROM orders),
born AS MATERIALIZED (SELECT file, rule, 0 AS since, CASE WHEN s = 'P' AND b <= 3 THEN b END AS till, CASE WHEN s = 'F' AND b <= 3 THEN b END AS other FROM o
  UNION ALL SELECT file, rule || '-more', b, NULL, NULL FROM o WHERE s = 'O' AND b <= 3)"""


def _synced(spark, sf_dir):
    """A trace of orders to customers, then three batches: of the orders of one priority those that are finished say something else, pending ones go, open ones get a second rule."""
    import uuid

    from provena.operators import sync
    from provena.operators.storage import shared_folder

    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").cast("string").alias("rule"), F.col("o_orderstatus").alias("s"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("b"))
    kept = sync.Trace(spark, f"{shared_folder(spark)}/sync-{uuid.uuid4().hex}")
    kept.apply(o.select("file", "rule", F.col("s").alias("value"), F.lit(0).alias("seq")), 0)
    for k in (1, 2, 3):
        own = o.where(F.col("b") == k)
        rule = F.when(F.col("s") == "O", F.concat("rule", F.lit("-more"))).otherwise(F.col("rule"))
        kept.apply(own.select("file", rule.alias("rule"), F.when(F.col("s") != "P", F.concat("s", F.lit(str(k)))).alias("value"), F.lit(k).alias("seq")), k)
    return kept


@query(
    f"""WITH {_SYNC}, batches AS (SELECT unnest([1, 2, 3]) AS batch),
moved AS (SELECT batch, file, CASE WHEN since = batch THEN 'added' WHEN till = batch THEN 'removed' ELSE 'modified' END AS verdict FROM born, batches WHERE batch IN (since, till, other)),
left_over AS (SELECT batch, file, count(*) AS rules FROM born, batches WHERE since <= batch AND coalesce(till, 9) > batch GROUP BY batch, file)
SELECT batch, file, count(*) FILTER (verdict = 'added') AS added, count(*) FILTER (verdict = 'modified') AS modified, count(*) FILTER (verdict = 'removed') AS removed, coalesce(any_value(rules), 0) AS rules
FROM moved LEFT JOIN left_over USING (batch, file) GROUP BY batch, file"""
)
def impact_by_batches(spark, sf_dir):
    """For each batch and file that it names: what changed, and the rules that it has then. Each batch reads and writes only the buckets of its own files."""
    found = _synced(spark, sf_dir).changed().where("batch > 0")
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return found.groupBy("batch", "file").agg(n("added"), n("modified"), n("removed"), F.max("rules").alias("rules"))


@query(f"WITH {_SYNC} SELECT rule, count(*) AS files FROM born WHERE till IS NULL GROUP BY rule")
def rules_after_batches(spark, sf_dir):
    """The rules and their files after all batches, from what is kept by rule."""
    return _synced(spark, sf_dir).rules().select("rule", "files")


@query("WITH t AS (SELECT DISTINCT l_partkey FROM lineitem), c AS (SELECT p_partkey FROM part WHERE p_size > 30) SELECT (SELECT count(*) FROM t) AS traced, count(*) AS changed, 100.0 * count(*) / (SELECT count(*) FROM t) > 30 AS stop FROM c JOIN t ON l_partkey = p_partkey")
def applicability(spark, sf_dir):
    traced = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).distinct()
    changed = _t(spark, sf_dir, "part").where("p_size > 30").select(F.col("p_partkey").alias("k"), F.lit(1).alias("c"))
    n = traced.join(changed, "k", "left").agg(F.count("*").alias("traced"), F.count("c").alias("changed"))
    return n.withColumn("stop", 100.0 * F.col("changed") / F.col("traced") > 30)


@query(
    """WITH t AS (SELECT l_partkey, bool_or(p_size > 45) AS changed FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), c AS (SELECT p_brand, bool_or(p_size > 45) AS touched FROM part GROUP BY 1),
a AS (SELECT count(*) AS traced, count(*) FILTER (changed) AS changed FROM t), b AS (SELECT count(*) AS capabilities, count(*) FILTER (touched) AS touched FROM c)
SELECT traced, changed, capabilities, touched, 100.0 * changed > 30 * traced OR 2 * touched > capabilities AS stop FROM a, b"""
)
def too_much_changed(spark, sf_dir):
    """Parts are files, brands capabilities."""
    p = _t(spark, sf_dir, "part").withColumn("big", F.col("p_size") > 45)
    traced = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(p, "p_partkey").select(F.col("big").alias("changed"))
    return reconcile.stops(traced, p.groupBy("p_brand").agg(F.max("big").alias("touched")))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_in_code' WHEN quality = 1 THEN 'confirms' ELSE 'contradicts' END AS verdict FROM documents LEFT JOIN labels l USING (doc_id)")
def claim_verdicts(spark, sf_dir):
    out = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return out.select("doc_id", F.when(F.col("quality").isNull(), "not_in_code").when(F.col("quality") == 1, "confirms").otherwise("contradicts").alias("verdict"))


# Contracts, findings, reports.


@query(
    """WITH c AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT 'contract' AS "check", CAST(conv_id AS VARCHAR) AS artifact, '[' || turn || '].' || col AS path, expected, got, '' AS hint, 'error' AS severity FROM (
  SELECT conv_id, turn, 'role' AS col, 'one of: user, system' AS expected, role AS got FROM c WHERE role NOT IN ('user', 'system')
  UNION ALL SELECT conv_id, turn, 'text', 'text like ^[A-Z]', CASE WHEN length(text) > 160 THEN text[:160] || '…' ELSE text END FROM c WHERE role = 'user' AND NOT regexp_matches(text, '^[A-Z]')
  UNION ALL SELECT conv_id, turn, 'text', 'at least 40 characters', text FROM c WHERE length(text) < 40)"""
)
def contract_check(spark, sf_dir):
    rules = [contracts.required("role"), contracts.one_of("role", ["user", "system"]), contracts.when(F.col("role") == "user", contracts.pattern("text", "^[A-Z]")), contracts.min_length("text", 40)]
    return contracts.violations(_t(spark, sf_dir, "conversations"), rules, F.col("conv_id").cast("string"), F.col("turn"))


_RULES_SQL = """t AS (SELECT 'c' || conv_id AS artifact, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn, role, text FROM conversations),
f AS (SELECT artifact, 'rules[' || i || '].category' AS path, 'one of: validation, authorization, calculation, state_transition, limit, notification, other' AS expected, '"' || role || '"' AS got FROM t WHERE role <> 'system'
  UNION ALL SELECT artifact, 'rules[' || i || '].source', 'text like ^.+:[0-9]+(-[0-9]+)?$', '"nowhere"' FROM t WHERE role = 'assistant'
  UNION ALL SELECT artifact, 'rules[' || i || '].id', 'text like ^[A-Za-z0-9_.\\-]+-R-[0-9]{3,}$', '"C-R-' || turn || '"' FROM t WHERE turn % 2 = 1
  UNION ALL SELECT artifact, 'rules[' || i || '].enclosing', 'text that isn''t empty', '""' FROM t WHERE turn % 3 = 0
  UNION ALL SELECT artifact, 'rules[' || i || '].config_driven', 'type boolean or string', CAST(turn AS VARCHAR) FROM t WHERE turn % 5 = 2
  UNION ALL SELECT artifact, 'rules[' || i || ']', 'required: id, statement, category, evidence, source, enclosing, confidence', NULL FROM t WHERE turn % 4 = 1
  UNION ALL SELECT DISTINCT artifact, '(document)', 'required: repo, module, rules', NULL FROM t WHERE CAST(artifact[2:] AS INT) % 6 = 0)"""


def _rule_documents(spark, sf_dir):
    """A document of rules a conversation, a rule a turn, with something wrong in many."""
    t, role = F.col("turn"), F.col("role")
    rule = F.to_json(F.struct(
        F.concat(F.lit("C-R-"), F.when(t % 2 == 1, t.cast("string")).otherwise(X.padded(t, 3))).alias("id"), F.col("text").alias("statement"), F.when(role == "system", "other").otherwise(role).alias("category"),
        F.when(t % 4 != 1, "x = 1").alias("evidence"), F.when(role == "assistant", "nowhere").otherwise("a/b.py:1-2").alias("source"), F.when(t % 3 == 0, "").otherwise("f").alias("enclosing"),
        F.lit("high").alias("confidence"), F.when(t % 5 == 2, t).alias("config_driven"),
    ))
    rules = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", rule.alias("r")))), lambda x: x["r"]), ",")
    head = F.concat(F.lit('{"repo":"r",'), F.when(F.col("conv_id") % 6 == 0, "").otherwise('"module":"m",'), F.lit('"edge_cases_and_errors":null,"rules":['))
    made = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(rules.alias("rules"))
    return made.select(F.concat(F.lit("c"), "conv_id").alias("artifact"), F.try_parse_json(F.concat(head, "rules", F.lit("]}"))).alias("document"))


@query(f"WITH {_RULES_SQL} SELECT artifact, path, expected, got FROM f")
def nested_contract(spark, sf_dir):
    found = contracts.check_documents(_rule_documents(spark, sf_dir), contracts.KINDS["rules"], "schema:rules")
    return found.select("artifact", "path", "expected", F.when(~F.startswith("expected", F.lit("required")), F.col("got")).alias("got"))


@query(f"WITH {_RULES_SQL} SELECT row_number() OVER (ORDER BY artifact, string_split(replace(replace(path, '[', '.'), ']', ''), '.'), expected) - 1 AS place, artifact, path FROM f")
def findings_in_order(spark, sf_dir):
    """Positions sort as text: [10] before [2]."""
    found = contracts.check_documents(_rule_documents(spark, sf_dir), contracts.KINDS["rules"], "schema:rules")
    keyed = found.withColumn("parts", contracts.path_parts(F.col("path")))
    return reconcile.dense(keyed, "artifact", "parts", "expected").select(F.col("number").alias("place"), "artifact", "path")


@query(
    """WITH t AS (SELECT 'c' || conv_id AS artifact, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn FROM conversations)
SELECT artifact, '[' || i || '].verdict' AS path, 'one of: ПОДТВЕРЖДЕНО, ЧАСТИЧНО, ОПРОВЕРГНУТО, НЕ ОТНОСИТСЯ' AS expected FROM t WHERE turn % 5 = 4
UNION ALL SELECT artifact, '[' || i || ']', 'required: checked_with' FROM t WHERE turn % 5 IN (1, 4)
UNION ALL SELECT artifact, '[' || i || '].checked_with', 'text that isn''t empty' FROM t WHERE turn % 5 = 2"""
)
def validation_contract(spark, sf_dir):
    """Where the verdict isn't the accepted one, it must be said how it was checked."""
    t = F.col("turn") % 5
    row = F.to_json(F.struct(
        F.concat(F.lit("C-R-"), X.padded(F.col("turn"), 3)).alias("req_id"), F.when(t == 0, contracts.VERDICTS[0]).when(t < 4, contracts.VERDICTS[1]).otherwise("?").alias("verdict"), F.lit("ok").alias("layer1"),
        F.lit("a:1").alias("source"), F.lit("s").alias("statement"), F.when(t == 2, "").when(t == 3, "run").alias("checked_with"),
    ))
    made = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x["r"]), ",").alias("rows"))
    docs = made.select(F.concat(F.lit("c"), "conv_id").alias("artifact"), F.parse_json(F.concat(F.lit("["), "rows", F.lit("]"))).alias("document"))
    return contracts.check_documents(docs, contracts.KINDS["validation"], "schema:validation").select("artifact", "path", "expected")


def _checked_by_schema(documents, kind):
    """Findings by the contract that a table of schema documents gives for this kind."""
    rows = [(name, json.dumps(schemas.as_document(k))) for name, k in contracts.KINDS.items()]
    known = schemas.kinds(documents.sparkSession.createDataFrame(rows, "kind string, schema string"))
    return schemas.check(documents.withColumn("kind", F.lit(kind)), {kind: known[kind]}).select("check", "artifact", "path", "expected")


@query(
    r"""WITH t AS (SELECT conv_id, string_agg('{"name":' || to_json(split_part(text, ' ', 1)) || ',"summary":' || to_json(text) || ',"x-source":"' || role || CASE WHEN length(text) % 7 = 0 THEN '' ELSE ':' || turn END || '"}', ',' ORDER BY turn) AS cmds,
  string_agg('{"topic_or_queue":"' || role || '"' || CASE WHEN length(text) % 3 = 0 THEN '' ELSE ',"source":"a:' || turn || '"' END || '}', ',' ORDER BY turn) AS ev FROM conversations GROUP BY conv_id),
d AS MATERIALIZED (SELECT 'c' || conv_id AS artifact, CAST('{' || CASE conv_id % 5 WHEN 0 THEN '"openapi":"3.0","paths":{}' WHEN 1 THEN '"openapi":"2.0","paths":{}' WHEN 2 THEN '"openapi":"3.1","paths":{},"openapi_applicable":false,"openapi_absence_evidence":"e","interface":"cli"'
  WHEN 3 THEN '"openapi_applicable":false,"openapi_absence_evidence":"e","interface":"worker","commands":[' || cmds || ']' ELSE '"openapi_applicable":0,"openapi_absence_evidence":"e","interface":"cli","commands":[' || cmds || ']' END || ',"x-events":{"produces":[' || ev || '],"consumes":null}}' AS JSON) AS doc FROM t),
c AS (SELECT artifact, unnest(CAST(json_extract(doc, '$.commands') AS JSON[])) AS c FROM d WHERE json_type(doc, '$.commands') = 'ARRAY'),
good AS (SELECT artifact, bool_and(regexp_matches(json_extract_string(c, '$."x-source"'), '^.+:[0-9]+(-[0-9]+)?$') AND json_extract_string(c, '$.name') <> '') AS good FROM c GROUP BY artifact),
v AS (SELECT artifact, coalesce(json_type(doc, '$.openapi') = 'VARCHAR' AND regexp_matches(json_extract_string(doc, '$.openapi'), '^3\.') AND json_type(doc, '$.paths') = 'OBJECT', false) AS http,
  coalesce(json_type(doc, '$.openapi_applicable') = 'BOOLEAN' AND json_extract_string(doc, '$.openapi_applicable') = 'false' AND json_extract_string(doc, '$.openapi_absence_evidence') <> '' AND json_extract_string(doc, '$.interface') IN ('cli', 'library', 'worker'), false) AND coalesce(good, true) AS cli FROM d LEFT JOIN good USING (artifact)),
e AS (SELECT artifact, unnest(CAST(json_extract(doc, '$."x-events".produces') AS JSON[])) AS e, generate_subscripts(CAST(json_extract(doc, '$."x-events".produces') AS JSON[]), 1) - 1 AS i FROM d)
SELECT 'schema:interface' AS "check", artifact, '(document)' AS path, 'exactly one of the variants' AS expected FROM v WHERE CAST(http AS INT) + CAST(cli AS INT) <> 1
UNION ALL SELECT 'schema:interface', artifact, 'x-events.produces[' || i || ']', 'required: topic_or_queue, source' FROM e WHERE json_type(e, '$.source') IS NULL"""
)
def interface_contract(spark, sf_dir):
    """An interface of each conversation: a fifth are served, a fifth are commands, the others both, neither, or commands that say 0 for false."""
    role, size, source = F.col("role"), F.length("text"), F.concat(F.lit(":"), "turn")
    command = F.struct(F.split_part("text", F.lit(" "), F.lit(1)).alias("name"), F.col("text").alias("summary"), F.concat(role, F.when(size % 7 == 0, "").otherwise(source)).alias("x-source"))
    event = F.struct(role.alias("topic_or_queue"), F.when(size % 3 != 0, F.concat(F.lit("a"), source)).alias("source"))
    turns = F.array_sort(F.collect_list(F.struct("turn", command.alias("c"), event.alias("e"))))
    made = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(turns, lambda x: x["c"])).alias("cmds"), F.to_json(F.transform(turns, lambda x: x["e"])).alias("ev"))
    m, absent = F.col("conv_id") % 5, ',"openapi_absence_evidence":"e","interface":'
    head = (
        F.when(m == 0, '"openapi":"3.0","paths":{}').when(m == 1, '"openapi":"2.0","paths":{}').when(m == 2, '"openapi":"3.1","paths":{},"openapi_applicable":false' + absent + '"cli"')
        .when(m == 3, F.concat(F.lit('"openapi_applicable":false' + absent + '"worker","commands":'), "cmds")).otherwise(F.concat(F.lit('"openapi_applicable":0' + absent + '"cli","commands":'), "cmds"))
    )
    doc = F.concat(F.lit("{"), head, F.lit(',"x-events":{"produces":'), "ev", F.lit(',"consumes":null}}'))
    return _checked_by_schema(made.select(F.concat(F.lit("c"), "conv_id").alias("artifact"), F.parse_json(doc).alias("document")), "interface")


@query(
    r"""WITH s AS (SELECT conv_id, turn, role, length(text) AS size, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS k FROM conversations),
x AS (SELECT conv_id, turn, size, string_agg('{"kind":"' || CASE length(s) % 4 WHEN 0 THEN 'check' WHEN 1 THEN 'message' WHEN 2 THEN 'threshold' ELSE role END || '"' || CASE WHEN length(s) % 5 = 0 THEN '' ELSE ',"text":' || to_json(s) END || '}', ',' ORDER BY k) AS expect FROM s GROUP BY ALL),
d AS MATERIALIZED (SELECT 'c' || conv_id AS artifact, CAST('{"predictions":[' || string_agg('{"rule_id":"C-R-' || CASE WHEN size % 2 = 1 THEN CAST(turn AS VARCHAR) ELSE lpad(CAST(turn AS VARCHAR), 3, '0') END || '","expect":[' || CASE WHEN turn % 4 = 3 THEN '' ELSE expect END || ']}', ',' ORDER BY turn) || ']' || CASE WHEN conv_id % 3 = 0 THEN '' ELSE ',"capability":"c"' END || '}' AS JSON) AS doc FROM x GROUP BY conv_id),
p AS MATERIALIZED (SELECT artifact, unnest(CAST(json_extract(doc, '$.predictions') AS JSON[])) AS p, generate_subscripts(CAST(json_extract(doc, '$.predictions') AS JSON[]), 1) - 1 AS i FROM d),
e AS MATERIALIZED (SELECT artifact, 'predictions[' || i || '].expect[' AS place, unnest(CAST(json_extract(p, '$.expect') AS JSON[])) AS e, generate_subscripts(CAST(json_extract(p, '$.expect') AS JSON[]), 1) - 1 AS j FROM p)
SELECT 'schema:predictions' AS "check", artifact, '(document)' AS path, 'required: capability, predictions' AS expected FROM d WHERE json_type(doc, '$.capability') IS NULL
UNION ALL SELECT 'schema:predictions', artifact, 'predictions[' || i || '].rule_id', 'text like ^[A-Za-z0-9_.\-]+-R-[0-9]{3,}$' FROM p WHERE NOT regexp_matches(json_extract_string(p, '$.rule_id'), '^[A-Za-z0-9_.\-]+-R-[0-9]{3,}$')
UNION ALL SELECT 'schema:predictions', artifact, 'predictions[' || i || '].expect', 'at least 1 items' FROM p WHERE json_array_length(p, '$.expect') < 1
UNION ALL SELECT 'schema:predictions', artifact, place || j || '].kind', 'one of: check, message, threshold, location, other' FROM e WHERE json_extract_string(e, '$.kind') NOT IN ('check', 'message', 'threshold', 'location', 'other')
UNION ALL SELECT 'schema:predictions', artifact, place || j || '].text', 'text that isn''t empty' FROM e WHERE json_extract_string(e, '$.text') = ''
UNION ALL SELECT 'schema:predictions', artifact, place || j || ']', 'required: kind, text' FROM e WHERE json_type(e, '$.text') IS NULL"""
)
def predictions_contract(spark, sf_dir):
    """Predictions of each conversation, a rule a turn, an expectation a sentence."""
    t, role = F.col("turn"), F.col("role")

    def expectation(s):
        kind = F.when(F.length(s) % 4 == 0, "check").when(F.length(s) % 4 == 1, "message").when(F.length(s) % 4 == 2, "threshold").otherwise(role)
        return F.struct(kind.alias("kind"), F.when(F.length(s) % 5 != 0, s).alias("text"))

    expect = F.filter(F.transform(F.split("text", r"\. "), expectation), lambda x: t % 4 != 3)
    rule = F.struct(F.concat(F.lit("C-R-"), F.when(F.length("text") % 2 == 1, t.cast("string")).otherwise(X.padded(t, 3))).alias("rule_id"), expect.alias("expect"))
    made = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", rule.alias("r")))).alias("turns"))
    doc = F.to_json(F.struct(F.when(F.col("conv_id") % 3 != 0, "c").alias("capability"), F.transform("turns", lambda x: x["r"]).alias("predictions")))
    return _checked_by_schema(made.select(F.concat(F.lit("c"), "conv_id").alias("artifact"), F.parse_json(doc).alias("document")), "predictions")


@query("SELECT '{\"check\":\"contract\",\"artifact\":\"' || conv_id || '\",\"path\":\"[' || turn || '].role\",\"expected\":\"one of: user, system\",\"got\":\"' || role || '\",\"hint\":\"\",\"severity\":\"error\"}' AS json FROM conversations WHERE role NOT IN ('user', 'system')")
def json_findings(spark, sf_dir):
    found = contracts.violations(_t(spark, sf_dir, "conversations"), [contracts.one_of("role", ["user", "system"])], F.col("conv_id").cast("string"), F.col("turn"))
    return report.as_json(found)


@query(
    """WITH f AS (SELECT '| error | ' || conv_id || ' | [' || turn || '].role | one of: user, system | ' || role || ' |' AS line, row_number() OVER (ORDER BY CAST(conv_id AS VARCHAR), '[' || turn || '].role') - 1 AS k FROM conversations WHERE role NOT IN ('user', 'system'))
SELECT 0 AS part, i AS number, ['# Findings', '', '| severity | artifact | path | expected | got |', '|---|---|---|---|---|'][i + 1] AS line FROM range(4) AS t(i)
UNION ALL SELECT 1, k, line FROM f UNION ALL SELECT 2, 0, '**Errors: ' || count(*) || '**' FROM f"""
)
def findings_report(spark, sf_dir):
    found = contracts.violations(_t(spark, sf_dir, "conversations"), [contracts.one_of("role", ["user", "system"])], F.col("conv_id").cast("string"), F.col("turn"))
    return report.findings_report(found)


@query("SELECT 'contract' AS \"check\", count(*) FILTER (role NOT IN ('user', 'system')) + count(*) FILTER (length(text) < 40) AS n_errors, CAST(0 AS BIGINT) AS n_warnings, false AS ok FROM conversations")
def severity_summary(spark, sf_dir):
    rules = [contracts.one_of("role", ["user", "system"]), contracts.min_length("text", 40)]
    return findings.summary(contracts.violations(_t(spark, sf_dir, "conversations"), rules, F.col("conv_id").cast("string"), F.col("turn")))


def _dear_orders(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return o.select(*findings.finding("order", F.col("o_orderkey"), F.lit("o_totalprice"), F.lit("at most 200000"), F.bround("o_totalprice").cast("long")))


@query("SELECT 'order' AS \"check\", string_agg('- ' || o_orderkey || ' at o_totalprice' || chr(10) || '  expected: at most 200000' || chr(10) || '  got: ' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR)) AS text FROM orders WHERE o_totalprice > 200000")
def retry_text(spark, sf_dir):
    return findings.retry_text(_dear_orders(spark, sf_dir))


@query("SELECT 'order' AS \"check\", CAST(o_orderkey AS VARCHAR) AS artifact, '- ' || o_orderkey || ' at o_totalprice' || chr(10) || '  expected: at most 200000' || chr(10) || '  got: ' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) AS text FROM orders WHERE o_totalprice > 200000")
def retry_text_by_artifact(spark, sf_dir):
    return findings.retry_text(_dear_orders(spark, sf_dir), "check", "artifact")


@query(
    """WITH o AS (SELECT '- ' || o_orderkey || ' at o_totalprice' || chr(10) || '  expected: at most 200000' || chr(10) || '  got: ' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) AS t, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS k FROM orders WHERE o_totalprice > 200000)
SELECT 'order' AS "check", k // 100 AS page, count(*) AS n, string_agg(t, chr(10) ORDER BY k) AS text FROM o GROUP BY ALL"""
)
def retry_pages(spark, sf_dir):
    """What retry_text says, a hundred findings a row."""
    return findings.retry_pages(_dear_orders(spark, sf_dir), 100)


@query("SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def report_cells_by_customer(spark, sf_dir):
    """A cell of each customer's own orders."""
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), report.cell(F.col("o_orderkey"), F.col("o_orderkey")).alias("orders"))


@query("SELECT r_name AS region, count(*) AS n, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def report_cells(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return n.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"), report.cell(F.col("n_name"), F.col("n_name")).alias("nations"))


@query("SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sum(strlen(text)) <= 512 * 1024 AS fits FROM documents GROUP BY source")
def byte_budget(spark, sf_dir):
    return report.within_budget(_t(spark, sf_dir, "documents"), "text", "source", 512)


@query("SELECT doc_id AS id, text AS statement FROM documents")
def statement_projection(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("statement"))


@query("SELECT event_id, try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS BIGINT) AS metric FROM events")
def metric_extract(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).try_cast("long").alias("metric"))


@query("SELECT page_id, url || '/x.py' AS file, CAST(page_id % 50 AS INT) AS start_line, CAST(CASE WHEN page_id % 3 = 0 THEN page_id % 50 + 7 ELSE page_id % 50 END AS INT) AS end_line FROM pages")
def parse_ref(spark, sf_dir):
    n = F.col("page_id") % 50
    ref = F.concat("url", F.lit("/x.py:"), n, F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("-"), n + 7)).otherwise(""))
    return _t(spark, sf_dir, "pages").withColumn("r", X.source_ref(ref)).select("page_id", F.col("r.file").alias("file"), F.col("r.start").alias("start_line"), F.col("r.end").alias("end_line"))


@query("SELECT conv_id AS tag, 'out/' || turn || '.md' AS path, text AS body FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, 'out/' || turn || '.md', text FROM conversations WHERE conv_id % 2 = 1")
def file_blocks(spark, sf_dir):
    """Outputs made of conversations, a block a turn, read again; half of them name files without their folder."""
    c = _t(spark, sf_dir, "conversations")
    name = F.concat(F.when(F.col("conv_id") % 2 == 0, "out/").otherwise(""), F.col("turn"), F.lit(".md"))
    block = F.concat(F.lit("=== FILE: "), name, F.lit(" ===\n"), "text", F.lit("\n=== END FILE ==="))
    made = c.groupBy(F.col("conv_id").alias("tag")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n").alias("output"))
    return files.accepted_blocks(made, c.select(F.col("conv_id").alias("tag"), F.concat(F.lit("out/"), "turn", F.lit(".md")).alias("path")))


def _outputs(spark, sf_dir):
    """Outputs of conversations, a block a turn, every third for a file that nobody asked for; and the files asked for."""
    c = _t(spark, sf_dir, "conversations")
    path = F.concat(F.lit("c"), "conv_id", F.lit("/t"), "turn", F.lit(".md"))
    block = F.concat(F.lit("=== FILE: "), F.when(F.col("turn") % 3 == 2, F.concat(F.lit("other/x"), path)).otherwise(path), F.lit(" ===\n"), "text", F.lit("\n=== END FILE ==="))
    made = c.groupBy(F.col("conv_id").alias("tag")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n").alias("output"))
    return made, c.where("turn % 3 <> 2").select(F.col("conv_id").alias("tag"), path.alias("path"))


@query("SELECT 'c' || conv_id || '/t' || turn || '.md' AS path, CASE WHEN suffix(text, chr(10)) THEN text ELSE text || chr(10) END AS text FROM conversations WHERE turn % 3 <> 2")
def blocks_written(spark, sf_dir):
    """Accepted blocks as files in the shared folder, read again."""
    import uuid

    from provena.operators.storage import shared_folder
    from provena.sources import outputs

    folder = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    outputs.write_blocks(*_outputs(spark, sf_dir), folder)
    return files.text_files(spark, folder).select("path", "text")


@query("SELECT '[' || conv_id || '] a block for another path, left out: other/xc' || conv_id || '/t' || turn || '.md' AS message FROM conversations WHERE turn % 3 = 2")
def blocks_left_out(spark, sf_dir):
    """The log's lines on blocks that nobody asked for, appended in two goes and read again without their time."""
    import uuid

    from provena.operators.storage import shared_folder
    from provena.sources import outputs

    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    said = outputs.log_messages(outputs.foreign_blocks(*_outputs(spark, sf_dir)))
    late = F.contains("message", F.lit("/t2.md"))
    files.append_log(said.where(~late), folder)
    files.append_log(said.where(late), folder)
    return spark.read.text(folder).select(F.regexp_replace("value", "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2} ", "").alias("message"))


@query("SELECT page_id, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1') AS module, lpad(CAST(page_id AS VARCHAR), CAST(greatest(3, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') AS padded, CASE WHEN length(html) > 200 THEN html[:200] || '…' ELSE html END AS cut FROM pages")
def scalar_functions(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", X.file_name(F.col("url")).alias("name"), X.module_name(F.col("url")).alias("module"), X.padded(F.col("page_id"), 3).alias("padded"), X.clipped(F.col("html"), 200).alias("cut"))


@query(f"WITH l AS {_LINES} SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, {_NORM.format('lines[1]')} AS first_line FROM l")
def text_lines(spark, sf_dir):
    d = _line_docs(spark, sf_dir)
    return d.select("doc_id", F.size("lines").cast("long").alias("n_lines"), X.normalise(F.try_element_at("lines", F.lit(1))).alias("first_line"))


# Code. A source for each conversation, made of its turns: the user's raise in an `if`, the system's in a `match` of a method, others have no branch.


def _code(spark, sf_dir, other: bool):
    c, t, role = _t(spark, sf_dir, "conversations"), F.col("turn"), F.col("role")
    if other:
        user, system, rest = "function turn_{T}(x) {\n  if (x) {\n    throw {T};\n  }\n}", "  switch (x) {\n    case 1: throw {T};\n  }", "function turn_{T}(x) { return x; }"
    else:
        user, system, rest = "def turn_{T}(x):\n    if x:\n        raise ValueError({T})\n    return x", "class Turn_{T}:\n    def run(self, x):\n        match x:\n            case 1:\n                raise KeyError({T})", "def turn_{T}(x):\n    return x"
    own = F.replace(F.when(role == "user", user).when(role == "system", system).otherwise(rest), F.lit("{T}"), t.cast("string"))
    made = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", own.alias("c")))), lambda x: x["c"]), "\n")
    return c.groupBy(F.concat(F.lit("c"), "conv_id").alias("path")).agg(made.alias("text"))


@query("SELECT 'c' || conv_id AS path, CAST(2 * count(*) FILTER (role IN ('user', 'system')) AS BIGINT) AS branches, count(*) AS functions FROM conversations GROUP BY conv_id")
def py_branches(spark, sf_dir):
    found = code.python_items(_code(spark, sf_dir, False))
    return found.groupBy("path").agg(F.count_if(F.col("what") == "branch").alias("branches"), F.count_if(F.col("what") == "function").alias("functions"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{7,}') AS words FROM conversations),
s AS (SELECT 'c' || conv_id AS path, string_agg('def turn_' || turn || '(x):' || chr(10) || array_to_string(list_transform(words, lambda w: '    if x == ''' || w || ''': raise KeyError(''' || w || ''')' || chr(10)), '') || '    return ''if raise''', chr(10) ORDER BY turn) AS text FROM w GROUP BY conv_id),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM s),
b AS (SELECT path, 'if' AS name, line FROM l WHERE regexp_matches(l, '^\s*if ') UNION ALL SELECT path, 'raise', line FROM l WHERE regexp_matches(l, ':\s*raise '))
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY line, name) - 1 AS INT) AS number, name, CAST(line AS INT) AS line FROM b"""
)
def branches_in_order(spark, sf_dir):
    """A source for each conversation, with an `if` and a `raise` in one line for each long word of its texts; branches by line, then kind."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{7,}"), F.lit(0))
    body = F.array_join(F.transform(words, lambda w: F.concat(F.lit("    if x == '"), w, F.lit("': raise KeyError('"), w, F.lit("')\n"))), "")
    own = F.concat(F.lit("def turn_"), "turn", F.lit("(x):\n"), body, F.lit("    return 'if raise'"))
    made = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", own.alias("c")))), lambda x: x["c"]), "\n")
    sources = _t(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("c"), "conv_id").alias("path")).agg(made.alias("text"))
    return code.python_branches(sources).select("path", "number", "name", "line")


@query(f"WITH n AS (SELECT 'c' || conv_id AS path, CAST(2 * count(*) FILTER (role IN ('user', 'system')) AS BIGINT) AS total, CAST(count(*) FILTER (role IN ('user', 'system')) AS BIGINT) AS covered FROM conversations GROUP BY conv_id) SELECT path, total, covered, {_PCT.format('covered', 'total', '100.0')} AS share FROM n")
def py_coverage(spark, sf_dir):
    """Rules name the line before each raise: it is within the `if` or `match` above, and not the raise. Sources without branches have 100.0."""
    sources = _code(spark, sf_dir, False)
    branches = code.python_items(sources).where("what = 'branch'")
    rules = branches.where("name = 'raise'").select("path", (F.col("line") - 1).alias("start"), (F.col("line") - 1).alias("end"))
    return code.coverage(branches, rules, 0, sources)


@query("SELECT 'c' || conv_id AS path, CASE WHEN role = 'system' THEN 'Turn_' || turn || '.run' ELSE 'turn_' || turn END AS name FROM conversations WHERE role NOT IN ('user', 'system')")
def functions_without_rules(spark, sf_dir):
    found = code.python_items(_code(spark, sf_dir, False))
    rules = found.where("what = 'branch' and name = 'raise'").select("path", F.col("line").alias("start"), "end")
    return code.without_rules(found.where("what = 'function'"), rules).select("path", "name")


@query("SELECT 'c' || conv_id AS path, count(*) FILTER (role = 'user') AS ifs, count(*) FILTER (role = 'user') AS raises, count(*) FILTER (role = 'system') AS matches FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role IN ('user', 'system')) > 0")
def line_branches(spark, sf_dir):
    found = code.line_branches(_code(spark, sf_dir, True))
    return found.groupBy("path").agg(*[F.count_if(F.col("name") == n).alias(c) for n, c in (("if", "ifs"), ("raise", "raises"), ("match", "matches"))])


@query(
    r"""WITH t AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN ['def turn_T(x):', '    if x:', '        raise ValueError(T)', '    return x'] WHEN 'system' THEN ['class Turn_T:', '    def run(self, x):', '        match x:', '            case 1:', '                raise KeyError(T)'] ELSE ['def turn_T(x):', '    return x'] END AS body FROM conversations),
u AS (SELECT *, coalesce(sum(len(body)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
whole AS (SELECT conv_id, flatten(list(list_transform(body, lambda x: replace(x, 'T', CAST(turn AS VARCHAR))) ORDER BY turn)) AS lines FROM t GROUP BY conv_id),
spans AS (SELECT conv_id, before + CASE role WHEN 'system' THEN 2 ELSE 1 END AS lo, before + len(body) AS hi, CASE role WHEN 'system' THEN 'run' ELSE 'turn_' || turn END AS name FROM u),
r AS (SELECT conv_id, turn, conv_id % 5 AS kind, before + CASE role WHEN 'user' THEN 3 WHEN 'system' THEN 5 ELSE 2 END + turn % 9 - 4 AS said, CASE role WHEN 'user' THEN 'raise ValueError(' || turn || ')' WHEN 'system' THEN 'raise KeyError(' || turn || ')' ELSE 'return x' END AS quote, CASE role WHEN 'system' THEN 'run' ELSE 'turn_' || turn END AS own FROM u),
x AS (SELECT r.*, lines, (SELECT name FROM spans s WHERE s.conv_id = r.conv_id AND said BETWEEN lo AND hi) AS actual FROM r JOIN whole USING (conv_id))
SELECT 'c' || conv_id || '-' || turn AS id, CASE WHEN kind = 1 THEN 'no such file' WHEN said < 1 OR said > len(lines) THEN 'no such line'
  WHEN NOT contains(trim(regexp_replace(array_to_string(lines[CAST(greatest(said - 3, 1) AS BIGINT):CAST(said + 1 + 3 AS BIGINT)], ' '), '\s+', ' ', 'g')), CASE WHEN kind = 2 THEN 'never said ' ELSE '' END || quote) THEN 'quote not found'
  WHEN kind = 4 THEN NULL WHEN actual IS NULL THEN 'module level' WHEN kind = 3 OR own <> actual THEN 'other function' END AS problem FROM x"""
)
def evidence_binding(spark, sf_dir):
    """Rules made of each turn; they say a line up to four off, a fifth of them another file, a fifth another quote, a fifth another function."""
    from pyspark.sql import Window

    sources = _code(spark, sf_dir, False)
    found = code.python_items(sources).where("what = 'span'")
    bodies = sources.select("path", X.lines(F.col("text")).alias("lines"))
    kind, t, role = F.col("conv_id") % 5, F.col("turn"), F.col("role")
    tall = F.when(role == "user", 4).when(role == "system", 5).otherwise(2)
    before = F.coalesce(F.sum(tall).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = (before + F.when(role == "user", 3).when(role == "system", 5).otherwise(2) + t % 9 - 4).cast("int")
    quote = F.when(role == "user", F.concat(F.lit("raise   ValueError("), t, F.lit(")"))).when(role == "system", F.concat(F.lit("raise KeyError("), t, F.lit(")"))).otherwise("return x")
    own = F.when(role == "system", F.lit("Some.run")).otherwise(F.concat(F.lit("Some.turn_"), t))
    rules = _t(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.concat(F.when(kind == 1, "no/c").otherwise("c"), "conv_id").alias("source_file"), at.alias("start"), at.alias("end"),
        F.concat(F.when(kind == 2, "never said ").otherwise(""), quote).alias("evidence"), F.when(kind == 3, "elsewhere").when(kind == 4, "UNCERTAIN").otherwise(own).alias("enclosing"),
    )
    return spans.bound(rules, bodies, found.select("path", F.col("line").alias("start"), "end", "name", "ord")).select("id", "problem")
