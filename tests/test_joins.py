"""Joins of spans, needles and lines against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from provena.operators import completeness, containment, needles, spans


def _stretches(r, n, far):
    out = []
    for k in range(n):
        lo = r.randint(-far, far)
        out.append((k, r.choice("ab"), lo, lo + r.choice([0, 1, 2, r.randint(0, 40), r.randint(0, far)])))
    return out


@pytest.mark.parametrize("far", [20, 1 << 41])
def test_overlaps_and_innermost_by_loops(spark, far):
    r = random.Random(far)
    items, ranges = _stretches(r, 150, far), _stretches(r, 60, far)
    frame = lambda rows: spark.createDataFrame(rows, "id long, k string, start long, end long")
    for more in (0, 3):
        want = {i for i, k, a, b in items if any(k == q and c - more <= b and d + more >= a for _, q, c, d in ranges)}
        flagged = {x.id: x.hit for x in spans.overlaps(frame(items), frame(ranges), "k", more, "flag").collect()}
        assert {i for i, hit in flagged.items() if hit} == want and len(flagged) == len(items)
        assert {x.id for x in spans.overlaps(frame(items), frame(ranges), "k", more).collect()} == want
        assert {x.id for x in spans.overlaps(frame(items), frame(ranges), "k", more, "left_anti").collect()} == {x[0] for x in items} - want
    points = frame([(i, k, a, a) for i, k, a, _ in items])
    want = {}
    for i, k, at, _ in items:
        around = [(d - c, -x, x) for x, q, c, d in ranges if q == k and c <= at <= d]
        want[i] = min(around)[2] if around else None
    got = spans.innermost(points.withColumnRenamed("id", "p"), frame(ranges), "k", "start", "p", "id", "id")
    assert {x.p: x.id for x in got.collect()} == want


def test_nodes_are_few_and_make_up_the_span(spark):
    r = random.Random(1)
    rows = [(lo, lo + r.randint(0, 1 << r.randint(0, 45))) for lo in (r.randint(-(1 << 40), 1 << 40) for _ in range(300))]
    for x in spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", spans.nodes(F.col("lo"), F.col("hi")).alias("x")).collect():
        own = sorted((n.node << n.level, (n.node + 1) << n.level) for n in x.x)
        assert len(own) <= 2 * (x.hi - x.lo + 1).bit_length()
        assert own[0][0] == x.lo and own[-1][1] == x.hi + 1 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    plan = spans.overlaps(spark.createDataFrame([("a", 1, 2)], "k string, start long, end long"), spark.createDataFrame([("a", 0, 1 << 41)], "k string, start long, end long"), "k")
    assert plan.count() == 1 and "NestedLoop" not in plan._jdf.queryExecution().toString()


def test_occurrences_by_patterns(spark, monkeypatch):
    r = random.Random(2)
    ids = ["A-R-1", "A-R-12", "B.A-R-1", "R-1", "aa", "a", "ö_ß", "A-R-1-", "zz"]
    lines = ["".join(r.choice([*ids, "-", "_", " ", "x", "é", ".", "7"]) for _ in range(r.randint(0, 30))) for _ in range(300)]
    lines += ["A-R-1" * 20_000, "a" * 100_000, "x-R-" * 25_000 + "R-1", "", None]
    texts = spark.createDataFrame([(x,) for x in lines], "line string").repartition(3)
    wanted = spark.createDataFrame([(x,) for x in [*ids, "", None, "a"]], "rule_id string")
    for size in (needles.PART_BYTES, 20):
        monkeypatch.setattr(needles, "PART_BYTES", size)
        for whole, end in ((True, r"(?![\w-])"), (False, "")):
            got = {x.rule_id: x.times for x in needles.occurrences(wanted, texts, "rule_id", "line", whole).collect()}
            want = {x: sum(len(re.findall(re.escape(x) + end, t or "")) for t in lines) for x in ids}
            assert got == {k: v for k, v in want.items() if v}
    table = spark.createDataFrame([("| " + (x or ""),) for x in lines], "line string")
    got = {x.rule_id: x.times for x in completeness.occurrences(spark.createDataFrame([(x,) for x in ids], "rule_id string"), table).collect()}
    assert got == {x: sum(len(re.findall(re.escape(x) + r"(?![\w-])", t or "")) for t in lines) for x in ids}
    assert needles.occurrences(wanted.where("false"), texts, "rule_id", "line").count() == 0


def test_short_passages_without_a_nested_loop(spark, monkeypatch):
    r = random.Random(3)
    words = ["go", "out", "g", "<n>", "a<num>", "o'clock", "7", "12.5", "x(y)", "é"]
    said = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 2)))) for k in range(80)]
    texts = [(k, " ".join(r.choice([*words[:3], "a7", "19", *words[5:], "nothing"]) for _ in range(r.randint(0, 5)))) for k in range(60)] + [(99, None)]
    number = r"[0-9][0-9_]*(?:\.[0-9]+)?"
    want = set()
    for p, s in said:
        pattern = number.join(re.escape(x) for x in re.split(r"<\s*(?:n|num|число)\s*>", s))
        want |= {(p, d) for d, t in texts if t and (s in t or re.search(pattern, t))}
    for size in (needles.PART_BYTES, 60):
        monkeypatch.setattr(containment, "SHORT_BYTES", size)
        found = containment.containing(spark.createDataFrame(said, "p long, text string"), spark.createDataFrame(texts, "d long, text string"), "p", "d")
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
        assert sorted(map(tuple, found.collect())) == sorted(want)


def _nearest(lines, target):
    """Going up line by line."""
    n, indent = target
    for at in range(n - 1, 0, -1):
        own, text, name = lines[at]
        if text.strip() and own < indent:
            if name:
                return name
            indent = own
    return None


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_nearest_preceding_over_parts(spark, parts):
    r = random.Random(parts)
    rows, want = [], {}
    for doc, size in ((1, 400), (2, 3), (3, 0), (4, 90)):
        lines = {n: (r.choice([0, 1, 2, 2, 3, 4, 5, 6, 9]), r.choice(["x", "y", " "]), f"f{n}" if r.random() < 0.15 else None) for n in range(1, size + 1)}
        rows += [(doc, n, *x) for n, x in lines.items()]
        want |= {(doc, n): _nearest(lines, (n, lines[n][0])) for n in lines if n % 3 == 0}
    lines = spark.createDataFrame(rows, "doc long, n int, indent int, line string, name string")
    targets = spark.createDataFrame([(*x, "t") for x in want], "doc long, n int, more string")
    got = {(x.doc, x.n): x.name for x in spans.nearest_preceding(targets, lines, "doc", F.col("name"), parts).collect()}
    assert got == want
