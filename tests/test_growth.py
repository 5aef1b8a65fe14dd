"""Work that must not grow faster than the input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from provena.operators import containment, needles, reconcile, spans, sync


def test_names_that_are_common_alone_make_no_candidates_of_all_texts(spark, monkeypatch):
    made, by_rarest = [], containment.by_rarest

    def counted(*args):
        out = by_rarest(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(containment, "by_rarest", counted)
    text = lambda i, size: f"a red n{i % 8} made by b{i // 8 % 8} of size {size} at {size} each"
    texts = spark.createDataFrame([(i, "The part is " + text(i, i % 5 + 1)) for i in range(256)], "d long, text string")
    said = spark.createDataFrame([(i, text(i, "<n>")) for i in range(64)] + [(64, "is a red n3 made by"), (65, "n2"), (66, "is a red <n> made by")], "p long, text string")
    found = sorted(map(tuple, containment.containing(said, texts, "p", "d").collect()))
    assert found == sorted([(i % 64, i) for i in range(256)] + [(64, i) for i in range(256) if i % 8 == 3] + [(65, i) for i in range(256) if i % 8 == 2])
    # Each text is a candidate of its own passage alone, besides those of passage 64, and of 66, which has but single words.
    assert sum(made) == 256 + 32 + 256


@pytest.mark.parametrize("few", [0, 5, 1000])
def test_innermost_of_few_and_many_spans(spark, monkeypatch, few):
    monkeypatch.setattr(spans, "FEW_SPANS", few, raising=False)
    r = random.Random(few)
    ranges = [(i, "abbbcccccccc"[i % 12], lo, lo + r.randint(-1, 30)) for i, lo in enumerate(r.randint(-50, 50) for _ in range(60))]
    points = [(i, r.choice(["a", "b", "c", "d", None]), r.choice([None, *range(-60, 60)])) for i in range(200)]
    want = {}
    for i, k, at in points:
        around = [(d - c, -x, x) for x, q, c, d in ranges if q == k and at is not None and c <= at <= d]
        want[i] = min(around)[2] if around else None
    found = spans.innermost(spark.createDataFrame(points, "p long, k string, at long"), spark.createDataFrame(ranges, "id long, k string, start long, end long"), "k", "at", "p", "id", "id")
    assert {x.p: x.id for x in found.collect()} == want
    if few == 1000:
        assert "explode" not in found._jdf.queryExecution().toString().lower()


def test_keys_of_both_sides_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "ROWS_A_TASK", 100, raising=False)
    left, right = (spark.range(a, b).selectExpr("if(id % 50 = 0, null, id) as k").union(spark.range(7).selectExpr("5 as k")) for a, b in ((0, 600), (300, 1000)))
    found = reconcile.both_ways(left, right, "k")
    want = [(k, "left") for k in range(300) if k % 50 and k != 5] + [(k, "right") for k in range(600, 1000) if k % 50]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.rdd.getNumPartitions() == 14


@pytest.mark.parametrize("longest", [3, 64])
def test_many_needles_take_one_pass(spark, monkeypatch, longest):
    monkeypatch.setattr(needles, "MOST_LENGTH", longest, raising=False)
    monkeypatch.setattr(needles, "SLICE_CHARS", 40, raising=False)
    parts = [0]
    automaton = needles.parts
    monkeypatch.setattr(needles, "parts", lambda own, needle, most: (parts.__setitem__(0, parts[0] + 1) or x for x in automaton(own, needle, most)))
    monkeypatch.setattr(needles, "PART_BYTES", 100)
    r = random.Random(longest)
    ids = ["".join(r.choice("aé-7_ß") for _ in range(r.randint(1, 7))) for _ in range(80)] + ["aa", "aaa"]
    lines = ["".join(r.choice([*ids, " ", ".", "𝄞", "a"]) for _ in range(r.randint(0, 30))) for _ in range(120)] + ["aaaaaaa aaaa", None, ""]
    texts, wanted = spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame([(x,) for x in ids], "id string")
    for whole, end in ((True, r"(?![\w-])"), (False, "")):
        want = {x: n for x in ids if (n := sum(len(re.findall(re.escape(x) + end, t or "")) for t in lines))}
        assert {x.id: x.times for x in needles.occurrences(wanted, texts, "id", "line", whole).collect()} == want
    if longest == 64:
        assert parts[0] == 0


def test_buckets_are_computed_once(spark, tmp_path):
    seen, trace = spark.sparkContext.accumulator(0), sync.Trace(spark, str(tmp_path), 4)

    def told(x):
        seen.add(1)
        return x

    rows = spark.range(30).select(F.udf(told, "string")(F.col("id").cast("string")).alias("rule"), (F.col("id") % 3).cast("int").alias("bucket"))
    trace._write("rules", rows, 0, [0, 1, 2, 3])
    assert trace.state["rules"] == {"0": 0, "1": 0, "2": 0} and seen.value == 30
    trace._write("rules", rows.where("false"), 1, [0, 1])
    assert trace.state["rules"] == {"2": 0}
