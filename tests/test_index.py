import random

import pytest
from pyspark.sql import functions as F

from provena.operators import containment, index

WORDS = ["ab", "b", "cab", "ß", "Nein", "x1", "12", "the", "a"]


def _made(r, n):
    return [(k, None if r.random() < 0.05 else "".join(r.choice(WORDS) + r.choice([" ", "  ", "\n"]) for _ in range(r.choice([0, 1, 3, 8, 60])))) for k in range(n)]


def _passages(r, texts, n):
    out = [(0, None), (1, ""), (2, " "), (3, "the <n> b"), (4, "<n>"), (5, "a the <num> the ab b 12"), (6, "nowhere at all to be found"), (None, "the a b")]
    for k in range(7, n):
        words = (r.choice(texts)[1] or "").split()
        at = r.randrange(len(words) + 1)
        out.append((k, " ".join(words[at : at + r.randint(1, 16)])[r.randint(0, 1) :]))
    return out


def test_equals_containment_of_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SLOT_BYTES", 2000)
    r = random.Random(2000)
    texts = _made(r, 120)
    texts += [(k + 1000, t) for k, t in texts[:40]] + [texts[0], (None, texts[50][1]), (7777, "the a b " * 500)]
    frame = lambda rows: spark.createDataFrame(rows, "d long, text string").repartition(3)
    passages = spark.createDataFrame(_passages(r, texts, 80), "p int, text string")
    pairs = lambda df: {tuple(x) for x in df.where("d is not null and p is not null").collect()}
    want = pairs(containment.containing(passages, frame(texts), "p", "d"))
    assert len(want) > 200

    folder = "file:" + str(tmp_path / "index")
    different = {t or "" for _, t in texts}
    assert index.Index(spark, folder).put(frame(texts[:70]), "d", "c") == len({t or "" for _, t in texts[:70]})
    first = pairs(containment.containing(passages, frame(texts[:70]), "p", "d"))
    assert pairs(index.Index(spark, folder).containing(passages, "c", "p")) == first
    assert index.Index(spark, folder).put(frame(texts), "d", "all") == len(different) - len({t or "" for _, t in texts[:70]})
    made = index.Index(spark, folder)
    assert made.put(frame(texts).withColumn("p", F.lit(1)), "d", "again") == 0 and len(made.state["parts"]) == 2
    for name, rows in (("again", want), ("c", first)):
        found = made.containing(passages, name, "p")
        assert pairs(found) == rows
    # A row of the corpus, whatever its id, is a row of what stands in it.
    bare = spark.createDataFrame([(1, (texts[50][1] or "") + "x"), (2, "the a b the a b the")], "p int, text string")
    again = [tuple(x) for x in made.containing(bare, "again", "p").collect()]
    assert (2, 7777) in again and not [x for x in again if x[0] == 1]
    made.compact()
    assert len(index.Index(spark, folder).state["parts"]) == 1 and pairs(index.Index(spark, folder).containing(passages, "c", "p")) == first


def test_a_use_reads_the_index_alone_and_few_slots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SLOT_BYTES", 1 << 11)
    source, folder = str(tmp_path / "source"), str(tmp_path / "index")
    spark.range(2000).selectExpr("id AS d", "concat('alpha w', id, ' x', id, ' y', id, ' z', id, ' v', id, ' u', id, ' t', id, ' omega') AS text").write.parquet(source)
    assert index.Index(spark, folder).put(spark.read.parquet(source), "d", "c") == 2000
    (tmp_path / "source").rename(tmp_path / "gone")
    read, kept = [], index.kept
    monkeypatch.setattr(index, "kept", lambda df: read.extend(df.inputFiles()) or kept(df))
    found = index.Index(spark, folder).containing(spark.createDataFrame([(1, "b w77 x77 y77 z77 v77 u77 t77 o")], "p int, text string"), "c", "p")
    assert [tuple(x) for x in found.collect()] == []
    found = index.Index(spark, folder).containing(spark.createDataFrame([(1, "ha w77 X77  y77 z77 v77 u77 t77 o")], "p int, text string"), "c", "p")
    assert [tuple(x) for x in found.collect()] == [(1, 77)]
    assert not [f for f in [*read, *found.inputFiles()] if "/index/" not in f]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "slot#" in plan and "PartitionFilters: [" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    runs = spark.read.parquet(f"{folder}/runs/*")
    assert runs.select("slot").distinct().count() > 50


def test_what_died_before_its_manifest_is_not_there(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "index")
    frame = spark.createDataFrame([(1, "one two three four five")], "d long, text string")
    made, other = index.Index(spark, folder), index.Index(spark, folder)
    monkeypatch.setattr(index.Index, "_say", lambda self, state: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        made.put(frame, "d", "c")
    monkeypatch.undo()
    assert index.Index(spark, folder).state["parts"] == [] and made.state["parts"] == []
    assert made.put(frame, "d", "c") == 1
    with pytest.raises(Exception, match="already exists"):
        other.put(frame, "d", "late")
    assert set(index.Index(spark, folder).state["corpora"]) == {"c"}
    assert index.Index(spark, folder).put(frame.limit(0), "d", "none") == 0
    assert index.Index(spark, folder).containing(frame.withColumnRenamed("d", "p"), "none", "p").count() == 0


def test_slots_are_of_one_size_and_only_candidates_are_moved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SLICE_BYTES", 300, raising=False)
    r, folder = random.Random(7), str(tmp_path)
    texts = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(20))) for i in range(300)] + [(300, None), (301, ""), (302, "é ß " * 30), (303, "x \u0001 y " * 20)]
    made = index.Index(spark, folder)
    made.put(spark.createDataFrame(texts, "d long, text string"), "d", "c")
    runs = [tuple(x) for x in spark.read.parquet(f"{folder}/runs/*").select("h", "no").collect()]
    # What is least is mixed again: half of all begin with a one, and a text has each once.
    assert 0.4 < sum(h < 0 for h, _ in runs) / len(runs) < 0.6 and len(set(runs)) == len(runs)
    inside = [(i, " ".join(texts[i][1].split()[k : k + 8])[1:]) for i in range(300) for k in (0, 6, 12)] + [(302, "é ß é ß é ß é ß é"), (-1, "x y x y x y x y x")]
    found = made.containing(spark.createDataFrame(inside, "p long, text string"), "c", "p")
    assert {tuple(x) for x in found.collect()} == {(i, i) for i in (*range(300), 302)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [no" in plan and "LeftSemi" in plan


def test_hashes_of_an_older_form_are_made_anew(spark, tmp_path):
    frame = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "d long, text string")
    made = index.Index(spark, str(tmp_path))
    made.put(frame, "d", "c")
    made.state["parts"][0].pop("hashes")
    with pytest.raises(ValueError, match="compact"):
        made.containing(frame.withColumnRenamed("d", "p"), "c", "p")
    made.compact()
    assert [tuple(x) for x in made.containing(frame.withColumnRenamed("d", "p"), "c", "p").collect()] == [(1, 1)]
