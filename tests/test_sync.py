"""The trace that is kept by deltas against one that is built anew; batches that fail or come twice."""

import random

import pytest
from pyspark.sql import functions as F

from provena.operators import sync


def _rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_batches_equal_the_whole(spark, tmp_path):
    r, plain, kept = random.Random(1), {}, sync.Trace(spark, str(tmp_path), 8)
    for batch in range(4):
        changes, before = [], dict(plain)
        for seq in range(60 if batch else 120):
            at, value = (r.choice("abcdefg") + str(r.randint(0, 3)), f"R{r.randint(0, 15)}"), r.choice(["x", "y", "z", None])
            changes.append((*at, value, seq))
            plain.pop(at, None)
            if value is not None:
                plain[at] = value
        got = kept.apply(spark.createDataFrame(changes, "file string, rule string, value string, seq int").repartition(3), batch)
        named = {(f, x) for f, x, _, _ in changes}
        verdict = lambda k: "absent" if k not in before and k not in plain else "added" if k not in before else "removed" if k not in plain else "unchanged" if before[k] == plain[k] else "modified"  # noqa: B023, E731
        assert _rows(got.select("file", "rule", "verdict", "rules")) == sorted((*k, verdict(k), sum(f == k[0] for f, _ in plain)) for k in named)
        assert _rows(kept.trace().select("file", "rule", "value")) == sorted((*k, v) for k, v in plain.items())
        assert _rows(kept.rules()) == _rows(sync.digests(kept.trace()).select("rule", "files", "digest"))
    again = sync.Trace(spark, str(tmp_path), 8)
    assert again.state == kept.state and _rows(again.changed()) == _rows(kept.changed())


def test_a_batch_reads_its_own_buckets_and_comes_once(spark, tmp_path):
    kept = sync.Trace(spark, str(tmp_path), 64)
    kept.apply(spark.createDataFrame([(f"f{k}", "r", "x", 0) for k in range(300)], "file string, rule string, value string, seq int"), 0)
    versions = dict(kept.state["trace"])
    one = spark.createDataFrame([("f7", "r", "y", 0), ("f7", "q", None, 0)], "file string, rule string, value string, seq int")
    kept.apply(one, 1)
    assert sum(kept.state["trace"][b] != v for b, v in versions.items()) == 1
    held = kept._read("trace", sync._TRACE, [int(b) for b, v in kept.state["trace"].items() if v == 1])
    assert held.inputFiles() and all("/v1/" in f for f in held.inputFiles())
    before = _rows(kept.trace())
    assert _rows(kept.apply(one, 1)) == _rows(kept.changed(1)) == [("f7", "q", "absent", 1, 1), ("f7", "r", "modified", 1, 1)]
    assert _rows(kept.trace()) == before
    with pytest.raises(ValueError):
        kept.apply(one, 5)
    with pytest.raises(Exception):  # noqa: B017
        kept.apply(one.withColumn("value", F.raise_error(F.lit("lost"))), 2)
    assert kept.state["batch"] == 1 and _rows(kept.trace()) == before
    kept.apply(one.withColumn("value", F.lit(None).cast("string")), 2)
    assert "f7" not in {x[0] for x in _rows(kept.trace())} and sync.Trace(spark, str(tmp_path)).state["batch"] == 2
