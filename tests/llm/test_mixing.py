"""Mixing sources: targets by repeated sharing, the schedule point by point, the query against the mix laid out word by word."""

import math
import os
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from provena.llm import mixing as m

SF = "/root/testdata/sf0.001"


def _targets(sizes, weights=(1, 2, 3), most=3):
    """sizes by source, in order: what each gets, sharing again what the full ones can't take."""
    got = {s: Fraction(0) for s in sizes}
    w = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    full, left = set(), Fraction(sum(sizes.values()))
    while left > 0 and len(full) < len(sizes):
        whole = sum(w[s] for s in sizes if s not in full)
        share = {s: left * w[s] / whole for s in sizes if s not in full}
        left = Fraction(0)
        for s, x in share.items():
            got[s] += x
            if got[s] > most * sizes[s]:
                left += got[s] - most * sizes[s]
                got[s] = Fraction(most * sizes[s])
                full.add(s)
    return got


def _rows(seed=3, n=400):
    r = random.Random(seed)
    sources = [None, "", "a", "B", "zz", "é", "😀", "hot", "hot", "hot", "hot"]
    rows = [(k, "  ".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 1, 5, 40, 90]))) + r.choice(["", "\n", " "]), r.choice(sources)) for k in range(n)]
    return rows + [(1000, None, "only nulls"), (1001, "", "only nulls"), (1002, "one\x85word", "tiny"), (None, "two words", "tiny"), (None, "two words", "tiny"), (None, "two words", "tiny"), (1003, "long " * 5000, "B")]


def _frame(spark, rows):
    return spark.createDataFrame([(*x, 5, "t") for x in rows], "doc_id long, text string, source string, size int, target string").repartition(3)


def test_words(spark):
    texts = ["", " ", "a", " a\tb\n", "a b", None, "\x0b\x0cx y", "é 😀", "a" * 100000, "a " * 100000, "\x85  "]
    got = [x[0] for x in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(m.words(m.F.col("t"))).collect()]
    assert got == [len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]) for t in texts]


@pytest.mark.parametrize("takes", [[1], [5, 0, 3], [1000, 1, 1, 700, 33, 0, 2], [64, 64, 64, 64], list(range(40))])
def test_schedule_maps_every_point(spark, takes):
    n = [math.ceil(t / 4) for t in takes]
    total, bits = sum(n), max(0, sum(n) - 1).bit_length()
    sources = spark.createDataFrame([(k, t) for k, t in enumerate(takes)], "number long, take long")
    got = sorted(tuple(x) for x in m.schedule(sources, 4).select("slot", "number", "rank").collect())
    want, seen, ends = [], Counter(), [sum(n[: k + 1]) for k in range(len(n))]
    for slot in range(1 << bits):
        point = int(format(slot, f"0{bits}b")[::-1], 2) if bits else 0
        if point < total:
            source = next(k for k, e in enumerate(ends) if point < e)
            want.append((slot, source, seen[source]))
            seen[source] += 1
    assert got == want
    # In every beginning of the mix the sources have about their shares.
    so_far = Counter()
    for k, (_, source, _) in enumerate(want, 1):
        so_far[source] += 1
        assert all(abs(so_far[s] - k * n[s] / total) <= 2 + bits for s in range(len(n)))


@pytest.mark.parametrize("block", [1024, 7])
def test_mix_word_by_word(spark, block):
    rows = _rows()
    docs = _frame(spark, rows)
    split = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(split(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = _targets({s: sizes[s] for s in order})
    report = m.report(docs, block).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.source or "", x["size"]) for x in report) == sorted((i is None, i or 0, s or "", len(split(t))) for i, t, s in rows)
    taken = Counter()
    for x in report:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(float(want[x.source]), rel=1e-12)
        assert 0 <= x.taken <= 3 * x["size"]
        assert x["size"] * math.floor(x.target / max(1, x.source_size)) <= x.taken <= x["size"] * math.ceil(x.target / max(1, x.source_size))
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    parts = m.texts(m.mix(docs, block), docs).orderBy("slot", "place").collect()
    by_slot, by_doc = defaultdict(list), Counter()
    for p in parts:
        assert len(p.words.split(" ")) == p.n
        by_slot[p.slot].append(p)
        by_doc[p.id, p.source] += p.n
    assert by_doc == Counter({(x.doc_id, x.source): sum(y.taken for y in report if (y.doc_id, y.source) == (x.doc_id, x.source)) for x in report if x.taken})
    short = Counter()
    for own in by_slot.values():
        assert len({p.source for p in own}) == 1
        assert [p.place for p in own] == [sum(q.n for q in own[:k]) for k in range(len(own))]
        short[own[0].source] += sum(p.n for p in own) < block
    assert max(short.values()) <= 1
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(tuple(split(t)))
    assert all(any(tuple(p.words.split(" ")) == t[p.first : p.first + p.n] for t in texts[p.id]) for p in parts)


def test_reruns_agree_and_empty(spark):
    rows = _rows(4, 150)
    one = sorted(map(str, m.report(_frame(spark, rows)).collect()))
    assert one == sorted(map(str, m.report(_frame(spark, rows[::-1]).repartition(7)).collect()))
    assert m.report(_frame(spark, []), 8).count() == 0 and m.mix(_frame(spark, [])).count() == 0
    assert [x.taken for x in m.report(_frame(spark, [(1, None, None), (2, " ", "a")])).collect()] == [0, 0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query(spark):
    from provena.llm.queries import op11_source_mixing

    docs = {x.doc_id: x for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_source_mixing(spark, SF).collect()
    sizes, taken, n = Counter(), Counter(), {}
    for i, x in docs.items():
        n[i] = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", x.text or "") if w])
        sizes[x.source] += n[i]
    want = _targets({s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, (s or "").encode()))})
    assert sorted(x.doc_id for x in got) == sorted(docs)
    for x in got:
        s = docs[x.doc_id].source
        assert (x["size"], x.source_size) == (n[x.doc_id], sizes[s]) and x.target == pytest.approx(float(want[s])) and x.taken <= 3 * x["size"]
        taken[s] += x.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
