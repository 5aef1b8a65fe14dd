"""Embedding whitening against the plain eigenvalue routine and exact integers."""

import math
import os

import numpy as np
import pytest

from provena.llm import whitening as w

SF = "/root/testdata/sf0.001"


def _check(a, m=4):
    e, v = w.leading(a, m)
    scale = max(np.linalg.norm(a), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1][:m]).max() <= 1e-13 * scale
    assert np.linalg.norm(a @ v - v * e) <= 1e-13 * scale and np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13


def test_leading_equals_plain_routine():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 150):
        x = r.normal(size=(3 * n, n)) * r.uniform(0.1, 3, n)
        _check(x.T @ x / n)
    q, _ = np.linalg.qr(r.normal(size=(40, 40)))
    for values in ([5] * 5 + [1] * 35, list(10.0 ** -np.arange(40)), [2, 2 - 1e-9, 1, -1] + [0] * 36, [1] * 40, [0] * 40, [3, 3, 1] + [0] * 37):
        _check(q @ np.diag(np.array(values, float)) @ q.T)
    _check(np.diag([1.0, 1, 0, 0]))


def test_polar_factor():
    r = np.random.default_rng(2)
    a = r.normal(size=(30, 30))
    a = a + a.T
    u = w.polar(a)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-13 and np.linalg.eigvalsh(u @ a).min() > 0


def _by_hand(rows):
    """What the contract asks, from (id, vector) rows of one length."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in good]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array(fit, float) - np.array(sums) / n
    cov = y.T @ y / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    return {i: (n, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), (np.array(v) - np.array(sums) / n) @ vec[:, :4] / np.sqrt(np.maximum(e[:4], 1e-300)), e[:4] / e.sum()) for i, v in x}, e


def _compare(got, want, e):
    m = int((e[:4] > 1e-12 * e[0]).sum())
    by = {}
    for x in got:
        by.setdefault(x[0], {})[x.component] = x
    assert set(by) == set(want)
    signs = {}
    for i, (n, far, white, share) in want.items():
        assert sorted(by[i]) == list(range(1, m + 1))
        for k in range(m):
            x = by[i][k + 1]
            assert (x.n, x.deviation) == (n, far) and x.explained == pytest.approx(share[k], rel=1e-9) and x.identity_error < 1e-9
            if abs(white[k]) > 1e-3:
                signs.setdefault(k, set()).add(round(x.whitened / white[k], 6))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values())


def test_rows_by_hand(spark):
    r = np.random.default_rng(7)
    rows = [(k, [float(c) for c in r.normal(size=6) * [3, 2, 1.5, 1, 0.7, 0.5]]) for k in range(300)]
    rows += [(1000 + k, rows[5][1]) for k in range(200)]  # one vector is everywhere
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [math.nan] * 6), (2004, [math.inf] + [0.0] * 5), (2006, [-0.0] * 6)]
    frame = spark.createDataFrame([(*x, 1, "c") for x in [*rows, (2005, [1.0, 2.0])]], "vec_id long, embedding array<float>, n int, component string").repartition(5)
    want, e = _by_hand(rows)
    _compare(w.whiten(frame).collect(), want, e)


def test_poor_and_empty_tables(spark):
    kind = "vec_id long, embedding array<double>"
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3):
        got = w.whiten(spark.createDataFrame(rows, kind))
        assert got.columns == columns and got.count() == 0
    line = w.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], kind)).collect()
    assert {x.component for x in line} == {1} and len(line) == 9 and line[0].explained == pytest.approx(1)
    # Sums and deviations past the range of doubles are exact; what is no long is null.
    big = w.whiten(spark.createDataFrame([(k, [2.0**40 + k, float(k)]) for k in range(4)] + [(9, [1e300, 0.0])], kind)).collect()
    assert {x.vec_id for x in big} == {0, 1, 2, 3, 9} and all(x.deviation is None for x in big)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_by_hand(spark):
    from provena.llm.queries import op13_embedding_whitening

    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, e = _by_hand(rows)
    _compare(op13_embedding_whitening(spark, SF).collect(), want, e)
