"""Every named query against its SQL on the smallest tables."""

import os

import pytest

from provena.plans import suite

SF = "/root/testdata/sf0.001"


def _plain(v):
    import pandas as pd

    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if not isinstance(v, (bool, str)):
        try:
            return str(int(v)) if float(v).is_integer() else repr(float(v))
        except (TypeError, ValueError):
            pass
    return str(v)


def _rows(pdf):
    return sorted(tuple(map(_plain, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_query_equals_sql(spark, duck, name):
    got = suite.queries()[name](spark, SF).toPandas()
    want = duck.execute(suite.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["item_id", "doc_id"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_query_has_sql():
    assert set(suite.queries()) == set(suite.oracle_sql())
