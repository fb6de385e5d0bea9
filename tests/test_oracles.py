"""Every registered query of the library, and the cases, against their SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from webassay.plans import catalog

import cases

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def text(v):
    return "" if not isinstance(v, (list, dict)) and pd.isna(v) else f"{float(v):.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted([*catalog.QUERIES, *cases.QUERIES]))
def test_query(spark, duck, name):
    oracles = catalog.ORACLES | cases.ORACLES
    got = (catalog.QUERIES | cases.QUERIES)[name](spark, SF).toPandas()
    if name not in oracles:
        assert len(got.columns)
        return
    want = duck.execute(oracles[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(tuple(map(text, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_imports_and_lists():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
