"""Every query against its SQL twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SLOW = {"rf_cv", "et_cv", "mlp_cv", "final_models", "linear_boost_cv", "polynomial_cv", "grid_search_rf", "searched_models"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = order([tuple(r[c] for c in columns) for r in df.collect()])
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = order([tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()])
    assert len(got) == len(want) and got
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9))
            assert same, (a, b)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_query_without_twin_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
