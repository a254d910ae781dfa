"""Every query of the catalogue against its SQL in DuckDB, on the bundled tables."""

import os

import pytest

import __spark_entry__ as entry
from fathom.plans import catalog

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="there are no bundled tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def norm(rows):
    return sorted(repr(tuple(float(v) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect()]
    if name not in catalog.SQL:
        assert got
        return
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == cols
    assert norm(got) == norm(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_returns_need_one_shuffle_by_symbol(spark):
    from fathom.operators import factors

    plan = factors.raw_factors(catalog.panel(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(symbol") <= 2 and "CartesianProduct" not in plan  # quotes, and quotes for the market
