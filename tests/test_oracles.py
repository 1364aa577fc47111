"""Every core query with SQL against DuckDB at the smallest scale; every other one runs and has rows."""

import math
import os

import duckdb
import pytest

from tests.conftest import SF

MODULES = ("sigloom.plans.reference_queries", "sigloom.plans.data_problems")


def _all():
    import importlib

    q, s = {}, {}
    for m in MODULES:
        mod = importlib.import_module(m)
        q.update(mod.QUERIES)
        s.update(mod.SQL)
    return q, s


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.4f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(_all()[1]))
def test_sql(spark, con, name):
    q, s = _all()
    df = q[name](spark, SF)
    cur = con.execute(s[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    theirs = sorted(tuple(_cell(row[cols.index(c)]) for c in order) for row in cur.fetchall())
    mine = sorted(tuple(_cell(row[c]) for c in order) for row in df.collect())
    assert len(mine) == len(theirs)
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b and not all(x == y or _near(x, y) for x, y in zip(a, b))]
    assert not bad, bad[:3]


def _near(x, y):
    try:
        return abs(float(x) - float(y)) <= 2e-4
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(set(_all()[0]) - set(_all()[1])))
def test_runs(spark, name):
    assert _all()[0][name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
