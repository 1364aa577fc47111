import pytest

from sigloom.llm import queries as Q
from tests.conftest import SF
from tests.test_oracles import _cell, con  # noqa: F401


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):  # noqa: F811
    df = Q.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in Q.SQL:
        cur = con.execute(Q.SQL[name])
        cols = [d[0] for d in cur.description]
        order = sorted(cols)
        assert sorted(df.columns) == order
        assert sorted(tuple(_cell(r[c]) for c in order) for r in rows) == sorted(tuple(_cell(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    else:
        assert rows
