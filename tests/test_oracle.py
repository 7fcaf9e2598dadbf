"""Every query with SQL gives DuckDB's rows; every other one runs."""

import pytest

from packmill.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    if name not in SQL:
        assert rows and all(any(v is not None for v in r) for r in rows)
        return
    rel = duck.sql(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    key = lambda r: tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in r)
    assert sorted(map(key, rows)) == sorted(key([r[i] for i in at]) for r in rel.fetchall())
