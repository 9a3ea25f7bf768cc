from __future__ import annotations

import duckdb
import pytest
from tabulon.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(q.queries()))
def test_query_equals_sql(spark, con, name):
    frame = q.queries()[name](spark, SF)
    rows = frame.collect()
    if name not in q.oracle_sql():
        return
    want = con.execute(q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted(want.fetchall(), key=str)
