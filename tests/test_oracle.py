"""Every query with SQL text against DuckDB on the smallest data."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
import check  # noqa: E402

from recurra.plans import REGISTRY  # noqa: E402
from recurra.plans.bindings import Tables  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_query(spark, con, name):
    q = REGISTRY[name]
    df = q.run(Tables(spark, SF))
    cur = con.execute(q.sql)
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(cols, cur.fetchall())
