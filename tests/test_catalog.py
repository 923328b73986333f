import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from markloom.plans.catalog import ORACLES, QUERIES  # noqa: E402


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    r = con.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(repr([v[names.index(c)] for c in cols]) for v in r.fetchall())
