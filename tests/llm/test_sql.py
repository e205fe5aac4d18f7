"""The queries with SQL give the same rows as DuckDB over the smallest tables; all others run."""

import glob
import os

import pytest

from stratacode.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect()) if name in queries.ORACLE_SQL else df.count()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        res = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in res.description]
        assert sorted(names) == columns and got == sorted(tuple(row[names.index(c)] for c in columns) for row in res.fetchall())


def test_names_agree():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
