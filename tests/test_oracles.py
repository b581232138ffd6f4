"""Every registered query against its oracle SQL on the smallest data set."""

import duckdb
import pytest
from sample_data import SF_DIR

from newsloom import catalog
from newsloom.fixtures import BASE_TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, duck, key):
    df = catalog.QUERIES[key](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    if key not in catalog.ORACLES:
        assert got
        return
    rel = duck.sql(catalog.ORACLES[key])
    assert sorted(rel.columns) == columns
    want = sorted(repr(r) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == want
