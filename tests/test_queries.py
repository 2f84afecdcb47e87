"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from ledgerloom.catalog import FLAGSHIP, QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    own = duckdb.connect()
    for t in TABLES:
        own.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return own


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    if name not in SQL:
        assert got
        return
    found = db.sql(SQL[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert FLAGSHIP in QUERIES and __spark_entry__.entry(spark).count() > 0
    assert SQL.keys() <= QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
