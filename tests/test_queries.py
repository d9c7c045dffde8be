"""Every raster query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
import verify
from spectraloom.plans.queries import ORACLE_SQL, QUERIES

@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in verify.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(verify.key(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    assert got
    if name in ORACLE_SQL:
        relation = db.sql(ORACLE_SQL[name])
        assert sorted(relation.columns) == columns
        order = [relation.columns.index(c) for c in columns]
        assert got == sorted(verify.key(tuple(r[i] for i in order)) for r in relation.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
