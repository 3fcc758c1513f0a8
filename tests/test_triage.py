"""Every query against its own SQL on the smallest tables."""

import os

import duckdb
import pytest

from lurescope.plans import brands, functions, rules, triage

QUERIES = triage.QUERIES | rules.QUERIES | functions.QUERIES | brands.QUERIES
ORACLE_SQL = triage.ORACLE_SQL | rules.ORACLE_SQL | functions.ORACLE_SQL | brands.ORACLE_SQL
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    found = QUERIES[name](spark, SF)
    expected = db.sql(ORACLE_SQL[name])
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    rows = sorted(repr(tuple(r[c] for c in names)) for r in found.collect())
    at = [expected.columns.index(c) for c in names]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in expected.fetchall())
