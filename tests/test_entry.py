"""Queries against their SQL oracles on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def same(spark, db, query, sql):
    df = query(spark, DATA)
    want = db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect())
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, db, name):
    same(spark, db, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ddl_query(spark):
    assert QUERIES["q_ddl_text"](spark, DATA).count() == 21
