"""Registered queries against their DuckDB oracles on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from basewright.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def normal(v):
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(normal(r[c]) for c in names) for r in df.collect()) == sorted(tuple(normal(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert {r["partition"] for r in entry.entry(spark).collect()} == {"exon", "periexonic", "intergenic"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
