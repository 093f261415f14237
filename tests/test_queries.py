"""Every registered core query against its oracle in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

import postlens.more_queries  # noqa: F401  adds to the registry
import postlens.state_queries  # noqa: F401
from postlens.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def rows(columns, records):
    def one(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return round(float(v), 6)
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(one(r[i]) for i in order)) for r in records)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    found = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert found
        return
    wanted = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert found == rows(wanted.columns, wanted.fetchall())
