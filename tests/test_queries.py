"""Every registered query with an SQL twin against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from loomtext.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for table in TABLES:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return c


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 4) if isinstance(value, float) else str(value)


def listed(df):
    names = sorted(df.columns)
    return names, sorted((tuple(str(plain(v)) for v in row) for row in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.SQL:
        want = con.execute(registry.SQL[name]).df()
        numbers = [c for c in got.columns if got[c].dtype.kind in "iuf"]
        assert sorted(got.columns) == sorted(want.columns)
        for c in numbers:
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
        assert listed(got) == listed(want)


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
