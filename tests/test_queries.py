"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

from priorweave.plans import registry
from priorweave.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _key(row):
    return tuple((x is None, "" if x is None else x) for x in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    relation = con.sql(registry.ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=_key)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
