"""Queries with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from priorweave.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    relation = con.sql(Q.ORACLES[name])
    assert sorted(map(tuple, df.select(*relation.columns).collect())) == sorted(relation.fetchall())


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 11))
