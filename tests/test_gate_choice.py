"""If no gate will do, none is chosen: no row, as in SQL."""

import duckdb

from priorweave.plans import registry
from priorweave.session import TABLES

SF = "/root/testdata/sf0.01"


def test_no_gate_is_no_row(spark):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name in ("gate_choice_all", "gate_table_all", "threshold_search_all"):
        df = registry.QUERIES[name](spark, SF)
        assert sorted(map(tuple, df.collect())) == sorted(c.sql(registry.ORACLES[name]).select(*df.columns).fetchall()), name
