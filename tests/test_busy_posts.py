"""As-of queries read each event once, however many queries and events a post has."""

import re
from datetime import datetime, timedelta

import duckdb

from priorweave.plans import registry


def test_busy_posts(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i * 7 % 500 // 2), i % 4 * 5, ("click", "purchase", "view")[i * i % 3], 1.0, "{}") for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("asof_per_query_all", "asof_best_answer_all"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # no join compares the time of an event with that of a query
        assert not [x for x in re.findall(r"Join .*", plan) if "answer" in x], plan
        rel = con.sql(registry.ORACLES[name])
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
