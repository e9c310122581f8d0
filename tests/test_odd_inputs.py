"""Inputs on which queries once differed from their SQL."""

from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from priorweave.functions import text as X
from priorweave.plans import registry
from priorweave.streaming import flows as E


def same(spark, sf, name, **tables):
    """The rows of a query and of its SQL, sorted."""
    con = duckdb.connect()
    for t, files in tables.items():
        con.execute(f"create view {t} as select * from read_parquet('{files}')")
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rel = con.sql(registry.ORACLES[name])
    at = [rel.columns.index(c) for c in columns]
    key = lambda row: [(x is None, str(x)) for x in row]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key), sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)


def test_references_without_their_end(spark, tmp_path):
    pages = [(1, "<p>R&amp;D &ampx &lt;b&gt; &copy &amp;lt; &nope; &#39;q&#39;</p>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got, want = same(spark, str(tmp_path), "html_clean", pages=f"{tmp_path}/pages.parquet/*.parquet")
    assert got == want
    t = spark.createDataFrame([("&amp &ampx; &eacute; &#x41; &AMP",)], "t string")
    assert t.select(X.unescape(F.col("t")).alias("a"), X.unescape(F.col("t"), True).alias("b")).first() == ("& &x; \u00e9 A &", "&amp &ampx; \u00e9 A &AMP")


def test_memory_of_events_in_any_order(spark, tmp_path):
    """Six files whose times interleave and run backwards, read in pieces of three rows."""
    kinds = ["click", "click", "purchase", "view"]
    for f in range(6):
        rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i % 40), i % 3, kinds[i * 7 % 4 if i % 5 else 0], 1.0, "{}") for i in range(119 - f, -1, -6)]
        spark.createDataFrame(rows, E.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got, want = same(spark, str(tmp_path), "stream_memory", events=f"{tmp_path}/events.parquet/*.parquet")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == want
