"""Streams over events, against the batch result in SQL. Tumbling, sliding and session windows go beyond the reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorweave.streaming import flows as S

from .registry import query


@query("event_tumbling", "select time_bucket(interval '6 hours', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_tumbling(spark, sf):
    g = S.events(spark, sf).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return S.land_latest(g, "tumbling").select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sliding", "select time_bucket(interval '6 hours', ts) - o.k * interval '6 hours' as start, count(*) as n from events, range(0, 4) o(k) group by 1")
def event_sliding(spark, sf):
    g = S.events(spark, sf).groupBy(F.window("ts", "24 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return S.land_latest(g, "sliding").select(F.col("w.start").alias("start"), "n")


@query("event_session", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '2 hours' then 0 else 1 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, session""")
def event_session(spark, sf):
    g = S.events(spark, sf).groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return S.land_latest(g, "session").select("user_id", F.col("w.start").alias("start"), "n")


@query("event_watermarked", "select time_bucket(interval '1 day', ts) as start, count(*) as n from events group by 1 having time_bucket(interval '1 day', ts) + interval '1 day' <= (select max(ts) from events)")
def event_watermarked(spark, sf):
    """Closed days only: append mode gives a window when the watermark has passed it."""
    e = S.events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.withWatermark("ts", "0 seconds").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return S.land(g, "watermarked").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_versions", "select user_id, arg_max(event_id, (ts, event_id)) as version from events where ts < timestamp '2024-01-20' group by 1")
def stream_versions(spark, sf):
    return S.land_latest(S.versions_in_force(S.events(spark, sf), "2024-01-20"), "versions")


@query("stream_daily_votes", "select user_id, date_trunc('day', ts)::timestamp as day, count(*) filter (where event_type = 'click') as ups, count(*) filter (where event_type = 'purchase') as accepted from events group by 1, 2")
def stream_daily_votes(spark, sf):
    return S.land_latest(S.daily_counts(S.events(spark, sf)), "votes").select("user_id", F.col("w.start").alias("day"), "ups", "accepted")


@query("stream_memory", """with e as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events),
    c as (select a.event_id, a.user_id, a.n, b.event_type, count(*) as c from e a join e b on b.user_id = a.user_id and b.n < a.n group by 1, 2, 3, 4),
    m as (select event_id, arg_min(event_type, (-c, event_type)) as best, max(c) as top from c group by 1)
    select e.event_id, e.user_id, case when e.n >= 2 and m.top >= 0.8 * e.n then m.best end as predicted, e.n from e left join m using (event_id)""")
def stream_memory(spark, sf):
    return S.land(S.progressive_memory(S.events(spark, sf, None)), "memory")


@query("stream_degrees", "select node, count(*) as deg from (select user_id as node from events union all select event_id % 97 from events) group by 1")
def stream_degrees(spark, sf):
    return S.grow_degrees(S.events(spark, sf).select(F.col("user_id").alias("a"), (F.col("event_id") % 97).alias("b")), "degrees")


@query("stream_static_join", "select event_type, c_mktsegment as segment, count(*) as n from events join customer on c_custkey = user_id group by 1, 2")
def stream_static_join(spark, sf):
    """Events against a snapshot: only what the snapshot holds is visible to them."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return S.land_latest(S.events(spark, sf).join(c, "user_id").groupBy("event_type", "segment").agg(F.count("*").alias("n")), "static")
