"""As-of queries: events are edits and votes of posts (users), purchases acceptances, clicks up-votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorweave.operators import timeline as T
from priorweave.session import table

from .registry import ORACLES, query

T0 = "2024-01-20"
E = """with e as (select user_id as post, case when event_id % 2 = 0 then 'title' else 'body' end as kind, ts, event_id as seq, event_type || '-' || event_id as text, event_type, event_id from events),
    made as (select post, min(ts) as created from e group by 1)
"""


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("post"), F.when(F.col("event_id") % 2 == 0, "title").otherwise("body").alias("kind"), "ts", F.col("event_id").alias("seq"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("text"), "event_type", "event_id", "value", "props")


_VER = E + f""", v as (select e.post, kind, arg_min(text, (ts, seq)) as text from e join made using (post) where created >= timestamp '{T0}' group by 1, 2
    union all select e.post, kind, arg_max(text, (ts, seq)) from e join made using (post) where created < timestamp '{T0}' and ts < timestamp '{T0}' group by 1, 2)"""


def _versions(spark, sf):
    e = _events(spark, sf)
    return T.asof_version(e, e.groupBy("post").agg(F.min("ts").alias("created")), T0)


@query("asof_version", _VER + " select post, kind, text from v")
def asof_version(spark, sf):
    return _versions(spark, sf).select("post", "kind", "text")


@query("fallback_version", _VER + """, cur as (select c_custkey as post, c_name as title, c_mktsegment as body from customer)
    select cur.post, coalesce((select text from v where v.post = cur.post and kind = 'title'), title) as title, coalesce((select text from v where v.post = cur.post and kind = 'body'), body) as body from cur""")
def fallback_version(spark, sf):
    cur = table(spark, sf, "customer").select(F.col("c_custkey").alias("post"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body"))
    return T.with_fallback(_versions(spark, sf), cur, ["title", "body"])


_Q = E + """, q as (select event_id as q, ts as asked, post // 10 as d from e where event_id % 50 = 0),
    a as (select distinct post as answer, post // 10 as d, created from e join made using (post))"""


def _asked(spark, sf, every=False):
    e = _events(spark, sf)
    q = (e if every else e.filter(F.col("event_id") % 50 == 0)).select(F.col("event_id").alias("q"), F.col("ts").alias("asked"), F.floor(F.col("post") / 10).alias("d"))
    made = e.groupBy("post").agg(F.min("ts").alias("created"))
    return e, q, made.select(F.col("post").alias("answer"), F.floor(F.col("post") / 10).alias("d"), "created")


@query("asof_per_query", _Q + ", p as (select q.q, a.answer, q.asked from q join a using (d)) select p.q, p.answer, arg_max(e.text, (e.ts, e.text)) as text from p join e on e.post = p.answer and e.ts < p.asked group by 1, 2")
def asof_per_query(spark, sf):
    return _per_query(*_asked(spark, sf))


def _per_query(e, q, a):
    return T.asof_per_query(q.join(a, "d").select("q", "answer", "asked"), e.select(F.col("post").alias("answer"), "ts", "text"))


@query("asof_best_answer", _Q + """, p as (select q.q, q.d, a.answer, a.created, q.asked from q join a on a.d = q.d and a.created < q.asked),
    c as (select p.q, p.d, p.answer, p.created, max(case when e.event_type = 'purchase' then e.ts::date end) as accepted, count(case when e.event_type = 'click' then 1 end) as ups
      from p left join e on e.post = p.answer and e.ts::date < p.asked::date group by 1, 2, 3, 4)
    select q, d, answer, case when accepted is not null then 'accepted' else 'votes' end as rule from c qualify row_number() over (partition by q, d order by accepted desc nulls last, ups desc, created, answer) = 1""")
def asof_best_answer(spark, sf):
    return _best_answer(*_asked(spark, sf))


def _best_answer(e, q, a):
    kind = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "click", "up")
    votes = e.select(F.col("post").alias("answer"), kind.alias("kind"), F.to_date("ts").alias("day"))
    return T.best_answer(q, a, votes).select("q", "d", "answer", "rule")


_every = lambda name: ORACLES[name].replace(" where event_id % 50 = 0", "")


@query("asof_per_query_all", _every("asof_per_query"))
def asof_per_query_all(spark, sf):
    return _per_query(*_asked(spark, sf, every=True))


@query("asof_best_answer_all", _every("asof_best_answer"))
def asof_best_answer_all(spark, sf):
    return _best_answer(*_asked(spark, sf, every=True))


@query("latest_event", E + "select post, kind, arg_max(text, (ts, seq)) as text from e group by 1, 2")
def latest_event(spark, sf):
    return T.asof_latest(_events(spark, sf), ["post", "kind"], "text", ["ts", "seq"])


@query("daily_votes", E + "select post, ts::date as day, count(*) filter (where event_type = 'click') as ups, count(*) filter (where event_type = 'purchase') as accepted from e group by 1, 2")
def daily_votes(spark, sf):
    return _events(spark, sf).groupBy("post", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("ups"), F.count_if(F.col("event_type") == "purchase").alias("accepted"))


@query("temporal_cut", f"with p as (select row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, o_orderdate from orders) select coalesce(min(pos) filter (where o_orderdate >= timestamp '2000-01-01'), max(pos) + 1) as e0 from p")
def temporal_cut(spark, sf):
    return T.first_at(T.positions(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]), "o_orderdate", "2000-01-01")


@query("time_order", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos from orders")
def time_order(spark, sf):
    return T.positions(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "pos")


@query("window_counts", "with p as (select row_number() over (order by o_orderdate, o_orderkey) - 1 as pos from orders), n as (select count(*) as n from p) select case when pos >= floor(0.8 * n) then 'evaluation' when pos >= floor(0.7 * n) then 'calibration' else 'memory' end as part, count(*) as n from p, n group by 1")
def window_counts(spark, sf):
    p = T.with_total(T.positions(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]))
    part = F.when(F.col("pos") >= T.fraction(0.8), "evaluation").when(F.col("pos") >= T.fraction(0.7), "calibration").otherwise("memory")
    return p.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("dated_links", """with o as (select o_orderkey as id, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos from orders), l as (select l_orderkey as src, l_partkey as dst, l_shipdate as created from lineitem),
    k as (select least(a.pos, b.pos) as a, greatest(a.pos, b.pos) as b, min(created) as created from l join o a on a.id = l.src join o b on b.id = l.dst where a.pos <> b.pos group by 1, 2),
    m as (select a, b from k where created < timestamp '1998-01-01' and b < (select floor(0.8 * count(*)) from o)) select count(*) as links, count(distinct a) as earlier, max(b) as latest from m""")
def dated_links(spark, sf):
    o = T.positions(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), ["o_orderdate", "id"])
    links = T.valid_links(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_shipdate").alias("created")), o)
    e0 = o.agg(F.floor(0.8 * F.count("*")).alias("e0"))
    return T.memory_links(links, e0, "1998-01-01").agg(F.count("*").alias("links"), F.countDistinct("a").alias("earlier"), F.max("b").alias("latest"))


@query("period_split", "select year(o_orderdate) <= 1998 as early, count(*) as n, round(avg(o_totalprice), 4) as mean from orders group by 1")
def period_split(spark, sf):
    return table(spark, sf, "orders").groupBy((F.year("o_orderdate") <= 1998).alias("early")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
