"""Dialogue queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorweave.functions import text as X
from priorweave.functions.vectors import draw
from priorweave.operators import dialogue as D
from priorweave.operators import timeline as T
from priorweave.session import table

from .registry import query

_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
C = f"""with c as (select *, case when contains(text, '?') and (contains(text, ':') or contains(text, '|')) then 'ASK|LIST' when contains(text, '?') then 'ASK'
      when contains(text, ':') or contains(text, '|') then 'LIST' else 'SAY' end as acts, {_W} as w from conversations),
    x as (select *, coalesce(last_value(case when role = 'assistant' then acts end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 'START') as context from c),
    u as (select *, string_split({_NORM}, ' ')[1] || '##' || context as key, case when len(w) < 20 then 'short' else 'long' end as label,
      ('0x' || substr(md5('fold-' || conv_id), 1, 8))::bigint % 2 as fold from x where role = 'user')
"""


def _users(spark, sf):
    u = D.coarse_key(D.with_context(table(spark, sf, "conversations")))
    return u.withColumns({"w": X.words(F.col("text")), "label": F.when(F.size(X.words(F.col("text"))) < 20, "short").otherwise("long"), "fold": draw("fold", F.col("conv_id").cast("string")) % 2})


@query("prev_context_key", C + "select conv_id, turn, context, key from u")
def prev_context_key(spark, sf):
    return _users(spark, sf).select("conv_id", "turn", F.array_join("context", "|").alias("context"), "key")


@query("seen_before", C + "select conv_id, turn, key, row_number() over (partition by key order by conv_id, turn) > 1 as seen from u")
def seen_before(spark, sf):
    return _users(spark, sf).select("conv_id", "turn", "key", (F.row_number().over(Window.partitionBy("key").orderBy("conv_id", "turn")) > 1).alias("seen"))


_MEM = C + """, cnt as (select key, label, count(*) as c from u where fold = 0 group by 1, 2),
    mem as (select key, sum(c) as n, max(c) as top, arg_min(label, (-c, label)) as predicted from cnt group by 1 having sum(c) >= 2 and max(c) >= 0.8 * sum(c)),
    ans as (select u.conv_id, u.turn, u.key, u.label, u.role, u.context, mem.predicted, mem.n::bigint as n, round(mem.top / mem.n, 9) as agreement from u left join mem using (key) where fold = 1)
"""


def _answered(spark, sf):
    u = _users(spark, sf)
    return D.exact_memory(u.filter("fold = 0"), u.filter("fold = 1"))


@query("exact_memory_vote", _MEM + "select conv_id, turn, key, predicted, n, agreement from ans")
def exact_memory_vote(spark, sf):
    return _answered(spark, sf).select("conv_id", "turn", "key", "predicted", "n", "agreement")


@query("key_coverage_grouping_sets", _MEM + """select coalesce(context, 'all') as kind, count(*) as turns, count(predicted) as covered, round(count(predicted) / count(*), 9) as coverage,
    round(avg(case when predicted = label then 1.0 else 0 end) filter (where predicted is not null), 9) as precision from ans group by grouping sets ((context), ())""")
def key_coverage_grouping_sets(spark, sf):
    rows = _answered(spark, sf).withColumn("context", F.array_join("context", "|"))
    right = F.avg(F.when(F.col("predicted").isNotNull(), (F.col("predicted") == F.col("label")).cast("double")))
    return rows.rollup("context").agg(F.count("*").alias("turns"), F.count("predicted").alias("covered"), F.round(F.count("predicted") / F.count("*"), 9).alias("coverage"), F.round(right, 9).alias("precision")).select(F.coalesce("context", F.lit("all")).alias("kind"), "turns", "covered", "coverage", "precision")


@query("label_distributions", C + "select key, label, count(*) as n, round(count(*) / sum(count(*)) over (partition by key), 9) as share from u group by 1, 2")
def label_distributions(spark, sf):
    g = _users(spark, sf).groupBy("key", "label").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("key")), 9))


@query("value_index", C + f""", v as (select role as concept, unnest({_W}) as value, conv_id * 1000 + turn as seq from conversations), k as (select value, concept, count(*) as n, min(seq) as seq from v group by 1, 2)
    select value, arg_max(concept, (n, -seq)) as concept, max(n) as n from k group by 1 having max(n) >= 2 and length(value) >= 3 and not regexp_full_match(value, '\\d{{1,3}}')""")
def value_index(spark, sf):
    c = table(spark, sf, "conversations")
    return D.value_index(c.select(F.col("role").alias("concept"), F.explode(X.words(F.col("text"))).alias("value"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")))


@query("state_delta", C + """, s as (select conv_id, turn, w[1] as a, w[-1] as b, label as z, lag(w[1]) over p as pa, lag(w[-1]) over p as pb, lag(label) over p as pz, row_number() over p as rn from u window p as (partition by conv_id order by turn))
    select conv_id, turn, 'first' as slot, a as value from s where rn = 1 or a is distinct from pa union all select conv_id, turn, 'last', b from s where rn = 1 or b is distinct from pb union all select conv_id, turn, 'size', z from s where rn = 1 or z is distinct from pz""")
def state_delta(spark, sf):
    u = _users(spark, sf).withColumn("now", D.slots(F.col("text")))
    before = F.coalesce(F.lag("now").over(D.by_turn()), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return u.withColumn("before", before).select("conv_id", "turn", F.explode(D.delta(F.col("now"), F.col("before"))).alias("slot", "value"))


@query("state_carried", C + "select conv_id, turn, last_value(case when label = 'long' then turn end ignore nulls) over (partition by conv_id order by turn) as last_long, lead(turn) over (partition by conv_id order by turn) as next_turn from u")
def state_carried(spark, sf):
    u = _users(spark, sf)
    return u.select("conv_id", "turn", F.last(F.when(F.col("label") == "long", F.col("turn")), ignorenulls=True).over(D.by_turn().rowsBetween(Window.unboundedPreceding, 0)).alias("last_long"), F.lead("turn").over(D.by_turn()).alias("next_turn"))


@query("repeat_rate", C + "select context, count(*) as n, count(distinct key) as kinds, round(1 - count(distinct key) / count(*), 9) as repeats from u group by 1")
def repeat_rate(spark, sf):
    u = _users(spark, sf).withColumn("context", F.array_join("context", "|"))
    return u.groupBy("context").agg(F.count("*").alias("n"), F.countDistinct("key").alias("kinds"), F.round(1 - F.countDistinct("key") / F.count("*"), 9).alias("repeats"))


@query("cross_membership", C + "select context, count(*) as n, round(avg(case when key in (select key from u where fold = 0) then 1.0 else 0 end), 9) as known from u where fold = 1 group by 1")
def cross_membership(spark, sf):
    u = _users(spark, sf).withColumn("context", F.array_join("context", "|"))
    known = u.filter("fold = 0").select("key", F.lit(1.0).alias("k")).distinct()
    return u.filter("fold = 1").join(known, "key", "left").groupBy("context").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("k", F.lit(0.0))), 9).alias("known"))


@query("fold_disjoint", C + "select fold, count(distinct conv_id) as dialogues, count(distinct conv_id) filter (where conv_id in (select conv_id from u v where v.fold <> u.fold)) as shared from u group by 1")
def fold_disjoint(spark, sf):
    u = _users(spark, sf).select("conv_id", "fold").distinct()
    shared = u.groupBy("conv_id").agg(F.count("*").alias("folds"))
    return u.join(shared, "conv_id").groupBy("fold").agg(F.count("*").alias("dialogues"), F.count_if(F.col("folds") > 1).alias("shared"))


@query("informative_turns", C + """, p as (select conv_id, turn, label, w, lag(label) over q as pl, lag(w[1]) over q as pw from u window q as (partition by conv_id order by turn))
    select conv_id, count(*) as turns, count(*) filter (where pl is null or pl <> label or pw is distinct from w[1]) as informative from p group by 1""")
def informative_turns(spark, sf):
    u = _users(spark, sf).withColumns({"pl": F.lag("label").over(D.by_turn()), "pw": F.lag(F.get("w", F.lit(0))).over(D.by_turn())})
    new = F.col("pl").isNull() | (F.col("pl") != F.col("label")) | ~F.col("pw").eqNullSafe(F.get("w", F.lit(0)))
    return u.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(new).alias("informative"))


@query("interleaved_stream", C + """, d as (select distinct conv_id, fold from u), i as (select conv_id, fold, row_number() over (partition by fold order by conv_id) - 1 as i, count(*) over (partition by fold) as n from d)
    select conv_id, fold, row_number() over (order by i / n, fold) - 1 as place from i""")
def interleaved_stream(spark, sf):
    d = _users(spark, sf).select("conv_id", "fold").distinct()
    n = d.groupBy("fold").agg(F.count("*").alias("n"))
    i = d.withColumn("i", F.row_number().over(Window.partitionBy("fold").orderBy("conv_id")) - 1).join(F.broadcast(n), "fold")
    return T.positions(i.withColumn("at", F.col("i") / F.col("n")), ["at", "fold"], "place").select("conv_id", "fold", "place")


@query("dialogue_statistics", C + "select role, count(*) as turns, count(distinct conv_id) as dialogues, sum(len(w))::bigint as words, round(avg(len(w)), 6) as mean_words, round(quantile_cont(len(w), 0.95), 6) as p95 from c group by 1")
def dialogue_statistics(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n", F.size(X.words(F.col("text"))))
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("dialogues"), F.sum("n").alias("words"), F.round(F.avg("n"), 6).alias("mean_words"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"))


@query("copy_rule", C + """, o as (select *, lag(w) over (partition by conv_id order by turn) as offered, lag(role) over (partition by conv_id order by turn) as by_role from c)
    select left(w[-1], 1) as concept, round(avg(case when list_contains(offered, w[-1]) then 1.0 else 0 end), 9) as share from o where role = 'user' and by_role = 'assistant' and len(w) > 0 group by 1
    having avg(case when list_contains(offered, w[-1]) then 1.0 else 0 end) > 0.5""")
def copy_rule(spark, sf):
    """Concepts (first letters of a user turn's last word) whose values mostly repeat what the turn before offered."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("w", X.words(F.col("text")))
    c = c.withColumns({"offered": F.lag("w").over(order), "by_role": F.lag("role").over(order)})
    u = c.filter("role = 'user' and by_role = 'assistant' and size(w) > 0").withColumn("value", F.element_at("w", -1))
    s = u.groupBy(F.left("value", F.lit(1)).alias("concept")).agg(F.avg(F.array_contains("offered", F.col("value")).cast("double")).alias("s"))
    return s.filter("s > 0.5").select("concept", F.round("s", 9).alias("share"))


@query("call_breakdown", _MEM + """select case when predicted is null then 'omitted' when predicted = label then 'right' else 'wrong' end as outcome, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from ans group by 1""")
def call_breakdown(spark, sf):
    a = _answered(spark, sf)
    out = F.when(F.col("predicted").isNull(), "omitted").when(F.col("predicted") == F.col("label"), "right").otherwise("wrong")
    g = a.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t")))).select("outcome", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


@query("value_matches")
def value_matches(spark, sf):
    """Values of the index found in user turns, longest first; tested against a loop."""
    index = value_index(spark, sf).filter("concept = 'assistant'")
    u = table(spark, sf, "conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), X.words(F.col("text")).alias("toks"))
    return D.longest_matches(u, index).select("id.conv_id", "id.turn", "start", "end", "value", "concept")
