"""Episode memory over conversations: one fold of the dialogues is remembered, the other asks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorweave.functions import text as X
from priorweave.functions.vectors import draw
from priorweave.operators import dialogue as D
from priorweave.operators import memory as E
from priorweave.session import table

from .dialogues import C, _users
from .registry import query

_EPISODES = C + """, h as (select conv_id, turn, string_agg(role || '_' || replace(acts, '|', '_') || '_' || case when len(w) < 20 then 'short' else 'long' end, ' ') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as past from c),
    v as (select u.*, coalesce(past, '') as past, ('0x' || substr(md5('app-' || conv_id), 1, 8))::bigint % 4 as app, coalesce(lag(label) over (partition by conv_id order by turn), 'NONE') as intent from u join h using (conv_id, turn)),
    f as (select * exclude (key), past || '##' || context as key, conv_id * 1000 + turn as id, regexp_extract_all(lower(past || ' __pa_' || replace(context, '|', ' __pa_') || ' __pi_' || intent), '[\\p{L}\\p{N}_]+') as t from v),
    g as (select id, fold, unnest(t) as term from f union all select id, fold, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) from f),
    tf as (select id, fold, term, count(*) as tf from g group by 1, 2, 3), df as (select term, count(*) as df from tf where fold = 0 group by 1 having count(*) >= 2),
    wx as (select id, fold, term, (1 + ln(tf)) * (ln((1 + (select count(*) from f where fold = 0)) / (1 + df)) + 1) as x from tf join df using (term)),
    z as (select id, fold, term, x / sqrt(sum(x * x) over (partition by id)) as x from wx),
    s as (select a.id, b.id as seq, round(sum(a.x * b.x), 9) as sim from z a join z b using (term) where a.fold = 1 and b.fold = 0 group by 1, 2 having round(sum(a.x * b.x), 9) >= 0.8),
    o as (select s.id, s.seq, sim, r.label, row_number() over (partition by s.id order by sim desc, s.seq) as place from s join f q on q.id = s.id join f r on r.id = s.seq where r.app in (q.app, (q.app + 1) % 4)),
    near as (select id, count(*) as n, sum(case when label = 'long' then sim else 0 end) / sum(sim) as p from o where place <= 5 group by 1),
    k as (select q.id, r.label, count(*) as c from f q join f r on r.key = q.key and r.app in (q.app, (q.app + 1) % 4) where q.fold = 1 and r.fold = 0 group by 1, 2),
    same as (select id, sum(c) as n, sum(case when label = 'long' then c else 0 end) / sum(c) as p from k group by 1 having sum(c) >= 2 and max(c) >= 0.8 * sum(c))
    select f.conv_id, f.turn, case when same.n is not null then 'hash' when near.n is not null then 'retrieval' end as source, case when same.n is not null then 0.8 when near.n is not null then 0.5 end::double as weight,
      coalesce(same.n, near.n)::bigint as n, round(coalesce(same.p, near.p), 6) as p_long from f left join same using (id) left join near using (id) where f.fold = 1"""


@query("episode_memory", _EPISODES)
def episode_memory(spark, sf):
    """How long each user turn of a fold will be, from turns of the other fold after the same course of the dialogue or after the
    most similar ones. What stands for the utterance is role, acts and length of all turns before, since texts of the tables do not
    recur. Dialogues belong to one of four scopes and ask two."""
    size = F.when(F.size(X.words(F.col("text"))) < 20, "short").otherwise("long")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("_", "role", D.acts(F.col("text")), size).alias("mark"))
    past = turns.select("conv_id", "turn", F.array_join(F.collect_list("mark").over(D.by_turn().rowsBetween(Window.unboundedPreceding, -1)), " ").alias("past"))
    intent = F.coalesce(F.lag("label").over(D.by_turn()), F.lit("NONE"))
    u = _users(spark, sf).withColumns({"intent": intent, "app": draw("app", F.col("conv_id").cast("string")) % 4}).join(past, ["conv_id", "turn"])
    u = u.withColumns({"key": F.concat_ws("##", "past", F.array_join("context", "|")), "text": E.features(F.col("past"), F.col("context"), F.col("intent"))})
    records = u.filter("fold = 0").select(F.col("app").alias("scope"), "key", "label", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    asked = u.filter("fold = 1").select(F.struct("conv_id", "turn").alias("id"), F.array("app", (F.col("app") + 1) % 4).alias("scopes"), "key", "text")
    share = F.coalesce(F.element_at("dist", F.lit("long")), F.lit(0.0))
    got = E.consult(records, asked)
    return got.select("id.conv_id", "id.turn", "source", "weight", "n", F.when(F.col("source").isNotNull(), F.round(share, 6)).alias("p_long"))
