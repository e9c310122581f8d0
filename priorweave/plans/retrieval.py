"""Retrieval queries over the vector corpus: rankers, lists, hit rates and what explains them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorweave.functions.vectors import dot
from priorweave.operators import metrics as M
from priorweave.operators import ranking as R
from priorweave.operators import scoring
from priorweave.session import cut

from .fixtures import BETA, DOT, GRAPH, GRID, LISTS, Vectors, every, every_sql, interleave_sql, vectors
from .registry import ORACLES, query


@query(
    "m0_topk",
    f"""with v as (select row_number() over (order by vec_id) - 1 as pos, embedding::double[] as v from embeddings),
    s as (select q.pos as q, d.pos as d, round({DOT.format(a="q.v", b="d.v")}, 6) as score from v q join v d on d.pos < q.pos)
    select q, d, score, row_number() over (partition by q order by score desc, d) as rank from s qualify rank <= 5""",
)
def m0_topk(spark, sf):
    x = vectors(spark, sf)
    return R.top_k(R.score_table(x.corpus, x.corpus.select("pos"), 5).withColumnRenamed("own", "score"), 5)


def _method(name, sql):
    @query(f"{name}_topk", LISTS + f" select q, rank, d, score from {sql}")
    def run(spark, sf):
        return vectors(spark, sf).top(name)


_method("m1", "l1")


@query(
    "m2_beta_grid",
    GRAPH + """select q, beta, d, score, row_number() over (partition by q, beta order by score desc, d) as rank from (
      select q, d, b.beta, round(m1 + b.beta * logdeg, 6) as score from m1, (select unnest([0, 0.005, 0.01, 0.02, 0.04, 0.08])::double as beta) b) qualify rank <= 5""",
)
def m2_beta_grid(spark, sf):
    x = vectors(spark, sf)
    s = R.popularity_bonus(x.grid, GRID).withColumnRenamed("m2", "score")
    return R.top_k(s, 5, by=("q", "beta")).select("q", "beta", "rank", "d", "score")


@query("popularity_control", GRAPH + "select q, d, p0 as score, row_number() over (partition by q order by p0 desc, d) as rank from sc qualify rank <= 5")
def popularity_control(spark, sf):
    return vectors(spark, sf).top("p0")


@query("family_expand", LISTS + "select key, q, d from keys")
def family_expand(spark, sf):
    return vectors(spark, sf).keys.select("key", "q", "d")


HITS = (
    LISTS
    + """, asked as (select distinct k.key, k.q, l.method from keys k join lists l using (q)),
    firsts as (select l.method, k.key, l.q, min(l.rank) as first from lists l join keys k on k.q = l.q and k.d = l.d group by 1, 2, 3),
    hit as (select a.method, a.key, kk.k, a.q, case when f.first <= kk.k then 1 else 0 end as hit
            from asked a left join firsts f using (method, key, q), (select unnest([1, 5]) as k) kk)
"""
)


def _hits(spark, sf):
    x = vectors(spark, sf)
    return x, M.hits(x.lists, x.listed, asked=x.asked_keys)


@query("hit_rates", HITS + "select method, key, k, sum(hit) as hits, (select n - e0 from nn) as n, round(sum(hit) / (select n - e0 from nn), 9) as rate from hit group by 1, 2, 3")
def hit_rates(spark, sf):
    x, hit = _hits(spark, sf)
    return M.rates(hit, x.evaluated.agg(F.count("*").alias("n")))


@query(
    "relative_gain",
    HITS + """, t as (select method, key, k, sum(hit) as x from hit group by 1, 2, 3)
    select a.method, a.key, a.k, a.x, b.x as y, round(a.x / nullif(b.x, 0) - 1, 9) as gain from t a join t b on b.method = 'm0' and b.key = a.key and b.k = a.k where a.method <> 'm0'""",
)
def relative_gain(spark, sf):
    return M.relative_gain(_hits(spark, sf)[1], "m0").select("method", "key", "k", "x", "y", "gain")


@query("interleave_h", LISTS + "select q, rank, d from lh")
def interleave_h(spark, sf):
    x = vectors(spark, sf)
    return R.interleave(x.top("m0"), x.top("m2"))


@query("interleave_h1", LISTS + "select q, rank, d from lh1")
def interleave_h1(spark, sf):
    x = vectors(spark, sf)
    return R.interleave(x.top("m0"), x.top("m1"))


def _gate(x: Vectors):
    """(q, signal): how much the network's first document beats plain search's first, in the network's own terms."""
    plain = x.top("m0").filter("rank = 1").select("q", F.col("score").alias("s0"))
    net = x.top("m2").filter("rank = 1").select("q", "d").join(x.scores.select("q", "d", "m1"), ["q", "d"]).select("q", "m1")
    return plain.join(net, "q").select("q", F.round(F.col("m1") - F.col("s0"), 6).alias("signal"))


GATE_SQL = """, gate as (select l0.q, round(m1.m1 - l0.score, 6) as signal from l0 join l2 on l2.q = l0.q and l2.rank = 1 join m1 on m1.q = l2.q and m1.d = l2.d where l0.rank = 1)"""


@query(
    "gated_lists",
    LISTS + GATE_SQL + f""", o as (select q from gate where signal >= 0.02), o0 as (select * from l0 where q in (select q from o)), o2 as (select * from l2 where q in (select q from o)),
    c0 as (select * from l0 where q not in (select q from o)), c2 as (select * from l2 where q not in (select q from o))
    select q, rank, d from {interleave_sql("o2", "o0")} union all select q, rank, d from {interleave_sql("c0", "c2")}""",
)
def gated_lists(spark, sf):
    x = vectors(spark, sf)
    return R.gated(x.top("m0"), x.top("m2"), _gate(x).select("q", (F.col("signal") >= 0.02).alias("open")))


SIGNAL_SQL = """, fresh as (select h.q, h.d from lh1 h left join l0 on l0.q = h.q and l0.d = h.d where l0.d is null),
    best as (select f.q, m1.d, m1.m1, case when m1.m1 = m1.own then 'own' when m1.m1 = m1.nbr then 'neighbour' else 'centroid' end as source,
             row_number() over (partition by f.q order by m1.m1 desc, m1.d) as rn from fresh f join m1 on m1.q = f.q and m1.d = f.d),
    sig as (select best.q, best.d, best.source, round(best.m1 - l0.score, 6) as signal from best join l0 on l0.q = best.q and l0.rank = 1 where rn = 1)"""


def _signal(x: Vectors):
    fresh = R.interleave(x.top("m0"), x.top("m1")).join(x.top("m0").select("q", "d"), ["q", "d"], "left_anti").select("q", "d")
    each = fresh.join(x.scores, ["q", "d"]).withColumn("source", F.when(F.col("m1") == F.col("own"), "own").when(F.col("m1") == F.col("nbr"), "neighbour").otherwise("centroid"))
    best = each.groupBy("q").agg(F.max_by(F.struct("d", "source", "m1"), F.struct("m1", -F.col("d"))).alias("b")).select("q", "b.*")
    return best.join(x.top("m0").filter("rank = 1").select("q", F.col("score").alias("s0")), "q").select("q", "d", "source", F.round(F.col("m1") - F.col("s0"), 6).alias("signal"))


@query("gate_signal", LISTS + SIGNAL_SQL + " select q, d, source, signal from sig")
def gate_signal(spark, sf):
    return _signal(vectors(spark, sf))


TAUS = [-0.5, -0.1, -0.05, 0.0, 0.05, 0.1]
TABLE_SQL = (
    HITS
    + SIGNAL_SQL
    + """, ha as (select q, hit from hit where method = 'h1' and key = 'family' and k = 1), hb as (select q, hit from hit where method = 'm1' and key = 'family' and k = 1),
    sided as (select ha.q, ha.hit as a, hb.hit as b from ha join hb using (q)),
    gt as (select t.tau, count(*) filter (where signal >= t.tau - 1e-12) as opened, count(*) filter (where signal >= t.tau - 1e-12 and b > a) as gains,
      count(*) filter (where signal >= t.tau - 1e-12 and b < a) as losses, count(*) filter (where signal >= t.tau - 1e-12 and a = b) as neutral,
      count(*) filter (where signal >= t.tau - 1e-12 and source = 'centroid') as by_centroid, count(*) as n
      from sig join sided using (q), (select unnest([-0.5, -0.1, -0.05, 0.0, 0.05, 0.1])::double as tau) t group by t.tau)"""
)


def _gate_table(spark, sf):
    x, hit = _hits(spark, sf)
    fam = hit.filter("key = 'family' and k = 1")
    both = M.paired(fam, "h1", "m1").select("q", F.col("x").alias("a"), F.col("y").alias("b"))
    rows = _signal(x).join(both, "q").withColumn("tau", F.explode(F.array(*map(F.lit, TAUS))))
    op = F.col("signal") >= F.col("tau") - 1e-12
    return rows.groupBy("tau").agg(F.count_if(op).alias("opened"), F.count_if(op & (F.col("b") > F.col("a"))).alias("gains"), F.count_if(op & (F.col("b") < F.col("a"))).alias("losses"), F.count_if(op & (F.col("a") == F.col("b"))).alias("neutral"), F.count_if(op & (F.col("source") == "centroid")).alias("by_centroid"), F.count("*").alias("n"))


@query("gate_table", TABLE_SQL + " select tau, opened, gains, losses, neutral, by_centroid, n, round(opened / n, 9) as coverage from gt")
def gate_table(spark, sf):
    return _gate_table(spark, sf).withColumn("coverage", F.round(F.col("opened") / F.col("n"), 9))


@query("gate_choice", TABLE_SQL + " select tau, opened, gains, losses from gt where gains >= losses and opened >= 0.02 * n order by opened desc, gains / nullif(opened, 0) desc nulls last, tau limit 1")
def gate_choice(spark, sf):
    ok = _gate_table(spark, sf).filter((F.col("gains") >= F.col("losses")) & (F.col("opened") >= 0.02 * F.col("n")))
    best = F.max_by(F.struct("tau", "opened", "gains", "losses"), F.struct("opened", F.try_divide("gains", "opened"), -F.col("tau"))).alias("b")
    return ok.agg(best).select("b.*")


@query(
    "degree_umbrella",
    GRAPH + "select node, deg, round(ln(1 + deg), 9) as logdeg, row_number() over (order by deg desc, node) as rank from deg order by deg desc, node limit 50",
)
def degree_umbrella(spark, sf):
    deg = vectors(spark, sf).adjacency.groupBy("node").agg(F.count("*").alias("deg"))
    top = deg.orderBy(F.desc("deg"), "node").limit(50)  # a report of the fifty largest
    return top.select("node", "deg", F.round(F.log1p("deg"), 9).alias("logdeg"), F.row_number().over(Window.orderBy(F.desc("deg"), "node")).alias("rank"))


@query(
    "centroids",
    GRAPH + "select node, i::int as i, round(c / len, 6) as c from (select csum.node, i, csum.c, cvec.len from csum join cvec using (node))",
)
def centroids(spark, sf):
    n = vectors(spark, sf).nodes
    return n.select("node", F.posexplode("centroid").alias("i", "c")).select("node", (F.col("i") + 1).alias("i"), F.round("c", 6).alias("c"))


@query(
    "same_family_diversity",
    LISTS + """, near as (select a.method, a.q, a.d, b.d as e from lists a join lists b on a.method = b.method and a.q = b.q
       where a.d = b.d or exists (select 1 from adj where node = a.d and nbr = b.d) or exists (select 1 from adj x join adj y on x.nbr = y.nbr where x.node = a.d and y.node = b.d)),
    sized as (select method, q, d, count(*) as c from near group by 1, 2, 3)
    select method, q, max(c) as largest from sized group by 1, 2""",
)
def same_family_diversity(spark, sf):
    x = vectors(spark, sf)
    a, b = x.lists.select("method", "q", "d"), x.lists.select("method", "q", F.col("d").alias("e"))
    pairs = a.join(b, ["method", "q"])  # at most five rows a list
    # whether two documents are near does not depend on the list, so each pair is looked at once
    once = cut(pairs.filter("d < e").select("d", "e").distinct())
    near = R.related(once, x.adjacency)
    near = near.union(near.select("e", "d")).withColumn("s", F.lit(True))
    linked = pairs.join(near, ["d", "e"], "left")
    sizes = linked.filter((F.col("d") == F.col("e")) | F.col("s")).groupBy("method", "q", "d").agg(F.count("*").alias("c"))
    return sizes.groupBy("method", "q").agg(F.max("c").alias("largest"))


@query(
    "gain_mechanism",
    HITS + """, won as (select a.q from hit a join hit b using (key, k, q) where a.method = 'm2' and b.method = 'm0' and key = 'family' and k = 5 and a.hit = 1 and b.hit = 0),
    good as (select l.q, l.d, l.rank, row_number() over (partition by l.q order by l.rank) as rn from lists l join won using (q) join keys on keys.key = 'family' and keys.q = l.q and keys.d = l.d where l.method = 'm2'),
    top50 as (select node from deg order by deg desc, node limit 50),
    each as (select g.q, case when sc.m1 = sc.own then 'own' when sc.m1 = sc.nbr then 'bridge' else 'centroid' end as mechanism,
      (select count(*) from sc z where z.q = g.q and (z.m1 > sc.m1 or (z.m1 = sc.m1 and z.d < sc.d))) >= 5 as weight_decisive, g.d in (select node from top50) as umbrella
      from good g join sc on sc.q = g.q and sc.d = g.d where rn = 1)
    select mechanism, count(*) as gains, count(*) filter (where weight_decisive) as weight_decisive, count(*) filter (where umbrella) as umbrella from each group by 1""",
)
def gain_mechanism(spark, sf):
    x, hit = _hits(spark, sf)
    won = M.paired(hit.filter("key = 'family' and k = 5"), "m2", "m0").filter("x = 1 and y = 0").select("q")
    keys = x.listed.filter("key = 'family'").select("q", "d")
    good = x.lists.filter("method = 'm2'").join(won, "q").join(keys, ["q", "d"]).groupBy("q").agg(F.min_by("d", "rank").alias("d"))
    in_m1 = x.top("m1").select("q", "d", F.lit(True).alias("in_m1"))
    top50 = x.adjacency.groupBy("node").agg(F.count("*").alias("deg")).orderBy(F.desc("deg"), "node").limit(50).select(F.col("node").alias("d"), F.lit(True).alias("umbrella"))
    each = good.join(x.scores, ["q", "d"]).join(in_m1, ["q", "d"], "left").join(F.broadcast(top50), "d", "left")
    kind = F.when(F.col("m1") == F.col("own"), "own").when(F.col("m1") == F.col("nbr"), "bridge").otherwise("centroid")
    return each.groupBy(kind.alias("mechanism")).agg(F.count("*").alias("gains"), F.count_if(F.col("in_m1").isNull()).alias("weight_decisive"), F.count_if("umbrella").alias("umbrella"))


@query(
    "swap_cause",
    LISTS + """, firsts as (select a.q, a.d as d0, b.d as d2, c.d as d1 from l0 a join l2 b using (q) join l1 c using (q) where a.rank = 1 and b.rank = 1 and c.rank = 1),
    each as (select f.q, case when d1 = d2 then 'relations' when d1 = d0 then 'bonus' else 'both' end as cause, 0.02 * s2.logdeg as bonus, s0.own - s2.own as sacrificed
      from firsts f join sc s2 on s2.q = f.q and s2.d = f.d2 join sc s0 on s0.q = f.q and s0.d = f.d0 where d0 <> d2)
    select cause, count(*) as n, round(median(bonus), 6) as bonus, round(median(sacrificed), 6) as sacrificed from each group by 1""",
)
def swap_cause(spark, sf):
    x = vectors(spark, sf)
    one = lambda m: x.top(m).filter("rank = 1").select("q", F.col("d").alias(f"d{m[1]}"))
    f = one("m0").join(one("m1"), "q").join(one("m2"), "q").filter("d0 <> d2")
    s2 = x.scores.select("q", F.col("d").alias("d2"), F.col("own").alias("own2"), "logdeg")
    s0 = x.scores.select("q", F.col("d").alias("d0"), F.col("own").alias("own0"))
    cause = F.when(F.col("d1") == F.col("d2"), "relations").when(F.col("d1") == F.col("d0"), "bonus").otherwise("both")
    return f.join(s2, ["q", "d2"]).join(s0, ["q", "d0"]).groupBy(cause.alias("cause")).agg(F.count("*").alias("n"), F.round(F.median(BETA * F.col("logdeg")), 6).alias("bonus"), F.round(F.median(F.col("own0") - F.col("own2")), 6).alias("sacrificed"))


@query(
    "threshold_search",
    HITS + """, x as (select l.score, h.hit from l0 l join hit h on h.q = l.q and h.method = 'm0' and h.key = 'family' and h.k = 1 where l.rank = 1),
    scale as (select (select count(*) from ev) / (select count(*) from lab) as s),
    g as (select score, sum(hit) as good, sum(1 + (select s from scale) - 1) as al from x group by score),
    r as (select score, sum(good) over (order by score desc) / sum(al) over (order by score desc) as p from g)
    select round(min(score), 6) as tau, (select count(*) from x where score >= (select min(score) from r where p >= 0.01)) as opened from r where p >= 0.01""",
)
def threshold_search(spark, sf):
    x, hit = _hits(spark, sf)
    first = x.top("m0").filter("rank = 1").select("q", "score")
    rows = first.join(hit.filter("method = 'm0' and key = 'family' and k = 1"), "q").select("score", "hit", F.lit(False).alias("labelled"))
    scale = x.evaluated.count() / max(1, x.labelled.count())
    tau = M.threshold(rows, scale, 0.01)
    return rows.crossJoin(F.broadcast(tau)).groupBy().agg(F.round(F.first("tau"), 6).alias("tau"), F.count_if(F.col("score") >= F.col("tau")).alias("opened"))


@query(
    "network_curve_density",
    GRAPH + """, lv as (select unnest([0, 25, 50, 100]) as pct), el as (select lv.pct, a.node, a.nbr from adj a, lv where ('0x' || substr(md5('link-' || least(a.node, a.nbr) || '-' || greatest(a.node, a.nbr)), 1, 8))::bigint % 100 < lv.pct),
    near as (select el.pct, s.q, el.node as d, max(s.own) as nbr from s join el on el.nbr = s.d group by 1, 2, 3),
    x as (select lv.pct, s.q, s.d, greatest(s.own, coalesce(near.nbr, -9)) as score from s cross join lv left join near on near.pct = lv.pct and near.q = s.q and near.d = s.d),
    top as (select pct, q, d, row_number() over (partition by pct, q order by score desc, d) as rank from x qualify rank <= 5),
    hit as (select pct, count(distinct top.q) as hits from top join gold on gold.q = top.q and gold.d = top.d group by 1)
    select lv.pct, coalesce(hits, 0) as hits, round(coalesce(hits, 0) / (select n - e0 from nn), 9) as rate from lv left join hit using (pct)""",
)
def network_curve_density(spark, sf):
    from priorweave.functions.vectors import draw

    x = vectors(spark, sf)
    lo, hi = F.least("node", "nbr").cast("string"), F.greatest("node", "nbr").cast("string")
    levels = F.explode(F.array(*map(F.lit, [0, 25, 50, 100])))
    el = cut(x.adjacency.withColumn("u", draw("link", lo, hi) % 100))
    hit = None
    for pct in (0, 25, 50, 100):
        scores = R.best_links(x.corpus, x.asked, 5, [("m1", 0.0)], el.filter(F.col("u") < pct).select("node", "nbr"), None)
        top = R.top_k(scores.withColumnRenamed("m1", "score"), 5).join(x.gold, ["q", "d"])
        one = top.agg(F.countDistinct("q").alias("hits")).select(F.lit(pct).alias("pct"), "hits")
        hit = one if hit is None else hit.union(one)
    base = spark.range(1).select(levels.alias("pct")).join(hit, "pct", "left").select("pct", F.coalesce("hits", F.lit(0)).alias("hits"))
    return base.crossJoin(F.broadcast(x.evaluated.agg(F.count("*").alias("n")))).select("pct", "hits", F.round(F.col("hits") / F.col("n"), 9).alias("rate"))


@query(
    "network_curve_participants",
    GRAPH + """, app as (select pos, ('0x' || substr(md5('app-' || pos), 1, 8))::bigint % 10 as app from v0), lv as (select unnest([1, 3, 10]) as k),
    x as (select lv.k, s.q, s.d, s.own as score from s join app on app.pos = s.d join lv on app.app < lv.k),
    top as (select k, q, d, row_number() over (partition by k, q order by score desc, d) as rank from x qualify rank <= 5),
    hit as (select k, count(distinct top.q) as hits from top join gold on gold.q = top.q and gold.d = top.d group by 1),
    lvl as (select lv.k, coalesce(hits, 0) as hits from lv left join hit using (k))
    select k, hits, hits - coalesce(lag(hits) over (order by k), 0) as marginal from lvl""",
)
def network_curve_participants(spark, sf):
    from priorweave.functions.vectors import draw

    x = vectors(spark, sf)
    docs = x.corpus.withColumn("app", draw("app", F.col("pos").cast("string")) % 10)
    out = None
    for k in (1, 3, 10):
        own = R.score_table(docs.filter(F.col("app") < k), x.labelled, 5, query_vectors=x.corpus)
        hit = R.top_k(own.withColumnRenamed("own", "score"), 5).join(x.gold, ["q", "d"]).agg(F.countDistinct("q").alias("hits")).select(F.lit(k).alias("k"), "hits")
        out = hit if out is None else out.union(hit)
    return out.withColumn("marginal", F.col("hits") - F.coalesce(F.lag("hits").over(Window.orderBy("k")), F.lit(0)))


@query(
    "scoped_topk",
    GRAPH + """select q, d, score, row_number() over (partition by q order by score desc, d) as rank from (
      select s.q, s.d, s.own as score from s join v0 a on a.pos = s.q join v0 b on b.pos = s.d where a.label = b.label) qualify rank <= 5""",
)
def scoped_topk(spark, sf):
    x = vectors(spark, sf)
    docs = x.corpus.withColumnRenamed("label", "scope")
    return R.top_k(R.score_table(docs, x.labelled, 5).withColumnRenamed("own", "score"), 5)


@query(
    "ceiling",
    GRAPH + "select v0.label, count(*) as n, count(*) filter (where ev.q in (select q from gold)) as labelled, round(count(*) filter (where ev.q in (select q from gold)) / count(*), 9) as ceiling from ev join v0 on v0.pos = ev.q group by 1",
)
def ceiling(spark, sf):
    x = vectors(spark, sf)
    rows = x.evaluated.join(x.corpus.select("pos", "label"), "pos").join(x.labelled.withColumn("l", F.lit(1)), "pos", "left")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count("l").alias("labelled"), F.round(F.count("l") / F.count("*"), 9).alias("ceiling"))


@query(
    "gold_rank_position",
    GRAPH + """, g as (select s.q, max(s.own) as best from s join gold on gold.q = s.q and gold.d = s.d group by 1),
    r as (select g.q, count(*) filter (where s.own > g.best) + 1 as rank from g join s using (q) group by 1)
    select count(*) as n, median(rank) as median, count(*) filter (where rank <= 1) as top1, count(*) filter (where rank <= 5) as top5, count(*) filter (where rank <= 100) as top100 from r""",
)
def gold_rank_position(spark, sf):
    x = vectors(spark, sf)
    ends = x.labelled.withColumnRenamed("pos", "q").join(x.gold, "q").filter("d < q")
    for c in ("q", "d"):
        ends = ends.join(x.corpus.select(F.col("pos").alias(c), F.col("v").alias(f"v{c}")), c)
    bar = cut(ends.groupBy(F.col("q").alias("pos")).agg(F.max(F.round(dot("vq", "vd"), 6)).alias("bar")))
    r = scoring.above(x.corpus, bar).select((F.col("above") + 1).alias("rank"))
    return r.agg(F.count("*").alias("n"), F.median("rank").alias("median"), *(F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in (1, 5, 100)))


@query(
    "reproduction_check",
    LISTS + """ select 'first suggestion changed' as failed, (count(*) filter (where b.d <> a.d or c.d <> a.d))::int as n
      from lists a join lists b on b.q = a.q and b.method = 'h' and b.rank = 1 join lists c on c.q = a.q and c.method = 'h1' and c.rank = 1 where a.method = 'm0' and a.rank = 1""",
)
def reproduction_check(spark, sf):
    """Interleaving never changes the first suggestion: the number of queries where it did."""
    x = vectors(spark, sf)
    first = lambda m, n: x.lists.filter(f"method = '{m}' and rank = 1").select("q", F.col("d").alias(n))
    bad = first("m0", "a").join(first("h", "b"), "q").join(first("h1", "c"), "q").filter("a <> b or a <> c")
    return bad.agg(F.count("*").cast("int").alias("n")).select(F.lit("first suggestion changed").alias("failed"), "n")


@query(
    "grid_choice",
    GRAPH + """, b as (select unnest([0, 0.005, 0.01, 0.02, 0.04, 0.08])::double as beta), t as (select q, beta, d, row_number() over (partition by q, beta order by round(m1 + beta * logdeg, 6) desc, d) as rank from m1, b qualify rank <= 5),
    h as (select beta, count(distinct t.q) as hits from t join gold on gold.q = t.q and gold.d = t.d group by 1) select b.beta, coalesce(hits, 0) as hits from b left join h using (beta) order by hits desc nulls last, beta limit 1""",
)
def grid_choice(spark, sf):
    x = vectors(spark, sf)
    top = R.top_k(R.popularity_bonus(x.grid, GRID).withColumnRenamed("m2", "score"), 5, by=("q", "beta"))
    hit = top.join(x.gold, ["q", "d"], "left").groupBy("beta").agg(F.countDistinct(F.when(F.col("d").isNotNull(), F.col("q"))).alias("all"))
    good = top.join(x.gold, ["q", "d"], "left_semi").groupBy("beta").agg(F.countDistinct("q").alias("hits"))
    rows = hit.join(good, "beta", "left").select("beta", F.coalesce("hits", F.lit(0)).alias("hits"))
    return rows.agg(F.max_by(F.struct("beta", "hits"), F.struct("hits", -F.col("beta"))).alias("b")).select("b.*")


@query("m1_topk_all", every_sql(ORACLES["m1_topk"]))
def m1_topk_all(spark, sf):
    return every(spark, sf).top("m1")


@query("popularity_control_all", every_sql(ORACLES["popularity_control"]))
def popularity_control_all(spark, sf):
    return every(spark, sf).top("p0")


@query("gate_signal_all", every_sql(ORACLES["gate_signal"]))
def gate_signal_all(spark, sf):
    return _signal(every(spark, sf))


@query("scoped_topk_all", every_sql(ORACLES["scoped_topk"]))
def scoped_topk_all(spark, sf):
    x = every(spark, sf)
    docs = x.corpus.withColumnRenamed("label", "scope")
    return R.top_k(R.score_table(docs, x.asked, 5).withColumnRenamed("own", "score"), 5)


GATES_SQL = every_sql(HITS) + SIGNAL_SQL + f""", ha as (select q, hit from hit where method = 'm0' and key = 'family' and k = 5), hb as (select q, hit from hit where method = 'h1' and key = 'family' and k = 5),
    each as (select ev.q, signal, source, ev.q in (select q from lab) as labelled, coalesce(hb.hit, 0) - coalesce(ha.hit, 0) as gain from ev left join sig using (q) left join ha using (q) left join hb using (q)),
    ga as (select t.tau, count(*) filter (where labelled) as labelled, count(*) filter (where labelled and signal >= t.tau - 1e-12) as opened_labelled, count(*) filter (where not labelled) as unlabelled,
      count(*) filter (where not labelled and signal >= t.tau - 1e-12) as opened_unlabelled, count(*) filter (where signal >= t.tau - 1e-12 and gain > 0) as gains, count(*) filter (where signal >= t.tau - 1e-12 and gain < 0) as losses,
      count(*) filter (where labelled and signal >= t.tau - 1e-12 and gain = 0) as neutral, count(*) filter (where signal >= t.tau - 1e-12 and source = 'centroid') as by_centroid
      from each, (select unnest([{", ".join(map(str, TAUS))}])::double as tau) t group by t.tau)"""


def _gates(spark, sf):
    """Openings of the gate for every evaluated query: H1 against M0 at five for labelled ones, apart from them those without a label.
    A query without a fresh suggestion never opens, but counts."""
    x = every(spark, sf)
    fam = M.hits(x.lists, x.listed, asked=x.asked_keys).filter("key = 'family' and k = 5")
    gain = M.paired(fam, "h1", "m0").select("q", (F.col("x") - F.col("y")).alias("gain"))
    labelled = x.labelled.select(F.col("pos").alias("q"), F.lit(True).alias("labelled"))
    each = x.evaluated.withColumnRenamed("pos", "q").join(_signal(x), "q", "left").join(gain, "q", "left").join(labelled, "q", "left")
    rows = each.withColumn("tau", F.explode(F.array(*map(F.lit, TAUS))))
    op, lab, gain = F.coalesce(F.col("signal") >= F.col("tau") - 1e-12, F.lit(False)), F.col("labelled").isNotNull(), F.coalesce("gain", F.lit(0))
    counts = {"labelled": lab, "opened_labelled": lab & op, "unlabelled": ~lab, "opened_unlabelled": ~lab & op, "gains": op & (gain > 0), "losses": op & (gain < 0), "neutral": lab & op & (gain == 0), "by_centroid": op & (F.col("source") == "centroid")}
    return rows.groupBy("tau").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


@query("gate_table_all", GATES_SQL + " select *, round((opened_labelled + opened_unlabelled) / (labelled + unlabelled), 9) as coverage from ga")
def gate_table_all(spark, sf):
    return _gates(spark, sf).withColumn("coverage", F.round((F.col("opened_labelled") + F.col("opened_unlabelled")) / (F.col("labelled") + F.col("unlabelled")), 9))


@query(
    "gate_choice_all",
    GATES_SQL + """, c as (select tau, opened_labelled + opened_unlabelled as opened, opened_labelled, gains, losses, labelled + unlabelled as n from ga)
    select tau, opened, gains, losses from c where gains >= losses and opened >= 0.02 * n order by opened desc, gains / nullif(opened_labelled, 0) desc nulls last, tau limit 1""",
)
def gate_choice_all(spark, sf):
    rows = _gates(spark, sf).withColumn("opened", F.col("opened_labelled") + F.col("opened_unlabelled"))
    ok = rows.filter((F.col("gains") >= F.col("losses")) & (F.col("opened") >= 0.02 * (F.col("labelled") + F.col("unlabelled"))))
    best = F.max_by(F.struct("tau", "opened", "gains", "losses"), F.struct("opened", F.try_divide("gains", "opened_labelled"), -F.col("tau"))).alias("b")
    return ok.agg(best).select("b.*").filter("tau is not null")  # no row if no gate will do


@query(
    "threshold_search_all",
    every_sql(HITS) + """, x as (select l.score, coalesce(h.hit, 0) as hit from l0 l left join hit h on h.q = l.q and h.method = 'm0' and h.key = 'family' and h.k = 1 where l.rank = 1),
    g as (select score, sum(hit) as good, count(*) as al from x group by score),
    r as (select score, sum(good) over (order by score desc) / sum(al) over (order by score desc) as p from g)
    select round(min(score), 6) as tau, (select count(*) from x where score >= (select min(score) from r where p >= 0.5)) as opened, (select count(*) from x) as n from r where p >= 0.5""",
)
def threshold_search_all(spark, sf):
    """All queries are scored, so those without a label stand for themselves only, as misses; tau is null if no score is precise enough."""
    x = every(spark, sf)
    hit = M.hits(x.lists, x.listed, asked=x.asked_keys).filter("method = 'm0' and key = 'family' and k = 1").select("q", "hit")
    labelled = x.labelled.select(F.col("pos").alias("q"), F.lit(True).alias("labelled"))
    rows = x.top("m0").filter("rank = 1").join(hit, "q", "left").join(labelled, "q", "left").select("score", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("labelled", F.lit(False)).alias("labelled"))
    tau = M.threshold(rows, 1.0)
    return rows.crossJoin(F.broadcast(tau)).groupBy().agg(F.round(F.first("tau"), 6).alias("tau"), F.count_if(F.col("score") >= F.col("tau")).alias("opened"), F.count("*").alias("n"))
