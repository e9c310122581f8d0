"""The test tables in the roles of the reference inputs, and the same as SQL.

Vectors in the order of their ids are the corpus; the last fifth is evaluated. Links: the first vector of a label to others of it,
and each vector to the next of its label, both thinned by a hash. Links whose later end is before the cut are known to rankers.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorweave.functions.vectors import draw
from priorweave.operators import ranking as R
from priorweave.operators import timeline as T
from priorweave.session import cut, table

DIM = 64
BETA = 0.02
GRID = [0.0, 0.005, 0.01, 0.02, 0.04, 0.08]


_kept: dict[tuple[str, ...], Vectors] = {}


def vectors(spark: SparkSession, sf_dir: str) -> Vectors:
    """The corpus of a session and folder; what queries share (links, nodes, scores, lists) is checkpointed once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = Vectors(spark, sf_dir)
    return _kept[key]


def every(spark: SparkSession, sf_dir: str) -> Every:
    """The same corpus, with scores and lists of all evaluated queries."""
    key = (spark.sparkContext.applicationId, sf_dir, "every")
    if key not in _kept:
        x, y = vectors(spark, sf_dir), Every(spark, sf_dir)
        y.corpus, y.links, y.adjacency, y.nodes, y.labelled = x.corpus, x.links, x.adjacency, x.nodes, x.labelled
        _kept[key] = y
    return _kept[key]


def forget() -> None:
    """For benchmarks: the next query starts from the files."""
    _kept.clear()


class Vectors:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.tops: dict[tuple[str, int], DataFrame] = {}

    @cached_property
    def corpus(self) -> DataFrame:
        return cut(T.positions(table(self.spark, self.sf_dir, "embeddings"), ["vec_id"]).select("pos", "label", F.col("embedding").alias("v")))

    @cached_property
    def e0(self) -> DataFrame:
        return self.corpus.agg(F.floor(0.8 * (F.max("pos") + 1)).alias("e0"))

    @cached_property
    def links(self) -> DataFrame:
        rows = self.corpus.select("pos", "label")
        hub = rows.groupBy("label").agg(F.min("pos").alias("a"))
        star = rows.join(F.broadcast(hub), "label").filter("pos <> a").select("a", F.col("pos").alias("b"), F.lit(60).alias("lim"))
        chain = rows.select(F.col("pos").alias("a"), F.lead("pos").over(Window.partitionBy("label").orderBy("pos")).alias("b"), F.lit(30).alias("lim")).filter("b is not null")
        both = star.union(chain)
        return cut(both.filter(draw(F.col("a").cast("string"), F.col("b").cast("string")) % 100 < F.col("lim")).select("a", "b").distinct())

    @cached_property
    def adjacency(self) -> DataFrame:
        return cut(T.symmetric(T.memory_links(self.links, self.e0)))

    @cached_property
    def gold(self) -> DataFrame:
        return T.gold_of(self.links)

    @cached_property
    def evaluated(self) -> DataFrame:
        return self.corpus.select("pos").crossJoin(F.broadcast(self.e0)).filter("pos >= e0").select("pos")

    @cached_property
    def labelled(self) -> DataFrame:
        return cut(self.evaluated.join(self.gold.select(F.col("q").alias("pos")).distinct(), "pos", "left_semi"))

    @property
    def asked(self) -> DataFrame:
        return self.labelled

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(R.node_table(self.adjacency, self.corpus, DIM))

    @cached_property
    def scores(self) -> DataFrame:
        """Scores of the asked queries: the five best by each ranker, and some others."""
        return cut(R.best_links(self.corpus, self.asked, 5, [("own", 0.0), ("m1", 0.0), ("m2", BETA), ("p0", 0.0)], self.adjacency, self.nodes))

    @cached_property
    def grid(self) -> DataFrame:
        """The same by M2 with each factor of GRID."""
        return cut(R.best_links(self.corpus, self.asked, 5, [("m2", beta) for beta in GRID], self.adjacency, self.nodes))

    def top(self, method: str, k: int = 5) -> DataFrame:
        if (method, k) in self.tops:
            return self.tops[method, k]
        s = self.scores.withColumn("score", {"m0": F.col("own"), "m1": F.col("m1"), "m2": F.round(F.col("m1") + BETA * F.col("logdeg"), 6), "p0": R.popularity_control(F.col("own"), F.col("logdeg"))}[method])
        self.tops[method, k] = cut(R.top_k(s, k).select("q", "rank", "d", "score"))
        return self.tops[method, k]

    @cached_property
    def lists(self) -> DataFrame:
        """(method, q, rank, d) of M0, M1, M2, H and H1."""
        m = {k: self.top(k).select("q", "rank", "d") for k in ("m0", "m1", "m2")}
        m |= {"h": R.interleave(m["m0"], m["m2"]), "h1": R.interleave(m["m0"], m["m1"])}
        out = None
        for name, df in m.items():
            df = df.select(F.lit(name).alias("method"), "q", "rank", "d")
            out = df if out is None else out.union(df)
        return cut(out)

    @property
    def marked(self) -> DataFrame:
        return self.gold.join(self.labelled.withColumnRenamed("pos", "q"), "q", "left_semi")

    @property
    def keys(self) -> DataFrame:
        """(key, q, d): marked answers, and their families, which a hub makes large."""
        return self.marked.select(F.lit("marked").alias("key"), "q", "d").union(R.family(self.marked, self.adjacency).select(F.lit("family").alias("key"), "q", "d"))

    @property
    def asked_keys(self) -> DataFrame:
        """(key, q) of all keys."""
        return self.labelled.select(F.explode(F.array(F.lit("marked"), F.lit("family"))).alias("key"), F.col("pos").alias("q"))

    @cached_property
    def listed(self) -> DataFrame:
        """Of the keys those that a list names."""
        named = self.lists.select("q", "d").distinct()
        marked = named.join(self.marked, ["q", "d"], "left_semi")
        return cut(marked.select(F.lit("marked").alias("key"), "q", "d").union(R.in_family(named, self.marked, self.adjacency).select(F.lit("family").alias("key"), "q", "d")))


class Every(Vectors):
    """Queries without a link count too: their lists can open a gate or pass a threshold, and never hit."""

    @property
    def asked(self) -> DataFrame:
        return self.evaluated


DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"

GRAPH = f"""
with v0 as (select row_number() over (order by vec_id) - 1 as pos, label, embedding::double[] as v from embeddings),
nn as (select count(*) as n, floor(0.8 * count(*))::bigint as e0 from v0),
hub as (select label, min(pos) as hub from v0 group by label),
offered as (
  select hub.hub as a, v0.pos as b, 60 as lim from v0 join hub using (label) where v0.pos <> hub.hub
  union all
  select pos, nxt, 30 from (select pos, lead(pos) over (partition by label order by pos) as nxt from v0) where nxt is not null),
links as (select distinct a, b from offered where ('0x' || substr(md5(a || '-' || b), 1, 8))::bigint % 100 < lim),
mem as (select a, b from links, nn where b < e0),
adj as (select a as node, b as nbr from mem union select b, a from mem),
gold as (select distinct b as q, a as d from links),
ev as (select pos as q from v0, nn where pos >= e0),
lab as (select q from ev where q in (select q from gold)),
s as (select q.pos as q, d.pos as d, round({DOT.format(a="q.v", b="d.v")}, 6) as own
      from v0 q join lab on lab.q = q.pos join v0 d on d.pos < q.pos),
member as (select distinct node, node as nbr from adj union all select node, nbr from adj),
csum as (select node, i, sum(v[i]) as c from member join v0 on v0.pos = nbr, range(1, {DIM + 1}) t(i) group by node, i),
cvec as (select node, list(c order by i) as c, sqrt(sum(c * c)) + 1e-9 as len from csum group by node),
deg as (select node, count(*) as deg from adj group by node),
nbm as (select s.q, adj.node as d, max(s.own) as nbr from s join adj on adj.nbr = s.d group by 1, 2),
m as (select s.q, s.d, s.own, nbm.nbr,
        case when cvec.node is not null then round(list_sum(list_transform(range(1, {DIM + 1}), lambda i: q.v[i] * (cvec.c[i] / cvec.len))), 6) end as cen,
        coalesce(ln(1 + deg.deg), 0) as logdeg
      from s join v0 q on q.pos = s.q left join nbm on nbm.q = s.q and nbm.d = s.d left join cvec on cvec.node = s.d left join deg on deg.node = s.d),
m1 as (select *, greatest(own, coalesce(nbr, -9), coalesce(cen, -9)) as m1 from m),
sc as (select *, round(m1 + {BETA} * logdeg, 6) as m2, round(logdeg + 1e-3 * own, 6) as p0 from m1),
l0 as (select q, d, own as score, row_number() over (partition by q order by own desc, d) as rank from sc qualify rank <= 5),
l1 as (select q, d, m1 as score, row_number() over (partition by q order by m1 desc, d) as rank from sc qualify rank <= 5),
l2 as (select q, d, m2 as score, row_number() over (partition by q order by m2 desc, d) as rank from sc qualify rank <= 5)
"""


def interleave_sql(a: str, b: str, where: str = "true") -> str:
    return f"""(select q, d, row_number() over (partition by q order by pl) as rank from (
      select x.q, x.d, min(x.pl) as pl from (
        select q, d, rank, 2 * rank as pl from {a} union all select q, d, rank, 2 * rank + 1 from {b}) x
      join (select q, least(max(case when z = 0 then rank end), max(case when z = 1 then rank end)) as m
            from (select q, rank, 0 as z from {a} union all select q, rank, 1 from {b}) group by q) y on y.q = x.q and x.rank <= y.m
      where {where} group by x.q, x.d) qualify rank <= 5)"""


LISTS = (
    GRAPH
    + f""", lh as {interleave_sql("l0", "l2")}, lh1 as {interleave_sql("l0", "l1")},
lists as (select 'm0' as method, q, rank, d from l0 union all select 'm1', q, rank, d from l1 union all select 'm2', q, rank, d from l2
          union all select 'h', q, rank, d from lh union all select 'h1', q, rank, d from lh1),
fam as (select gold.q, gold.d from gold join lab using (q) union select gold.q, adj.nbr from gold join lab using (q) join adj on adj.node = gold.d),
keys as (select 'marked' as key, gold.q, gold.d from gold join lab using (q) union all select 'family', q, d from fam)
"""
)


def every_sql(sql: str) -> str:
    """The same over scores of all evaluated queries."""
    asked = "join lab on lab.q = q.pos"
    if sql.count(asked) != 1:
        raise ValueError("the SQL does not take its queries from lab")
    return sql.replace(asked, "join ev on ev.q = q.pos")
