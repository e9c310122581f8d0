"""Judges, agreement, gains and populations, on labels as one judge (quality) and another (toxic)."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorweave.functions.vectors import draw
from priorweave.operators import metrics as M
from priorweave.session import table

from .registry import ORACLES, query

J = "with j as (select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic from documents d join labels l using (doc_id)) "


def _judged(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")


@query("kappa_agreement", J + """, a as (select lang, count(*) as n, avg(quality) as p, avg(toxic) as q, avg(case when quality = toxic then 1.0 else 0 end) as agree,
    avg(toxic) filter (where quality = 1) as yy, avg(toxic) filter (where quality = 0) as yn from j group by 1)
    select lang, n, round((agree - (p * q + (1 - p) * (1 - q))) / nullif(1 - (p * q + (1 - p) * (1 - q)), 0), 9) as kappa, round(agree, 9) as agreement, round(yy, 9) as yes_if_yes, round(yn, 9) as yes_if_no from a""")
def kappa_agreement(spark, sf):
    return _judged(spark, sf).groupBy("lang").agg(*M.kappa("quality", "toxic"))


@query("judge_validity", J + """select source, round(avg(1 - toxic) filter (where quality = 1), 9) as sensitivity, round(avg(1 - toxic) filter (where quality = 0), 9) as false_positive,
    coalesce(avg(1 - toxic) filter (where quality = 1) >= 0.30 and avg(1 - toxic) filter (where quality = 0) <= 0.15 and avg(1 - toxic) filter (where quality = 1) - avg(1 - toxic) filter (where quality = 0) >= 0.25, false) as valid from j group by 1""")
def judge_validity(spark, sf):
    return _judged(spark, sf).withColumn("said", 1 - F.col("toxic")).groupBy("source").agg(*M.sensitivity("quality", "said"))


@query("prevalence_correction", J + """, r as (select avg(toxic) filter (where quality = 0) as tpr, avg(toxic) filter (where quality = 1) as fpr from j), y as (select lang, avg(toxic) as y from j group by 1)
    select lang, round(y, 9) as rate, round(case when tpr > fpr then least(1, greatest(0, (y - fpr) / (tpr - fpr))) end, 9) as corrected from y, r""")
def prevalence_correction(spark, sf):
    j = _judged(spark, sf)
    r = j.agg(F.avg(F.when(F.col("quality") == 0, F.col("toxic"))).alias("tpr"), F.avg(F.when(F.col("quality") == 1, F.col("toxic"))).alias("fpr"))
    y = j.groupBy("lang").agg(F.avg("toxic").alias("y")).crossJoin(F.broadcast(r))
    return y.select("lang", F.round("y", 9).alias("rate"), F.round(M.corrected(F.col("y"), F.col("tpr"), F.col("fpr")), 9).alias("corrected"))


@query("stratified_diff", J + """, m as (select lang, avg(quality - toxic) as mean, count(*) filter (where quality < toxic) as minus, count(*) filter (where quality > toxic) as plus from j group by 1),
    w as (select lang, count(*) / sum(count(*)) over () as w from documents group by 1) select round(sum(w * mean), 9) as difference, sum(minus) as minus, sum(plus) as plus from m join w using (lang)""")
def stratified_diff(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.groupBy("lang").agg(F.count("*").alias("c"))
    w = n.crossJoin(F.broadcast(n.agg(F.sum("c").alias("t")))).select(F.col("lang").alias("stratum"), (F.col("c") / F.col("t")).alias("w"))
    diff = _judged(spark, sf).select(F.col("lang").alias("stratum"), (F.col("quality") - F.col("toxic")).alias("d"))
    return M.stratified(diff, w)


_W = " + ".join(f"(case when u >= {p} then 1 else 0 end)" for p in M.POISSON)
BOOT = J + """, x as (select *, ('0x' || substr(md5('boot-' || rep || '-' || doc_id), 1, 8))::bigint / 4294967296.0 as u from j, range(1, 201) r(rep)),
    y as (select *, {w} as w from x), v as (select lang, rep, {stat} as value from y group by 1, 2), p as (select lang, {point} as point from j group by 1)
    select lang, round(point, 6) as point, round(quantile_cont(value, 0.025), 6) as lo, round(quantile_cont(value, 0.975), 6) as hi from v join p using (lang) group by lang, point"""


@query("bootstrap_ci", BOOT.format(w=_W, stat="sum(w * (quality - toxic)) / nullif(sum(w), 0)", point="avg(quality - toxic)"))
def bootstrap_ci(spark, sf):
    return _bootstrap_ci(spark, sf, 200)


def _bootstrap_ci(spark, sf, replicates):
    stat = F.try_divide(F.sum(F.col("w") * (F.col("quality") - F.col("toxic"))), F.sum("w"))
    return M.bootstrap(_judged(spark, sf), stat, replicates, by=("lang",), unit="doc_id")


@query("bootstrap_ratio", BOOT.format(w=_W, stat="sum(w * quality) / nullif(sum(w * toxic), 0) - 1", point="sum(quality) / nullif(sum(toxic), 0) - 1"))
def bootstrap_ratio(spark, sf):
    return _bootstrap_ratio(spark, sf, 200)


def _bootstrap_ratio(spark, sf, replicates):
    stat = F.try_divide(F.sum(F.col("w") * F.col("quality")), F.sum(F.col("w") * F.col("toxic"))) - 1
    return M.bootstrap(_judged(spark, sf), stat, replicates, by=("lang",), unit="doc_id")


_more = lambda name: ORACLES[name].replace("range(1, 201)", "range(1, 2001)")


@query("bootstrap_ci_2000", _more("bootstrap_ci"))
def bootstrap_ci_2000(spark, sf):
    return _bootstrap_ci(spark, sf, 2000)


@query("bootstrap_ratio_2000", _more("bootstrap_ratio"))
def bootstrap_ratio_2000(spark, sf):
    return _bootstrap_ratio(spark, sf, 2000)


@query("win_tie_loss", J + "select source, count(*) filter (where quality > toxic) as wins, count(*) filter (where quality < toxic) as losses, count(*) filter (where quality = toxic) as ties, round(avg(sign(quality - toxic)), 9) as delta from j group by 1")
def win_tie_loss(spark, sf):
    return _judged(spark, sf).groupBy("source").agg(*M.wins(None, F.col("quality"), F.col("toxic")))


@query("population_effect", J + """, s as (select d.lang, count(*) as n, count(l.doc_id) as judged, coalesce(avg(l.quality - l.toxic), 0) as delta from documents d left join labels l using (doc_id) group by 1)
    select round(sum(n * delta) / sum(n), 9) as effect, sum(n)::bigint as population, sum(judged)::bigint as judged from s""")
def population_effect(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    s = docs.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("judged"), F.coalesce(F.avg(F.col("quality") - F.col("toxic")), F.lit(0.0)).alias("delta"))
    return s.agg(F.round(F.sum(F.col("n") * F.col("delta")) / F.sum("n"), 9).alias("effect"), F.sum("n").alias("population"), F.sum("judged").alias("judged"))


@query("population_ci")
def population_ci(spark, sf):
    """The effect for each language: documents of quality are marked, those of 1,000 characters or more differ, and half of the
    unmarked ones that differ are judged. Resamples have no SQL; tests hold the operator to its variance."""
    j = _judged(spark, sf).withColumns({"marked": F.col("quality") == 1, "differs": F.col("n_chars") >= 1000})
    sizes = j.groupBy("lang").agg(F.count_if("marked").alias("marked"), F.count_if(~F.col("marked")).alias("unmarked"), F.count_if(~F.col("marked") & F.col("differs")).alias("pool"))
    judged = j.filter("differs").withColumn("half", draw("pool", F.col("doc_id").cast("string")) % 2).filter("marked or half = 0")
    scores = judged.select("lang", F.when(F.col("marked"), "F").otherwise("P").alias("part"), (1 - 2 * F.col("toxic")).alias("d"))
    return M.population_bootstrap(scores, sizes, "lang")


@query("discordant_pairs", J + "select lang, count(*) filter (where quality = 0 and toxic = 1) as minus, count(*) filter (where quality = 1 and toxic = 0) as plus from j group by 1")
def discordant_pairs(spark, sf):
    return _judged(spark, sf).groupBy("lang").agg(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("minus"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("plus"))


@query("delta_split", J + "select case when n_chars < 1000 then 'short' when n_chars < 5000 then 'medium' else 'long' end as part, count(*) as n, round(avg(quality - toxic), 9) as delta from j group by 1")
def delta_split(spark, sf):
    part = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return _judged(spark, sf).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("quality") - F.col("toxic")), 9).alias("delta"))


@query("judge_controls", J + """, k as (select avg(case when toxic = 0 then 1.0 else 0 end) filter (where quality = 1) as k1, avg(case when h = 0 then 1.0 else 0 end) as k2, count(*) as n
      from (select *, ('0x' || substr(md5('swap-' || doc_id), 1, 8))::bigint % 5 as h from j))
    select round(k1, 9) as accuracy, round(k2, 9) as consistency, n, k1 >= 0.8 and k2 >= 0.1 and n >= 30 as valid from k""")
def judge_controls(spark, sf):
    j = _judged(spark, sf).withColumn("h", draw("swap", F.col("doc_id").cast("string")) % 5)
    k1, k2 = F.avg(F.when(F.col("quality") == 1, (F.col("toxic") == 0).cast("double"))), F.avg((F.col("h") == 0).cast("double"))
    return j.agg(k1.alias("a"), k2.alias("b"), F.count("*").alias("n")).select(F.round("a", 9).alias("accuracy"), F.round("b", 9).alias("consistency"), "n", ((F.col("a") >= 0.8) & (F.col("b") >= 0.1) & (F.col("n") >= 30)).alias("valid"))


@query("paired_methods", J + "select doc_id, max(case when m = 'quality' then v end) as quality, max(case when m = 'toxic' then v end) as toxic from (select doc_id, 'quality' as m, quality as v from j union all select doc_id, 'toxic', toxic from j) group by 1")
def paired_methods(spark, sf):
    j = _judged(spark, sf)
    long = j.select("doc_id", F.lit("quality").alias("m"), F.col("quality").alias("v")).union(j.select("doc_id", F.lit("toxic"), "toxic"))
    return long.groupBy("doc_id").pivot("m", ["quality", "toxic"]).agg(F.max("v"))


@query("verdicts", J + """, m as (select lang, avg(quality - toxic) as d, count(*) as n from j group by 1) select lang, case when n < 30 then 'too few' when d >= 0.7 then 'confirmed' when d > 0 then 'in part' else 'refuted' end as verdict from m""")
def verdicts(spark, sf):
    m = _judged(spark, sf).groupBy("lang").agg(F.avg(F.col("quality") - F.col("toxic")).alias("d"), F.count("*").alias("n"))
    return m.select("lang", F.when(F.col("n") < 30, "too few").when(F.col("d") >= 0.7, "confirmed").when(F.col("d") > 0, "in part").otherwise("refuted").alias("verdict"))
