"""Sampling, splitting and experiment control. A draw is a hash of the row's id: equal in any engine and on any cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorweave.functions import text as X
from priorweave.functions.vectors import draw
from priorweave.operators import timeline as T
from priorweave.operators.sampling import balanced_sides, cut_by_share, hash_sample, nested_prefixes, per_stratum
from priorweave.session import table

from .registry import query


def _h(seed: str, col: str = "doc_id") -> str:
    return f"('0x' || substr(md5('{seed}-' || {col}), 1, 8))::bigint"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query("hash_sample", f"select doc_id from documents order by {_h('sample')}, doc_id limit 100")
def sample_100(spark, sf):
    return hash_sample(_docs(spark, sf), "doc_id", 100, "sample").select("doc_id")


@query("hash_split", f"""with r as (select doc_id, row_number() over (order by {_h('split')}, doc_id) as rn, count(*) over () as n from documents)
    select doc_id, case when rn <= round_even(0.15 * n, 0) then 'dev' when rn <= round_even(0.15 * n, 0) + round_even(0.55 * n, 0) then 'memory' else 'test' end as part from r""")
def hash_split(spark, sf):
    return cut_by_share(_docs(spark, sf).select("doc_id"), "doc_id", [("dev", 0.15), ("memory", 0.55)], "test", "split").select("doc_id", "part")


@query("halves", f"with r as (select doc_id, row_number() over (order by {_h('half')}, doc_id) as rn, count(*) over () as n from documents) select doc_id, rn <= n / 2 as development from r")
def halves(spark, sf):
    d = T.with_total(T.positions(_docs(spark, sf).select("doc_id").withColumn("h", draw("half", F.col("doc_id").cast("string"))), ["h", "doc_id"]))
    return d.select("doc_id", (F.col("pos") + 1 <= F.col("n") / 2).alias("development"))


@query("stratified_sample", f"select lang, doc_id, rn from (select lang, doc_id, row_number() over (partition by lang order by {_h('stratum')}, doc_id) as rn from documents) where rn <= 25")
def stratified_sample(spark, sf):
    return per_stratum(_docs(spark, sf), "lang", "doc_id", 25, "stratum").select("lang", "doc_id", "rn")


@query("source_assignment", f"select source, {_h('desk')} % 2 as desk, count(*) as n from documents group by 1, 2")
def source_assignment(spark, sf):
    return _docs(spark, sf).groupBy("source", (draw("desk", F.col("doc_id").cast("string")) % 2).alias("desk")).agg(F.count("*").alias("n"))


@query("nested_prefixes", f"""with r as (select doc_id, row_number() over (order by {_h('curve')}, doc_id) as rn, count(*) over () as n from documents), f as (select unnest([0.02, 0.1, 0.5, 1.0])::double as share)
    select share, count(*) as n, max(doc_id) as largest from r, f where rn <= greatest(2, round_even(share * n, 0)) group by 1""")
def curve_prefixes(spark, sf):
    return nested_prefixes(_docs(spark, sf).select("doc_id"), "doc_id", [0.02, 0.1, 0.5, 1.0], "curve").groupBy("share").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest"))


@query("even_odd_folds", "select doc_id, (row_number() over (order by doc_id) - 1) % 2 as fold from documents")
def even_odd_folds(spark, sf):
    return T.positions(_docs(spark, sf).select("doc_id"), ["doc_id"]).select("doc_id", (F.col("pos") % 2).alias("fold"))


@query("negative_controls", f"with p as (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents) select pos as q, {_h('negative', 'pos')} % pos as d from p where pos > 0")
def negative_controls(spark, sf):
    p = T.positions(_docs(spark, sf).select("doc_id"), ["doc_id"]).filter("pos > 0")
    return p.select(F.col("pos").alias("q"), (draw("negative", F.col("pos").cast("string")) % F.col("pos")).alias("d"))


_ITEMS = f"""with j as (select d.doc_id, d.text, l.quality, l.toxic from documents d join labels l using (doc_id) where l.quality <> l.toxic),
    s as (select *, {_h('side')} % 2 as swapped, row_number() over (order by {_h('order')}, doc_id) as n from j)
"""


def _items(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id").filter("quality <> toxic")
    return balanced_sides(j, "doc_id", "side", "order")


@query("blind_items", _ITEMS + "select n, case when swapped = 1 then toxic else quality end as a, case when swapped = 1 then quality else toxic end as b, substr(sha256(text), 1, 16) as shown from s")
def blind_items(spark, sf):
    s = _items(spark, sf)
    sw = F.col("swapped") == 1
    return s.select("n", F.when(sw, F.col("toxic")).otherwise(F.col("quality")).alias("a"), F.when(sw, F.col("quality")).otherwise(F.col("toxic")).alias("b"), F.substring(F.sha2("text", 256), 1, 16).alias("shown"))


@query("label_key_join", _ITEMS + f""", r as (select n, doc_id, swapped, (['A', 'B', 'TIE'])[1 + {_h('judge')} % 3] as label from s)
    select n, doc_id, label, case when label = 'TIE' then 'tie' when (label = 'A') = (swapped = 0) then 'quality' else 'toxic' end as winner from r""")
def label_key_join(spark, sf):
    s = _items(spark, sf).select("n", "doc_id", "swapped")
    labels = s.select("n", F.element_at(F.array(*map(F.lit, ("A", "B", "TIE"))), (draw("judge", F.col("doc_id").cast("string")) % 3 + 1).cast("int")).alias("label"))
    won = F.when(F.col("label") == "TIE", "tie").when((F.col("label") == "A") == (F.col("swapped") == 0), "quality").otherwise("toxic")
    return s.join(labels, "n").select("n", "doc_id", "label", won.alias("winner"))


@query("order_consistency", _ITEMS + f""", r as (select doc_id, {_h('first')} % 2 as a, {_h('second')} % 2 as b from s) select count(*) as n, round(avg(case when a = b then 1.0 else 0 end), 9) as consistent from r""")
def order_consistency(spark, sf):
    s = _items(spark, sf).select("n", "doc_id")
    a = s.select(F.col("n").alias("origin"), (draw("first", F.col("doc_id").cast("string")) % 2).alias("a"))
    b = s.select(F.col("n").alias("origin"), (draw("second", F.col("doc_id").cast("string")) % 2).alias("b"))
    return a.join(b, "origin").agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 9).alias("consistent"))


@query("prompt_dedupe", "select sha256('Answer:' || text || chr(10)) as prompt, count(*) as uses, min(doc_id) as first_use from documents group by 1")
def prompt_dedupe(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.concat(F.lit("Answer:"), "text", F.lit("\n")), 256).alias("prompt"))
    return d.groupBy("prompt").agg(F.count("*").alias("uses"), F.min("doc_id").alias("first_use"))


@query("exclude_shown", f"select doc_id from documents where {_h('shown')} % 10 <> 0 and doc_id not in (select doc_id from labels where doc_id is not null)")
def exclude_shown(spark, sf):
    d = _docs(spark, sf).select("doc_id")
    shown = d.filter(draw("shown", F.col("doc_id").cast("string")) % 10 == 0)
    return d.join(shown, "doc_id", "left_anti").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("eligible_answers", "select doc_id, len(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) as words from documents join labels using (doc_id) where quality = 1 and len(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) >= 3")
def eligible_answers(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    n = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    return table(spark, sf, "documents").join(good, "doc_id").select("doc_id", n.alias("words")).filter("words >= 3")


@query("minimum_guard", "select lang, count(*) as n from documents group by 1")
def minimum_guard(spark, sf):
    """Counts, or an error where a language has too few rows to say anything."""
    g = _docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))
    return g.select("lang", F.when(F.col("n") < 2, F.raise_error(F.concat(F.lit("too few rows: "), "lang"))).otherwise(F.col("n")).alias("n"))


@query("control_pairs", """with l as (select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')) as t, row_number() over (order by doc_id) as rn from documents)
    select a.doc_id as a, b.doc_id as b, a.t <> b.t as usable from l a join l b on b.rn = a.rn + 1""")
def control_pairs(spark, sf):
    p = T.positions(table(spark, sf, "documents").select("doc_id", X.norm(F.col("text")).alias("t")), ["doc_id"])
    nxt = p.select((F.col("pos") - 1).alias("pos"), F.col("doc_id").alias("b"), F.col("t").alias("u"))
    return p.join(nxt, "pos").select(F.col("doc_id").alias("a"), "b", (F.col("t") != F.col("u")).alias("usable"))


@query("model_choice", "select s_suppkey as model from supplier where s_acctbal > 0 order by s_acctbal desc, s_name limit 1")
def model_choice(spark, sf):
    """The best model within budget; of equals the first."""
    ok = table(spark, sf, "supplier").filter("s_acctbal > 0").groupBy("s_acctbal").agg(F.min(F.struct("s_name", "s_suppkey")).alias("f"))
    return ok.agg(F.max_by("f.s_suppkey", "s_acctbal").alias("model"))
