"""Lexical search: benchmark passages against documents; the first 80 % of documents give the statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorweave.functions import text as X
from priorweave.operators import metrics as M
from priorweave.operators import ranking as R
from priorweave.operators import timeline as T
from priorweave.session import cut, table

from .registry import ORACLES, query

#: Words that lexical search leaves out; one list for engine and SQL.
STOP = "a an and are as at be by for from has he in is it its of on or that the this to was were will with you".split()
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)

BASE = f"""
with d as (select row_number() over (order by doc_id) - 1 as pos, text from documents), nn as (select count(*) as n, floor(0.8 * count(*))::bigint as e0 from d),
b as (select (select n from nn) + row_number() over (order by item_id) - 1 as q, text from benchmark),
tok as (select pos as d, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as term from d),
tok1 as (select * from tok where term not in ({_STOP_SQL})),
post as (select d, term, count(*) as tf from tok1 group by 1, 2),
dl as (select d.pos as d, count(t.term) as dl from d left join tok1 t on t.d = d.pos group by 1),
st as (select count(*) as n0, avg(dl) as avgdl from dl, nn where d < e0),
df as (select term, count(*) as df from post, nn where d < e0 group by 1),
qt as (select distinct q, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as term from b),
bm as (select post.d, post.term, ln(1 + (n0 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) as w from post join df using (term) join dl using (d), st),
bs as (select q, d, round(sum(w), 6) as score from bm join qt using (term) group by 1, 2),
b10 as (select q, d, score, row_number() over (partition by q order by score desc, d) as rank from bs qualify rank <= 10),
raw as (select post.d, post.term, (1 + ln(tf)) * (ln((1 + n0) / (1 + df)) + 1) as w from post join (select * from df where df >= 2) using (term), st),
tf as (select d, term, w / sqrt(sum(w * w) over (partition by d)) as w from raw),
qf as (select q, term, count(*) as tf from (select q, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as term from b) where term not in ({_STOP_SQL}) group by 1, 2),
qr as (select q, qf.term, (1 + ln(tf)) * (ln((1 + n0) / (1 + df)) + 1) as w from qf join (select * from df where df >= 2) using (term), st),
qw as (select q, term, w / sqrt(sum(w * w) over (partition by q)) as w from qr),
ts as (select q, d, round(sum(tf.w * qw.w), 6) as score from tf join qw using (term) group by 1, 2),
t10 as (select q, d, score, row_number() over (partition by q order by score desc, d) as rank from ts qualify rank <= 10),
fs as (select q, d, round(sum(1 / (60 + rank)), 9) as score from (select q, d, rank from b10 union all select q, d, rank from t10) group by 1, 2),
f10 as (select q, d, score, row_number() over (partition by q order by score desc, d) as rank from fs qualify rank <= 10),
g as (select b.q, d.pos as d from b join d on contains(d.text, b.text) and length(b.text) > 0)
"""

#: Rows of each list that are fused, and of the fused list that are evaluated.
DEPTH = 100
DEEP = (
    BASE
    + f""", b100 as (select q, d, score, row_number() over (partition by q order by score desc, d) as rank from bs qualify rank <= {DEPTH}),
t100 as (select q, d, score, row_number() over (partition by q order by score desc, d) as rank from ts qualify rank <= {DEPTH}),
fd as (select q, d, round(sum(1 / (60 + rank)), 9) as score from (select q, d, rank from b100 union all select q, d, rank from t100) group by 1, 2),
f100 as (select q, d, score, row_number() over (partition by q order by score desc, d) as rank from fd qualify rank <= {DEPTH}),
l as (select 'bm25' as method, * from b100 union all select 'tfidf', * from t100 union all select 'rrf', * from f100)
"""
)

_kept: dict = {}


class Lexicon:
    """Postings, queries and their lists of a session and folder, checkpointed on first use."""

    def __init__(self, spark, sf):
        self.docs = cut(T.positions(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"]).select("pos", "text"))
        n = self.docs.count()
        self.n, self.e0 = n, n * 4 // 5
        terms = lambda c: F.filter(X.words(c), lambda w: ~w.isin(STOP))
        self.post = cut(R.postings(self.docs, terms(F.col("text"))))
        self.sizes = self.docs.select(F.col("pos").alias("d"), F.size(terms(F.col("text"))).alias("dl"))
        bench = T.positions(table(spark, sf, "benchmark"), ["item_id"]).select((F.col("pos") + n).alias("q"), "text")
        self.bench = cut(bench)
        self.query_terms = self.bench.select("q", F.explode(X.words(F.col("text"))).alias("term")).distinct()
        self.query_post = R.postings(self.bench, terms(F.col("text")), "q")
        self.prefix = F.col("d") < self.e0
        self.bm25_deep = cut(R.top_k(R.lexical_scores(R.bm25_index(self.post, self.sizes, self.prefix), self.query_terms), DEPTH))
        self.bm25 = self.bm25_deep.filter("rank <= 10")
        total = spark.range(1).select(F.lit(self.e0).alias("n0"))
        weights = R.tfidf_weights(self.post.union(self.query_post), total, self.prefix)
        self.tfidf_deep = cut(R.top_k(R.cosine_scores(weights, self.bench.select("q")).filter(F.col("d") < n), DEPTH))
        self.tfidf = self.tfidf_deep.filter("rank <= 10")
        self.fused = R.top_k(R.rrf([self.bm25, self.tfidf]), 10)
        self.fused_deep = R.top_k(R.rrf([self.bm25_deep, self.tfidf_deep], cut=DEPTH), DEPTH)
        # containment has no equality to join on; the passages are the small, fixed side
        self.gold = cut(self.docs.join(self.bench.withColumnRenamed("text", "t"), F.contains("text", "t") & (F.length("t") > 0)).select("q", F.col("pos").alias("d")))


def lexicon(spark, sf) -> Lexicon:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _kept:
        _kept[key] = Lexicon(spark, sf)
    return _kept[key]


@query("bm25_topk", BASE + """, z as (select b.q, d.pos as d, 0.0 as score from b, d where d.pos < 20 and not exists (select 1 from b10 where b10.q = b.q and b10.d = d.pos))
    select q, d, score, row_number() over (partition by q order by score desc, d) as rank from (select q, d, score from b10 union all select * from z) qualify rank <= 10""")
def bm25_topk(spark, sf):
    x = lexicon(spark, sf)
    return R.padded(x.bm25, x.bench.select("q"), x.sizes, 10).select("q", "rank", "d", "score")


@query("bm25_strict", BASE + "select q, rank, d, score from b10")
def bm25_strict(spark, sf):
    return lexicon(spark, sf).bm25.select("q", "rank", "d", "score")


@query("tfidf_topk", BASE + "select q, rank, d, score from t10")
def tfidf_topk(spark, sf):
    return lexicon(spark, sf).tfidf.select("q", "rank", "d", "score")


@query("rrf_hybrid", BASE + "select q, rank, d, score from f10")
def rrf_hybrid(spark, sf):
    return lexicon(spark, sf).fused.select("q", "rank", "d", "score")


@query("hybrid_interleave", BASE + """, p as (select q, d, rank, 2 * rank as pl from b10 where rank <= 5 union all select q, d, rank, 2 * rank + 1 from t10 where rank <= 5),
    m as (select q, least((select max(rank) from b10 where b10.q = b.q and rank <= 5), (select max(rank) from t10 where t10.q = b.q and rank <= 5)) as m from b where b.q in (select q from b10) and b.q in (select q from t10)),
    o as (select p.q, d, min(pl) as pl from p join m on m.q = p.q and p.rank <= m.m group by 1, 2)
    select q, d, row_number() over (partition by q order by pl) as rank from o qualify rank <= 5""")
def hybrid_interleave(spark, sf):
    x = lexicon(spark, sf)
    return R.interleave(x.bm25.filter("rank <= 5"), x.tfidf.filter("rank <= 5"))


@query("rrf_hybrid_deep", DEEP + "select q, rank, d, score from f100 where rank <= 10")
def rrf_hybrid_deep(spark, sf):
    """The ten best of the first 100 of each list; rrf_hybrid fuses the first ten."""
    return lexicon(spark, sf).fused_deep.filter("rank <= 10").select("q", "rank", "d", "score")


_LISTS = BASE + ", l as (select 'bm25' as method, * from b10 union all select 'tfidf', * from t10 union all select 'rrf', * from f10)"


def _lists(x, deep=False):
    bm25, tfidf, fused = (x.bm25_deep, x.tfidf_deep, x.fused_deep) if deep else (x.bm25, x.tfidf, x.fused)
    return bm25.select(F.lit("bm25").alias("method"), "q", "rank", "d").union(tfidf.select(F.lit("tfidf"), "q", "rank", "d")).union(fused.select(F.lit("rrf"), "q", "rank", "d"))


def _map_mrr(x, lists):
    asked = lists.join(x.gold.select("q").distinct(), "q", "left_semi")
    rows = asked.join(x.gold.withColumn("hit", F.lit(1)), ["q", "d"], "left").select("method", F.struct("method", "q").alias("q"), "rank", F.coalesce("hit", F.lit(0)).alias("hit"))
    e = M.average_precision(rows).select("q.method", "p1", "ap", "rr")
    return e.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("p1"), 6).alias("p_at_1"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("rr"), 6).alias("mrr"))


def _recall(x, lists, ks):
    first = lists.join(x.gold, ["q", "d"]).groupBy("method", "q").agg(F.min("rank").alias("first"))
    n = x.gold.agg(F.countDistinct("q").alias("n"))
    rows = lists.select("method").distinct().join(first, "method", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    out = rows.groupBy("method", "k").agg(F.count_if(F.col("first") <= F.col("k")).alias("found")).crossJoin(F.broadcast(n))
    return out.select("method", "k", "found", "n", F.round(F.try_divide("found", "n"), 9).alias("recall"))


@query("candidate_map_mrr", _LISTS + """, h as (select l.method, l.q, l.rank, case when g.d is null then 0 else 1 end as hit from l left join g using (q, d) where l.q in (select q from g)),
    p as (select *, sum(hit) over (partition by method, q order by rank) / rank as prec from h),
    e as (select method, q, max(case when rank = 1 then hit else 0 end) as p1, coalesce(avg(prec) filter (where hit = 1), 0) as ap, coalesce(1 / min(rank) filter (where hit = 1), 0) as rr from p group by 1, 2)
    select method, count(*) as n, round(avg(p1), 6) as p_at_1, round(avg(ap), 6) as map, round(avg(rr), 6) as mrr from e group by 1""")
def candidate_map_mrr(spark, sf):
    x = lexicon(spark, sf)
    return _map_mrr(x, _lists(x))


@query("candidate_map_mrr_deep", DEEP + """, h as (select l.method, l.q, l.rank, case when g.d is null then 0 else 1 end as hit from l left join g using (q, d) where l.q in (select q from g)),
    p as (select *, sum(hit) over (partition by method, q order by rank) / rank as prec from h),
    e as (select method, q, max(case when rank = 1 then hit else 0 end) as p1, coalesce(avg(prec) filter (where hit = 1), 0) as ap, coalesce(1 / min(rank) filter (where hit = 1), 0) as rr from p group by 1, 2)
    select method, count(*) as n, round(avg(p1), 6) as p_at_1, round(avg(ap), 6) as map, round(avg(rr), 6) as mrr from e group by 1""")
def candidate_map_mrr_deep(spark, sf):
    x = lexicon(spark, sf)
    return _map_mrr(x, _lists(x, deep=True))


@query("recall_at_k", _LISTS + """, f as (select l.method, l.q, min(rank) as first from l join g using (q, d) group by 1, 2), n as (select count(distinct q) as n from g)
    select m.method, k.k, count(f.q) filter (where f.first <= k.k) as found, (select n from n) as n, round(count(f.q) filter (where f.first <= k.k) / (select n from n), 9) as recall
    from (select distinct method from l) m cross join (select unnest([1, 3, 5, 10]) as k) k left join f using (method) group by 1, 2""")
def recall_at_k(spark, sf):
    x = lexicon(spark, sf)
    return _recall(x, _lists(x), (1, 3, 5, 10))


@query("recall_at_k_deep", DEEP + """, f as (select l.method, l.q, min(rank) as first from l join g using (q, d) group by 1, 2), n as (select count(distinct q) as n from g)
    select m.method, k.k, count(f.q) filter (where f.first <= k.k) as found, (select n from n) as n, round(count(f.q) filter (where f.first <= k.k) / (select n from n), 9) as recall
    from (select distinct method from l) m cross join (select unnest([5, 10, 20, 50]) as k) k left join f using (method) group by 1, 2""")
def recall_at_k_deep(spark, sf):
    x = lexicon(spark, sf)
    return _recall(x, _lists(x, deep=True), (5, 10, 20, 50))


@query("document_frequency", BASE + "select term, df, round(ln(1 + (n0 - df + 0.5) / (df + 0.5)), 9) as idf from df, st where df >= 2")
def document_frequency(spark, sf):
    x = lexicon(spark, sf)
    df = x.post.filter(x.prefix).groupBy("term").agg(F.count("*").alias("df")).filter("df >= 2")
    return df.select("term", "df", F.round(F.log(1 + (x.e0 - F.col("df") + 0.5) / (F.col("df") + 0.5)), 9).alias("idf"))


@query("mean_word_vectors", """with t as (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as token from conversations),
    v as (select distinct token, 1 + ('0x' || substr(md5(token), 1, 8))::bigint % (select count(*) from embeddings) as r from t where ('0x' || substr(md5('known-' || token), 1, 8))::bigint % 2 = 0),
    e as (select row_number() over (order by vec_id) as r, embedding::double[] as v from embeddings),
    x as (select conv_id, turn, v.token, e.v from t join v using (token) join e using (r))
    select conv_id, turn, i::int as i, round(avg(v[i]), 6) as c from x, range(1, 9) s(i) group by 1, 2, 3""")
def mean_word_vectors(spark, sf):
    return _mean_word_vectors(spark, sf, 8)


@query("mean_word_vectors_64", ORACLES["mean_word_vectors"].replace("range(1, 9)", "range(1, 65)"))
def mean_word_vectors_64(spark, sf):
    return _mean_word_vectors(spark, sf, 64)


def _mean_word_vectors(spark, sf, dim):
    from priorweave.functions.vectors import draw

    vec = T.positions(table(spark, sf, "embeddings"), ["vec_id"]).select((F.col("pos") + 1).alias("r"), F.slice("embedding", 1, dim).alias("v"))
    n = vec.count()
    tokens = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("d"), F.explode(X.words(F.col("text"))).alias("token"))
    known = tokens.select("token").distinct().filter(draw("known", F.col("token")) % 2 == 0).withColumn("r", 1 + draw(F.col("token")) % n)
    means = R.mean_word_vector(tokens, known.join(vec, "r").select("token", "v"), dim)
    return means.select("d.conv_id", "d.turn", F.posexplode("v").alias("i", "c")).select("conv_id", "turn", (F.col("i") + 1).alias("i"), F.round("c", 6).alias("c"))
