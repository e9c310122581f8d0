"""Rankers: dense, by links, by popularity, learned, lexical, fused, interleaved and gated. Ties go to the older document.

The score table (q, d, own) holds, for each query, its k nearest earlier documents and all earlier documents that have links:
nothing else can reach the k best of any ranker that adds links to cosine similarity. Blocks of queries are broadcast and
documents stream past them as matrices, so neither side is shuffled and the full product is never materialised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorweave.operators import scoring

QUERY_BLOCK = 4096
DOC_BLOCK = 512


def score_table(vectors: DataFrame, queries: DataFrame, k: int, linked: DataFrame | None = None, block: int = QUERY_BLOCK, query_vectors: DataFrame | None = None) -> DataFrame:
    """vectors (pos, v, and scope if rows of one scope only may meet); queries (pos); linked (node);
    query_vectors, if the queries are not among vectors. With linked, the table has a row for each query and linked document: for
    small tables and tests, best_links gives the k best without it."""
    if linked is None:
        return scoring.best(vectors, queries, k, [("own", 0.0)], query_vectors=query_vectors).select("q", "d", "own")
    spark = vectors.sparkSession
    scoped = "scope" in vectors.columns
    docs = vectors.select("pos", "v", *(["scope"] if scoped else []))
    docs = docs.join(linked.select(F.col("node").alias("pos"), F.lit(True).alias("linked")), "pos", "left") if linked is not None else docs.withColumn("linked", F.lit(None).cast("boolean"))
    asked = (query_vectors or vectors).join(queries.select("pos"), "pos", "left_semi").select("pos", "v", *(["scope"] if scoped else []))
    n = queries.count()
    out = None
    for b in range(max(1, -(-n // block))):
        part = asked.filter(F.pmod(F.xxhash64("pos"), F.lit(max(1, -(-n // block)))) == b).toArrow()
        if not part.num_rows:
            continue
        q = (part.column("pos").to_numpy(), np.stack(part.column("v").to_pylist()).astype(np.float64), np.array(part.column("scope").to_pylist()) if scoped else None)
        shared = spark.sparkContext.broadcast(q)

        def run(batches, shared=shared):
            qpos, qv, qs = shared.value
            best, where = np.full((len(qpos), k), -np.inf), np.full((len(qpos), k), np.iinfo(np.int64).max)
            for whole in batches:
                for batch in (whole.slice(i, DOC_BLOCK) for i in range(0, whole.num_rows, DOC_BLOCK)):
                    pos = batch.column("pos").to_numpy()
                    v = np.stack(batch.column("v").to_pylist()).astype(np.float64)
                    is_linked = np.array([bool(x) for x in batch.column("linked").to_pylist()])
                    s = np.round(qv @ v.T, 6)
                    ok = pos[None, :] < qpos[:, None]
                    if qs is not None:
                        ok &= qs[:, None] == np.array(batch.column("scope").to_pylist())[None, :]
                    i, j = np.nonzero(ok & is_linked[None, :])
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(qpos[i]), pa.array(pos[j]), pa.array(s[i, j])], ["q", "d", "own"])
                    s[~ok | is_linked[None, :]] = -np.inf
                    better = np.flatnonzero((s >= best.min(axis=1)[:, None]).any(axis=1) & (s > -np.inf).any(axis=1))
                    if len(better):
                        both = np.concatenate([best[better], s[better]], axis=1)
                        places = np.concatenate([where[better], np.broadcast_to(pos, (len(better), len(pos)))], axis=1)
                        top = np.lexsort((places, -both), axis=1)[:, :k]
                        best[better], where[better] = np.take_along_axis(both, top, 1), np.take_along_axis(places, top, 1)
            i, j = np.nonzero(best > -np.inf)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(qpos[i]), pa.array(where[i, j]), pa.array(best[i, j])], ["q", "d", "own"])

        got = docs.mapInArrow(run, "q long, d long, own double")
        out = got if out is None else out.union(got)
    return out if out is not None else spark.createDataFrame([], "q long, d long, own double")


def top_k(scores: DataFrame, k: int, score: str = "score", by: tuple[str, ...] = ("q",)) -> DataFrame:
    """rank 1..k by score, then age; a partial limit runs before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), "d")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def node_table(adjacency: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(node, deg, logdeg, centroid): the centroid is the normalised sum of the node's and its neighbours' vectors."""
    own = adjacency.select("node").distinct().withColumn("nbr", F.col("node"))
    members = own.unionByName(adjacency.select("node", "nbr"))
    each = members.join(vectors.select(F.col("pos").alias("nbr"), "v"), "nbr")
    sums = each.groupBy("node").agg((F.count("*") - 1).alias("deg"), *(F.sum(F.get("v", F.lit(i)).cast("double")).alias(f"c{i}") for i in range(dim)))
    c = F.array(*(F.col(f"c{i}") for i in range(dim)))
    length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    return sums.select("node", "deg", F.log1p("deg").alias("logdeg"), F.transform(c, lambda x: x / length).alias("centroid"))


def link_scores(scores: DataFrame, adjacency: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q, d, own, nbr, cen, m1, logdeg): m1 is the best of own, the best neighbour's own and the centroid's similarity."""
    from priorweave.functions.vectors import dot

    near = scores.select("q", F.col("d").alias("nbr"), F.col("own").alias("s")).join(adjacency, "nbr").groupBy("q", F.col("node").alias("d")).agg(F.max("s").alias("nbr"))
    at = scores.join(nodes.select(F.col("node").alias("d"), "logdeg", "centroid"), "d", "left").join(near, ["q", "d"], "left")
    at = at.join(vectors.select(F.col("pos").alias("q"), "v"), "q")
    at = at.withColumn("cen", F.when(F.col("centroid").isNotNull(), F.round(dot("v", "centroid"), 6)))
    return at.select("q", "d", "own", "nbr", "cen", F.greatest("own", "nbr", "cen").alias("m1"), F.coalesce("logdeg", F.lit(0.0)).alias("logdeg"))


def best_links(vectors: DataFrame, queries: DataFrame, k: int, rankers: list[tuple[str, float]], adjacency: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """link_scores of the k best by each ranker ("own", "m1", "m2" with a factor of the bonus, "p0") and some others: no ranker's k best
    lack. Without nodes no centroid counts."""
    return scoring.joined(scoring.best(vectors, queries, k, rankers, adjacency, nodes))


def popularity_bonus(scores: DataFrame, betas: list[float]) -> DataFrame:
    """m2 for each beta: m1 and a bonus for the logarithm of the degree."""
    grid = F.explode(F.array(*map(F.lit, betas)))
    return scores.withColumn("beta", grid).withColumn("m2", F.round(F.col("m1") + F.col("beta") * F.col("logdeg"), 6))


def popularity_control(own: Column, logdeg: Column) -> Column:
    return F.round(logdeg + F.lit(1e-3) * own, 6)


#: Neighbours within so many positions are one row where families are made.
SPAN = 4096


def family(gold: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Answers and their direct neighbours, not further. A hub's family is repeated for each query that it answers, so there are far more
    rows than links: neighbours go as arrays of a stretch of positions, which are only put together, and made distinct, for queries of
    several answers."""
    gold = gold.select("q", "d").distinct()
    near = adjacency.groupBy(F.col("node").alias("d"), F.floor(F.col("nbr") / SPAN).alias("at")).agg(F.collect_set("nbr").alias("nbrs"))
    number = gold.groupBy("q").agg(F.count("*").alias("n"))
    own = gold.join(number, "q")
    each = own.join(near.select("d", "at"), "d").join(near, ["d", "at"]).select("q", "n", "at", "nbrs")
    each = each.union(own.select("q", "n", F.floor(F.col("d") / SPAN), F.array("d")))
    several = each.filter("n > 1").groupBy("q", "at").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))
    return each.filter("n = 1").select("q", "nbrs").union(several.select("q", "nbrs")).select("q", F.explode("nbrs").alias("d"))


def in_family(pairs: DataFrame, gold: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Those of the pairs (q, d) that are in the family, which is not made for that."""
    pairs = pairs.select("q", "d").distinct()
    beside = pairs.join(gold.select("q", F.col("d").alias("node")), "q")
    near = beside.join(adjacency.select("node", F.col("nbr").alias("d")), ["node", "d"], "left_semi").select("q", "d")
    return pairs.join(gold.select("q", "d"), ["q", "d"], "left_semi").union(near).distinct()


def related(pairs: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Those of the distinct pairs (d, e) that are neighbours or have one in common, which is looked for among the neighbours of the one
    that has fewer."""
    links = adjacency.select("node", "nbr")
    deg = links.groupBy("node").agg(F.count("*").alias("deg"))
    both = pairs.join(deg.select(F.col("node").alias("d"), F.col("deg").alias("dd")), "d").join(deg.select(F.col("node").alias("e"), F.col("deg").alias("de")), "e")
    fewer = F.col("dd") <= F.col("de")
    both = both.select("d", "e", F.when(fewer, F.col("d")).otherwise(F.col("e")).alias("node"), F.when(fewer, F.col("e")).otherwise(F.col("d")).alias("other"))
    shared = both.join(links, "node").join(links.select(F.col("node").alias("other"), "nbr"), ["other", "nbr"], "left_semi").select("d", "e")
    return shared.union(pairs.select("d", "e").join(links.select(F.col("node").alias("d"), F.col("nbr").alias("e")), ["d", "e"], "left_semi")).distinct()


def interleave(first: DataFrame, second: DataFrame, k: int = 5) -> DataFrame:
    """a1, b1, a2, b2, ... without repeats, k at most; the lists (q, rank, d) alternate up to the shorter one's end."""
    m = first.groupBy("q").agg(F.max("rank").alias("m1")).join(second.groupBy("q").agg(F.max("rank").alias("m2")), "q").select("q", F.least("m1", "m2").alias("m"))
    both = first.select("q", "d", "rank", (2 * F.col("rank")).alias("at")).union(second.select("q", "d", "rank", (2 * F.col("rank") + 1).alias("at")))
    once = both.join(m, "q").filter(F.col("rank") <= F.col("m")).groupBy("q", "d").agg(F.min("at").alias("at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("at"))).filter(F.col("rank") <= k).select("q", "rank", "d")


def gated(plain: DataFrame, network: DataFrame, gate: DataFrame, k: int = 5) -> DataFrame:
    """Interleaved with the network's list first where gate (q, open) is open."""
    opened = gate.filter("open").select("q")
    return interleave(network.join(opened, "q", "left_semi"), plain.join(opened, "q", "left_semi"), k).union(interleave(plain.join(opened, "q", "left_anti"), network.join(opened, "q", "left_anti"), k))


def rrf(lists: list[DataFrame], c: int = 60, cut: int = 100) -> DataFrame:
    """Reciprocal-rank fusion of lists (q, rank, d): the sum of 1 / (c + rank)."""
    union = None
    for part in lists:
        part = part.filter(F.col("rank") <= cut).select("q", "d", "rank")
        union = part if union is None else union.union(part)
    return union.groupBy("q", "d").agg(F.round(F.sum(1 / (F.lit(c) + F.col("rank"))), 9).alias("score"))


def postings(docs: DataFrame, terms: Column, id_col: str = "pos") -> DataFrame:
    """(d, term, tf, dl): dl counts the document's tokens after the stop words are gone."""
    each = docs.select(F.col(id_col).alias("d"), terms.alias("t")).withColumn("dl", F.size("t"))
    return each.select("d", "dl", F.explode("t").alias("term")).groupBy("d", "term", "dl").agg(F.count("*").alias("tf"))


def bm25_index(post: DataFrame, docs: DataFrame, prefix: Column, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(d, term, w). Document frequencies, and the number and mean length of documents (d, dl; empty ones count), come from those
    that prefix selects, so nothing leaks back from later ones."""
    stats = docs.filter(prefix).agg(F.count("*").alias("n0"), F.avg("dl").alias("avgdl"))
    df = post.filter(prefix).groupBy("term").agg(F.count("*").alias("df"))
    w = post.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n0") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return w.select("d", "term", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("w"))


def lexical_scores(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, d, score) of earlier documents that share a term; queries (q, term) distinct."""
    found = weights.join(queries, "term").filter(F.col("d") < F.col("q"))
    return found.groupBy("q", "d").agg(F.round(F.sum("w"), 6).alias("score"))


def padded(top: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Short lists filled with the oldest earlier documents at score 0: a list can lack k of the first 2k of them at most."""
    oldest = docs.filter(F.col("d") < 2 * k).select("d")
    zero = queries.join(oldest, F.col("d") < F.col("q")).select("q", "d", F.lit(0.0).alias("score"))
    zero = zero.join(top.select("q", "d"), ["q", "d"], "left_anti")
    return top_k(top.select("q", "d", "score").union(zero), k)


def tfidf_weights(post: DataFrame, n: DataFrame, prefix: Column, min_df: int = 2) -> DataFrame:
    """(d, term, w): (1 + ln tf) * (ln((1+N)/(1+df)) + 1) over terms of at least min_df prefix documents, of length 1."""
    df = post.filter(prefix).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    raw = post.join(df, "term").crossJoin(F.broadcast(n))
    raw = raw.withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n0")) / (1 + F.col("df"))) + 1))
    length = raw.groupBy("d").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, "d").select("d", "term", (F.col("w") / F.col("len")).alias("w"))


def cosine_scores(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, d, score) of earlier documents by the product of weights."""
    q = weights.join(queries, weights.d == queries.q, "left_semi").select(F.col("d").alias("q"), "term", F.col("w").alias("wq"))
    found = weights.join(q, "term").filter(F.col("d") < F.col("q"))
    return found.groupBy("q", "d").agg(F.round(F.sum(F.col("w") * F.col("wq")), 6).alias("score"))


def mean_word_vector(tokens: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(d, v): the mean of the vectors of a document's known tokens (d, token); unknown ones do not count."""
    each = tokens.join(vectors, "token")
    means = each.groupBy("d").agg(*(F.avg(F.get("v", F.lit(i)).cast("double")).alias(f"c{i}") for i in range(dim)))
    return means.select("d", F.array(*(F.col(f"c{i}") for i in range(dim))).alias("v"))
