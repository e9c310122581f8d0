"""Rankers' k best without a table of all pairs, against that table."""

import numpy as np
from pyspark.sql import functions as F

from priorweave.operators import ranking as R
from priorweave.operators import scoring


def corpus(spark, n=300, dim=8):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, dim))
    v[50:60] = v[:10]  # equal vectors: ties go to the older one
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, x.astype(float).tolist()) for i, x in enumerate(v)], "pos long, v array<float>")
    links = [(0, b) for b in range(1, 200, 2)] + [(a, a + 7) for a in range(0, 220, 3)] + [(120, b) for b in range(121, 200)]
    adjacency = spark.createDataFrame(sorted({x for a, b in links for x in ((a, b), (b, a))}), "node long, nbr long")
    return vectors.cache(), adjacency.cache()


def test_best_are_those_of_the_whole_table(spark, monkeypatch):
    """Hubs are cut into parts of 16 neighbours; queries lie among linked documents, so that only earlier neighbours may count."""
    monkeypatch.setattr(scoring, "PART", 16)
    vectors, adjacency = corpus(spark)
    queries = vectors.filter("pos % 3 = 1 and pos > 20").select("pos")
    nodes = R.node_table(adjacency, vectors, 8).cache()
    rankers = [("own", 0.0), ("m1", 0.0), ("m2", 0.02), ("p0", 0.0)]
    got = R.best_links(vectors, queries, 5, rankers, adjacency, nodes).cache()
    want = R.link_scores(R.score_table(vectors, queries, 5, nodes.select("node")), adjacency, nodes, vectors).cache()
    assert got.count() < want.count() / 2
    score = {"own": F.col("own"), "m1": F.col("m1"), "m2": F.round(F.col("m1") + 0.02 * F.col("logdeg"), 6), "p0": R.popularity_control(F.col("own"), F.col("logdeg"))}
    for name, c in score.items():
        a, b = (sorted(map(tuple, R.top_k(s.withColumn("score", c), 5).select("q", "rank", "d", "score", "own", "nbr", "cen", "m1", "logdeg").collect())) for s in (got, want))
        assert a == b, name


def test_family_of_several_answers(spark):
    _, adjacency = corpus(spark)
    pairs = sorted({(a, b) for a, b in map(tuple, adjacency.collect())})
    gold = [(301, 0), (301, 7), (301, 120), (302, 120), (303, 299)]
    want = sorted({(q, d) for q, d in gold} | {(q, b) for q, d in gold for a, b in pairs if a == d})
    frame = spark.createDataFrame(gold, "q long, d long")
    got = R.family(frame, adjacency).collect()
    assert sorted(map(tuple, got)) == want
    asked = spark.createDataFrame([(q, d) for q in (301, 302, 303) for d in range(300)], "q long, d long")
    assert sorted(map(tuple, R.in_family(asked, frame, adjacency).collect())) == want


def test_related_documents(spark):
    _, adjacency = corpus(spark)
    near = {}
    for a, b in map(tuple, adjacency.collect()):
        near.setdefault(a, set()).add(b)
    pairs = [(d, e) for d in range(0, 240, 5) for e in range(d + 1, 240, 7)]
    want = sorted((d, e) for d, e in pairs if e in near.get(d, ()) or near.get(d, set()) & near.get(e, set()))
    assert sorted(map(tuple, R.related(spark.createDataFrame(pairs, "d long, e long"), adjacency).collect())) == want
