"""Learned operators on the test tables; they have no SQL form and are tested by their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorweave.functions.vectors import draw
from priorweave.operators import models as L
from priorweave.operators import ranking as R
from priorweave.session import cut, table

from .fixtures import DIM, vectors
from .registry import query


def _learned(x):
    v = x.corpus.select("pos", "v")
    pair = lambda df: df.join(v.select(F.col("pos").alias("a"), F.col("v").alias("x")), "a").join(v.select(F.col("pos").alias("b"), F.col("v").alias("y")), "b").select("x", "y")
    known = x.adjacency.filter("node < nbr").select(F.col("node").alias("a"), F.col("nbr").alias("b"))
    random = x.corpus.filter("pos > 0").select((draw("pair", F.col("pos").cast("string")) % F.col("pos")).alias("a"), F.col("pos").alias("b"))
    return cut(L.transformed(x.corpus, L.kissme(pair(known), pair(random))))


@query("m3_topk")
def m3_topk(spark, sf):
    """Plain search in the learned space."""
    x = vectors(spark, sf)
    return R.top_k(R.score_table(_learned(x), x.evaluated, 5).withColumnRenamed("own", "score"), 5)


@query("m4_topk")
def m4_topk(spark, sf):
    """Links and popularity in the learned space."""
    x = vectors(spark, sf)
    space = _learned(x)
    dim = len(space.first()["v"])
    nodes = cut(R.node_table(x.adjacency, space, dim))
    s = R.best_links(space, x.evaluated, 5, [("m2", 0.02)], x.adjacency, nodes)
    return R.top_k(s.withColumn("score", F.round(F.col("m1") + 0.02 * F.col("logdeg"), 6)), 5).select("q", "rank", "d", "score")


@query("role_classifier")
def role_classifier(spark, sf):
    """Cross-fitted predictions of a turn's role from its text."""
    c = table(spark, sf, "conversations").withColumn("fold", draw("fold", F.col("conv_id").cast("string")) % 2)
    n = c.count()
    out = L.cross_fitted(c, "fold", lambda train: L.text_classifier("text", "role", n=n).fit(train.select("conv_id", "turn", "role", "text", "fold")))
    return out.select("conv_id", "turn", "role", F.col("prediction").cast("int").alias("predicted"))
