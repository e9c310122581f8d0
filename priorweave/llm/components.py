"""Connected components by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Stash


def components(links: DataFrame, stash: Stash) -> DataFrame:
    """links (a, b) -> (node, lab) for every node with a link, lab being the smallest node of its component."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stash.keep(both.filter("a <> b").distinct())
    labels = stash.keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("lab")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("lab").alias("seen"))
        nearer = stash.keep(labels.join(seen, "node").select("node", F.least("lab", "seen").alias("lab"), F.col("lab").alias("old")), labels)
        jump = nearer.select(F.col("node").alias("lab"), F.col("lab").alias("root"))
        moved = nearer.join(jump, "lab").select("node", F.col("root").alias("lab"), F.when(F.col("root") != F.col("old"), True).alias("changed"))
        labels = stash.keep(moved, nearer)
        if labels.filter("changed").isEmpty():
            stash.drop(both)
            return labels
