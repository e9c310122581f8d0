"""Seeded samples and splits by hash order; a row's place is computed without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorweave.functions.vectors import draw

from .timeline import positions, with_total


def _drawn(df: DataFrame, id_col: str, seed: str) -> DataFrame:
    return df.withColumn("_h", draw(seed, F.col(id_col).cast("string")))


def hash_sample(df: DataFrame, id_col: str, k: int, seed: str) -> DataFrame:
    """k rows without replacement."""
    return _drawn(df, id_col, seed).orderBy("_h", id_col).limit(k).drop("_h")


def cut_by_share(df: DataFrame, id_col: str, shares: list[tuple[str, float]], rest: str, seed: str) -> DataFrame:
    """Rows in shuffled order cut at shares of their number, rounded half to even, the rest last."""
    placed = with_total(positions(_drawn(df, id_col, seed), ["_h", id_col]))
    upto, part = F.lit(0), None
    for name, share in shares:
        upto = upto + F.bround(F.lit(share) * F.col("n"), 0)
        hit = F.col("pos") < upto
        part = F.when(hit, name) if part is None else part.when(hit, name)
    return placed.withColumn("part", part.otherwise(rest)).drop("_h", "pos", "n")


def nested_prefixes(df: DataFrame, id_col: str, shares: list[float], seed: str, least: int = 2) -> DataFrame:
    """A row for each share that holds it; a larger share holds all of a smaller one."""
    placed = with_total(positions(_drawn(df, id_col, seed), ["_h", id_col]))
    each = placed.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return each.filter(F.col("pos") < F.greatest(F.lit(least), F.bround(F.col("share") * F.col("n"), 0))).drop("_h", "pos", "n")


def per_stratum(df: DataFrame, stratum: str, id_col: str, k: int, seed: str) -> DataFrame:
    """At most k rows of each stratum; the limit runs in each task before the shuffle."""
    order = Window.partitionBy(stratum).orderBy("_h", id_col)
    return _drawn(df, id_col, seed).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("_h")


def balanced_sides(df: DataFrame, id_col: str, side_seed: str, order_seed: str) -> DataFrame:
    """swapped (0 or 1) and a number n from 1 on in an order that tells nothing of the side."""
    sided = df.withColumn("swapped", draw(side_seed, F.col(id_col).cast("string")) % 2)
    return positions(_drawn(sided, id_col, order_seed), ["_h", id_col], "_p").withColumn("n", F.col("_p") + 1).drop("_h", "_p")
