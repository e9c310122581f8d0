"""Sharding by a Feistel permutation of global row numbers; DataFrame functions only.

Rows are numbered 0..N-1 in the order of id, CRC-32 and size, over a range-partitioned and sorted table: a row's number is its
place in its partition plus the sizes of the partitions before. The permutation works on a*a numbers with a = ceil(sqrt(N)):
four rounds (l, r) -> (r, l + F(r) mod a). Images from N on are permuted again until they are below N (cycle walking), which
needs a*a-N steps more at most, for about 2*sqrt(N) rows. Image p goes to shard p mod S, slot p div S: shard sizes differ by one
at most, slots have no gaps, and anyone can compute the place of a row number, or the row number of a place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Stash

ROUNDS = 4


def number_rows(df: DataFrame, order: list[str], stash: Stash, name: str = "row_no") -> DataFrame:
    """df with gapless global row numbers in the given order; equal rows get any order among themselves."""
    spread = F.monotonically_increasing_id().alias("_spread")
    ranged = df.select("*", spread).repartitionByRange(*order, "_spread").sortWithinPartitions(*order, "_spread").drop("_spread")
    kept = stash.keep(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # a row for each shuffle partition: at most spark.sql.shuffle.partitions of them
    before = sizes.selectExpr("_part", "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0L) as _before")
    at = kept.withColumn("_part", part).join(F.broadcast(before), "_part")
    return at.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_place")


def feistel(x: Column, side: int, seed: str) -> Column:
    """One pass of the permutation of 0..side*side-1."""
    left, right = F.floor((x - x % F.lit(side)) / F.lit(side)), x % F.lit(side)
    for i in range(ROUNDS):
        digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-{i}-"), right.cast("string"))), 1, 12), 16, 10).cast("long")
        left, right = right, (left + digest % F.lit(side)) % F.lit(side)
    return left * F.lit(side) + right


def permuted(x: Column, n: int, seed: str) -> Column:
    """The place of row number x in the shuffled order of n rows."""
    side = max(1, math.isqrt(max(n, 1) - 1) + 1)
    once = feistel(x, side, seed)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(side * side - n + 1)), once, lambda y, _: F.when(y < n, y).otherwise(feistel(y, side, seed)))
    return F.when(once < n, once).otherwise(walk)


def shard_rows(df: DataFrame, order: list[str], shards: int = 16, seed: str = "shuffle") -> DataFrame:
    """df with row_no, shard and slot; an empty df stays empty."""
    stash = Stash(df.sparkSession, "sharding")
    numbered = stash.keep(number_rows(df, order, stash))
    n = numbered.count()
    place = numbered.withColumn("_p", permuted(F.col("row_no"), n, seed))
    return place.withColumn("shard", (F.col("_p") % shards).cast("int")).withColumn("slot", F.expr(f"_p div {shards}")).drop("_p")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: str = "shuffle") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of each row.

    A null or empty text has size 1 and CRC 0; null ids come first in the numbering; rows that are equal in id, CRC and size get
    different slots. Other columns are ignored. Copies of a text are spread like any other rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_rows(narrow, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
