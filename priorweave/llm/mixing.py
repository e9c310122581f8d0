"""Mixing sources to target weights: hash-random order, range sort within each source, distributed prefix sums, exact cuts.

Targets fill up like water: all sources share the total by weight, a source stops at its cap and the rest share what it leaves.
Within a source documents are ordered by a hash; a bucket is a range of that hash, about BUCKET_ROWS documents wide, so that a
source with a third of all rows is as many tasks as it needs. A document's prefix sum is the total of the buckets before plus
its sum within the bucket. Whole epochs come first; of the last, the documents up to the budget are taken, and the document at
the cut gives just the words that are missing, so a source takes its target to the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .storage import Stash, arrow_batches

BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    single = F.trim(F.regexp_replace(spaced, " +", " "))
    gaps = F.octet_length(single) - F.octet_length(F.replace(single, F.lit(" "), F.lit("")))
    return F.when(single == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def targets(sizes: DataFrame, share: float, epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, no_source, source_size) -> with target; a row for each source, ordered by code point with null last."""
    rank = F.row_number().over(Window.orderBy("no_source", "source"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((rank - 1) % len(weights) + 1).cast("int"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "no_source", "source")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("total", share * F.sum("source_size").over(every))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    t = t.withColumn("level", level)
    fits = F.first(F.when(F.col("level") <= F.col("full_at"), F.col("level")), ignorenulls=True)
    t = t.withColumn("level", fits.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.withColumn("target", F.when(F.col("level").isNull() | (F.col("level") > F.col("full_at")), F.col("cap")).otherwise(F.col("level") * F.col("weight")))


def _identity(id_col: str, text_col: str, source_col: str, seed: int) -> dict[str, Column]:
    """What tells a row from others, and its place in its source's random order."""
    own, text, source = F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(source_col).cast("string")
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), own, F.xxhash64(text), source), 11)
    return {"doc_id": own, "text_hash": F.xxhash64(text), "source": F.coalesce(source, F.lit("")), "no_source": source.isNull(), "key": key}


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    identity = _identity(id_col, text_col, source_col, seed)
    return docs.select(*(c.alias(k) for k, c in identity.items()), word_count(F.col(text_col).cast("string")).alias("size"))


def bucket(key: Column, buckets: Column) -> Column:
    """The range of a 53-bit key among so many; divided first, as key times buckets passes 63 bits from 1,025 buckets on."""
    return F.floor(key / F.lit(float(1 << 53)) * buckets)


BY = ["source", "no_source"]


def _dealt(docs: DataFrame, columns: tuple[str, str, str], share: float, epochs: float, weights: tuple[float, ...], seed: int, stash: Stash) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Measured rows with their bucket, a row for each source with its target, and for each bucket the words before it."""
    rows = stash.keep(_measured(docs, *columns, seed))
    sizes = rows.groupBy(*BY).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = targets(sizes, share, epochs, weights).withColumn("budget", F.floor("target"))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).alias("whole")
    goals = stash.keep(goals.select(*BY, "source_size", "target", "budget", whole, F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets")))
    dealt = stash.keep(rows.join(goals, BY).withColumn("bucket", bucket(F.col("key"), F.col("buckets"))), rows)
    sums = dealt.groupBy(*BY, "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy(*BY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return dealt, goals, stash.keep(sums.withColumn("offset", F.coalesce(upto, F.lit(0))))


def _taken(dealt: DataFrame, offsets: DataFrame) -> DataFrame:
    inside = Window.partitionBy(*BY, "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, [*BY, "bucket"])
    rest = F.col("budget") - F.col("whole") * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_hash", *BY)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row, with text_hash, source and no_source to find the row again.

    Null and blank texts have size 0 and take nothing; a null source is a source of its own, after all others, unlike ''. Equal
    rows are taken like different ones. An empty table gives no rows. Other columns are ignored.
    """
    dealt, _, offsets = _dealt(docs, (id_col, text_col, source_col), share, epochs, weights, seed, Stash(docs.sparkSession, "mixing"))
    return _taken(dealt, offsets)


def _repeated(batches) -> Iterator[pa.RecordBatch]:
    """Rows with the columns of documents, _whole and _words -> a row for each epoch, and one with the first _words words."""
    for batch in batches:
        names = batch.schema.names
        at, texts = [], []
        column, whole, part = (batch.column(names.index(c)) for c in ("text", "_whole", "_words"))
        for i, (text, times, some) in enumerate(zip(column, whole.to_pylist(), part.to_pylist())):
            text = (text.as_py() or "").encode()
            starts, ends, _ = K.word_spans(K.np.frombuffer(text, K.np.uint8), K.np.array([0, len(text)]))
            for _ in range(times if len(starts) else 0):
                at.append(i)
                texts.append(text.decode())
            if some and some < len(starts):
                at.append(i)
                texts.append(text[: ends[some - 1]].decode())
        out = batch.take(pa.array(at, pa.int64()))
        fields = [n for n in names if n not in ("_whole", "_words")]
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}
        yield pa.RecordBatch.from_arrays([new.get(n, out.column(names.index(n))) for n in fields], fields)


def mixed_texts(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: int = 17) -> DataFrame:
    """The mix itself: rows of documents, repeated and cut as taken says, n_chars counted anew.

    A row's bucket says how often it is taken, but for the one bucket of a source in which its budget ends: only those rows are
    joined with what each takes, the others stay where they are. Rows without words go; repeated rows and ids, null ids and null
    sources are rows like any other.
    """
    arrow_batches(docs.sparkSession)
    stash = Stash(docs.sparkSession, "mixing")
    dealt, goals, offsets = _dealt(docs, ("doc_id", "text", "source"), share, epochs, weights, seed, stash)
    rest = F.col("budget") - F.col("whole") * F.col("source_size")
    ends = offsets.join(goals, BY).groupBy(*BY).agg(F.min(F.when(F.col("offset") + F.col("words") > rest, F.col("bucket"))).alias("last"))
    goals = stash.keep(goals.join(ends, BY).select(*BY, "whole", "buckets", "last"), goals)
    there = dealt.join(goals.select(*BY, "last"), BY).filter(F.col("bucket") == F.col("last")).drop("last")
    match = ["doc_id", "text_hash", *BY]
    plan = _taken(there, offsets).withColumn("copy", F.row_number().over(Window.partitionBy(*match).orderBy("taken")))
    plan = stash.keep(plan.select(*(F.col(c).alias(f"_p{k}") for k, c in enumerate([*match, "copy", "taken", "size"]))), dealt, offsets)
    own = {f"_{c}": x for c, x in _identity("doc_id", "text", "source", seed).items()}
    rows = docs.withColumns(own).join(goals.withColumnsRenamed({c: f"_g{c}" for c in goals.columns}), (F.col("_source") == F.col("_gsource")) & (F.col("_no_source") == F.col("_gno_source")))
    rows = rows.withColumn("_bucket", bucket(F.col("_key"), F.col("_gbuckets")))
    cut = F.coalesce(F.col("_bucket") == F.col("_glast"), F.lit(False))
    once = F.when(F.col("_glast").isNull() | (F.col("_bucket") < F.col("_glast")), F.lit(1)).otherwise(F.lit(0))
    sure = rows.filter(~cut).withColumns({"_whole": (F.col("_gwhole") + once).cast("long"), "_words": F.lit(0).cast("long")}).filter("_whole > 0")
    cut_rows = rows.filter(cut).withColumn("_copy", F.row_number().over(Window.partitionBy(*(f"_{c}" for c in match)).orderBy(F.lit(0))))
    on = F.col("_doc_id").eqNullSafe(F.col("_p0"))
    for k, c in enumerate([*match[1:], "copy"], 1):
        on = on & (F.col(f"_{c}") == F.col(f"_p{k}"))
    full = F.when(F.col("_p6") > 0, F.expr("_p5 div _p6")).otherwise(F.lit(0)).cast("long")
    some = F.when(F.col("_p6") > 0, F.expr("_p5 % _p6")).otherwise(F.lit(0)).cast("long")
    cut_rows = cut_rows.join(plan, on).filter("_p5 > 0").withColumns({"_whole": full, "_words": some})
    wanted = [*docs.columns, "_whole", "_words"]
    return sure.select(wanted).union(cut_rows.select(wanted)).mapInArrow(_repeated, docs.schema)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
