"""Intermediate tables in the folder that driver and executors share, and Bloom filters of a fixed size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
#: Spark's own switch that removes the shuffle files of an execution when that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: 2 MB, however many keys there are; beyond some 10^7 keys a filter lets most rows pass, which costs time but no result.
FILTER_BITS = 1 << 24
PIECE_BITS = 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only on one machine and where that is unset, as in tests."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local["):
                raise ValueError("operators keep tables in a folder that driver and executors share: set spark.checkpoint.dir")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="priorweave-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


class Stash:
    """Tables of one operator call: written as Parquet, so that lost executors cost no recomputation, and read again.

    An operator drops a table when its last reader has run, and before it returns all but those that its result still reads. What
    is left then is small beside the input and goes with release().
    """

    left: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"
        self.tables: dict[int, tuple[DataFrame, str]] = {}
        self.n = 0
        self.left[self.base] = spark

    def keep(self, df: DataFrame, *done: DataFrame) -> DataFrame:
        """df as a table; the tables `done`, which nothing reads from now on, go."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(table)] = (table, path)
        self.drop(*done)
        return table

    def drop(self, *done: DataFrame | None) -> None:
        for table in done:
            if id(table) in self.tables:
                remove(self.spark, self.tables.pop(id(table))[1])

    def only(self, *needed: DataFrame) -> None:
        """Drops every table but these, and has the driver's cleaner drop the executors' copies of broadcast filters."""
        self.spark.sparkContext._jvm.System.gc()
        self.drop(*(t for k, (t, _) in list(self.tables.items()) if not any(k == id(x) for x in needed)))


def release(spark: SparkSession, but: frozenset[str] = frozenset()) -> None:
    """Removes all that operators have left in this session, but for these; for when their results have been written."""
    for base in [b for b, s in Stash.left.items() if s is spark and b not in but]:
        remove(spark, base)
        del Stash.left[base]


def bit_of(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def key_filter(rows: DataFrame, *keys: str) -> DataFrame:
    """(piece, bits): a Bloom filter of the keys of rows, FILTER_BITS long. Null keys count like any other."""
    bit = bit_of(*keys)
    places = rows.select(F.floor(bit / PIECE_BITS).cast("int").alias("piece"), (bit % PIECE_BITS).alias("bit"))
    return places.groupBy("piece").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))


def maybe_in(rows: DataFrame, bits: DataFrame, *keys: str) -> DataFrame:
    """rows with _maybe: false where the keys are certainly not in the filter. The filter is 2 MB at most, so it is broadcast."""
    bit = bit_of(*keys)
    names = rows.columns
    joined = rows.withColumns({"_piece": F.floor(bit / PIECE_BITS).cast("int"), "_bit": (bit % PIECE_BITS).cast("int")})
    joined = joined.join(F.broadcast(bits.withColumnsRenamed({"piece": "_own", "bits": "_bits"})), F.col("_piece") == F.col("_own"), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.getbit(byte, F.col("_bit") % 8), F.lit(0)) == 1
    return joined.select(*names, inside.alias("_maybe"))


def arrow_batches(spark: SparkSession, rows: int = 512) -> None:
    """Small Arrow batches: a batch of very long texts, or of index rows, must fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
