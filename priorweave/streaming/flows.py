"""Incremental forms. Each runs to the end of what is there (availableNow) and gives the batch result.

A flow that is given a folder (at) goes on from where the last call with that folder ended, also after a restart: what has been read
is in the folder's checkpoint, and a micro-batch that is run again writes the same place again. Without a folder a call starts anew.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one key that are handed back at once.
PIECE = 10_000
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="priorweave-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


class Results:
    """The tables of micro-batches, one folder each. A batch reads those before it only, so it may run again; of the older ones just
    the last is kept, for that case."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _place(self, path: str):
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def batches(self) -> list[int]:
        """The batches whose tables are complete, in order."""
        store, top = self._place(self.path)
        if not store.exists(top):
            return []
        found = [(x.getPath().getName(), x.getPath().toString()) for x in store.listStatus(top)]
        return sorted(int(name) for name, at in found if name.isdigit() and store.exists(self._place(f"{at}/_SUCCESS")[1]))

    def before(self, batch: int) -> DataFrame | None:
        earlier = [b for b in self.batches() if b < batch]
        return self.spark.read.parquet(f"{self.path}/{earlier[-1]}") if earlier else None

    def put(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{batch}")
        for old in [b for b in self.batches() if b < batch][:-1]:
            store, there = self._place(f"{self.path}/{old}")
            store.delete(there, True)

    def last(self, schema: StructType | str) -> DataFrame:
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{done[-1]}")


def events(spark: SparkSession, sf_dir: str, files: int | None = 4) -> DataFrame:
    """files: how many a micro-batch reads; None: all that are there, for flows that need a call's events in time order, which files are not."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/events.parquet*")


def land(stream: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Runs an append stream into Parquet and reads it back. A batch without data closes what the watermark has passed."""
    spark = stream.sparkSession
    path = at or folder(spark, name)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def land_latest(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Runs a complete aggregation; each micro-batch replaces the table that is read back."""
    spark = stream.sparkSession
    path = at or folder(spark, name)
    results = Results(spark, f"{path}/out")
    stream.writeStream.outputMode("complete").foreachBatch(results.put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return results.last(stream.schema)


def versions_in_force(stream: DataFrame, t0: str) -> DataFrame:
    """The last edit before t0 of each post: late edits are cut by the predicate, not by the watermark."""
    return stream.filter(F.col("ts") < F.lit(t0).cast("timestamp")).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("version"))


def daily_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count_if(F.col("event_type") == "click").alias("ups"), F.count_if(F.col("event_type") == "purchase").alias("accepted"))


def progressive_memory(stream: DataFrame, least: int = 2, agreement: float = 0.8) -> DataFrame:
    """Each event's majority label among the earlier events of its key, asked before the event is stored; state is a count for each
    label, so it is bounded by the labels and not by the history. A key's events of a micro-batch come in pieces of any order: they are
    gathered and sorted first. Micro-batches must follow one another in time."""
    import pandas as pd

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        counts = dict(zip(*state.get)) if state.exists else {}
        pieces = list(pdfs)
        ts, ids, labels = (np.concatenate([p[c].to_numpy() for p in pieces]) for c in ("ts", "event_id", "event_type"))
        order = np.lexsort((ids, ts))
        for at in range(0, len(order), PIECE):
            rows = order[at : at + PIECE]
            said, seen = [], []
            for label in labels[rows]:
                n = sum(counts.values())
                best = min(counts, key=lambda k: (-counts[k], k)) if counts else None
                said.append(best if n >= least and counts[best] >= agreement * n else None)
                seen.append(n)
                counts[label] = counts.get(label, 0) + 1
            yield pd.DataFrame({"event_id": ids[rows], "user_id": key[0], "predicted": pd.Series(said, dtype=object), "n": seen})
        state.update((list(counts), list(counts.values())))

    return stream.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, predicted string, n long", "labels array<string>, counts array<long>", "append", "NoTimeout")


def grow_degrees(links: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Node degrees kept up to date by micro-batches: a batch's counts are added to the table of the batch before."""
    spark = links.sparkSession
    path = at or folder(spark, name)
    results = Results(spark, f"{path}/out")

    def add(df: DataFrame, batch: int) -> None:
        new = df.select(F.col("a").alias("node")).union(df.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("deg"))
        old = results.before(batch)
        results.put(new if old is None else old.union(new).groupBy("node").agg(F.sum("deg").alias("deg")), batch)

    links.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return results.last("node long, deg long")
