"""Readers and writers for the input formats. Paths go to Spark alone; nothing is opened on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTS = "_Id long, _PostTypeId int, _ParentId long, _AcceptedAnswerId long, _CreationDate timestamp, _Score long, _Title string, _Body string"
HISTORY = "_Id long, _PostId long, _PostHistoryTypeId int, _CreationDate timestamp, _Text string"
POST_LINKS = "_PostId long, _RelatedPostId long, _LinkTypeId int, _CreationDate timestamp"
VOTES = "_Id long, _PostId long, _VoteTypeId int, _CreationDate timestamp"


def read_xml_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The <row .../> elements of a dump; attributes lose their underscore. Land them as Parquet before querying."""
    df = spark.read.format("xml").option("rowTag", "row").schema(schema).load(path)
    return df.select(*(F.col(c).alias(c[1:]) for c in df.columns))


def read_corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    """id, title, body; quotes are data, missing fields are empty. Gzip by extension."""
    f = F.split("value", "\t", 3)
    part = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    return spark.read.text(path).select(F.get(f, F.lit(0)).cast("long").alias("id"), part(1).alias("title"), part(2).alias("body"))


def read_pairs_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(q, similar) and (q, candidate, place) of lines `q TAB similar ids TAB candidate ids`; either list may be blank."""
    f = F.split("value", "\t", 3)
    ids = lambda i: F.filter(F.split(F.coalesce(F.get(f, F.lit(i)), F.lit("")), " "), lambda x: x != "")
    rows = spark.read.text(path).select(F.get(f, F.lit(0)).cast("long").alias("q"), ids(1).alias("s"), ids(2).alias("c"))
    similar = rows.select("q", F.explode(F.col("s").cast("array<long>")).alias("similar"))
    return similar, rows.select("q", F.posexplode("c").alias("place", "candidate")).withColumn("candidate", F.col("candidate").cast("long"))


def read_word_vectors(spark: SparkSession, path: str, dim: int = 200) -> DataFrame:
    """token, v of lines with exactly dim numbers; others are skipped."""
    f = F.split(F.trim("value"), " ")
    return spark.read.text(path).select(f.alias("f")).filter(F.size("f") == dim + 1).select(F.get("f", F.lit(0)).alias("token"), F.slice("f", 2, dim).cast("array<float>").alias("v"))


_ACTION = "struct<act: string, slot: string, values: array<string>, canonical_values: array<string>>"
_FRAME = f"""struct<service: string, actions: array<{_ACTION}>, slots: array<struct<slot: string, start: int, exclusive_end: int>>,
 state: struct<active_intent: string, slot_values: map<string, array<string>>, requested_slots: array<string>>,
 service_call: struct<method: string, parameters: map<string, string>>>"""
DIALOGUES = f"dialogue_id string, services array<string>, turns array<struct<speaker: string, utterance: string, frames: array<{_FRAME}>>>"
SCHEMAS = "service_name string, slots array<struct<name: string, is_categorical: boolean, description: string>>, intents array<struct<name: string, required_slots: array<string>, optional_slots: map<string, string>>>"


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Dialogues with their key, split folder / dialogue id."""
    df = spark.read.schema(DIALOGUES).option("multiLine", True).json(path).withColumn("split", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return df.withColumn("key", F.concat_ws("/", "split", "dialogue_id"))


def read_service_schemas(spark: SparkSession, path: str, order: str = "split") -> DataFrame:
    """Services with slots and intents; of several definitions the first split's wins."""
    df = spark.read.schema(SCHEMAS).option("multiLine", True).json(path).withColumn(order, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return df.groupBy("service_name").agg(F.min_by(F.struct("slots", "intents"), order).alias("s")).select("service_name", "s.*")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(kind, concept, service, name) of a concept mapping; null names are kept."""
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
    df = spark.read.schema(T.StructType([T.StructField("intents", kind), T.StructField("slots", kind)])).option("multiLine", True).json(path)
    one = lambda k: df.select(F.lit(k).alias("kind"), F.explode(k).alias("concept", "m")).select("kind", "concept", F.explode("m").alias("service", "name"))
    return one("intents").unionByName(one("slots"))


def write_corpus(df: DataFrame, path: str) -> None:
    df.select("id", "created", "text").write.mode("overwrite").parquet(path)


def write_links(df: DataFrame, path: str) -> None:
    df.select("src", "dst", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("created")).write.mode("overwrite").option("sep", "\t").csv(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("src long, dst long, created timestamp").csv(path)


def missing_vectors(items: DataFrame, vectors: DataFrame, model: str, prefix: str, fingerprint: str) -> DataFrame:
    """Items whose vector of this model, prefix and text fingerprint is not stored yet: what a resumed run embeds."""
    have = vectors.filter((F.col("model") == model) & (F.col("prefix") == prefix) & (F.col("fingerprint") == fingerprint))
    return items.join(have.select("id"), "id", "left_anti")


def read_key_values(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """An append-only JSONL cache: lines that do not parse are dropped, the last write of a key wins."""
    place = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    rows = spark.read.text(path).withColumn("at", place).withColumn("r", F.from_json("value", schema))
    rows = rows.filter(F.col("r").isNotNull() & F.col(f"r.{key[0]}").isNotNull())
    return rows.groupBy(*(F.col(f"r.{k}").alias(k) for k in key)).agg(F.max_by("r", "at").alias("r")).select("r.*")


def with_service(df: DataFrame, column: str, out: str, call: Callable[[list[str]], list], kind: str = "array<float>", fallback: Callable | None = None) -> DataFrame:
    """A column from a model service, one call for each Arrow batch, a second route if the first fails; equal inputs go once."""

    def run(batches):
        for pdf in batches:
            texts = pdf[column].fillna("").tolist()
            try:
                got = call(texts)
            except Exception:
                if fallback is None:
                    raise
                got = fallback(texts)
            yield pdf.assign(**{out: got})

    fields = f"{column} string, {out} {kind}"
    answers = df.select(column).distinct().mapInPandas(run, fields)
    return df.join(answers, df[column].eqNullSafe(answers[column])).select(*(df[c] for c in df.columns), out)


def model_versions(registry: DataFrame, wanted: list[str]) -> DataFrame:
    """Name, digest and dimension of the models wanted, each of which must be there."""
    found = registry.filter(F.col("name").isin(wanted))
    return found.withColumn("ok", F.when(F.col("digest").isNull(), F.raise_error(F.concat(F.lit("no digest: "), "name"))).otherwise(F.lit(True)))


def read_labels(labels: DataFrame, items: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(n, label) with synonyms of any language and case mapped; an item without a known label raises an error."""
    names = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    known = labels.select("n", F.upper(F.trim("label")).alias("k")).withColumn("label", names[F.col("k")])
    done = items.select("n").join(known.select("n", "label"), "n", "left")
    return done.withColumn("label", F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("item without a label: "), F.col("n").cast("string")))).otherwise(F.col("label")))


def write_metrics(metrics: DataFrame, path: str, digits: int = 4) -> None:
    """One JSON line for each metric row, doubles rounded."""
    rounded = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes]
    metrics.select(*rounded).write.mode("overwrite").json(path)


def write_turns(turns: DataFrame, path: str) -> None:
    """One JSON line for each turn, nulls left out, in as many files as there are partitions."""
    turns.write.mode("overwrite").json(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; built and written there if it is missing or was not written to its end."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_blind(items: DataFrame, shown: list[str], secret: list[str], path: str) -> None:
    """What a judge sees and what it must not see, in two places."""
    items.select("n", *shown).write.mode("overwrite").json(f"{path}/items")
    items.select("n", *secret).write.mode("overwrite").json(f"{path}/key")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of each input file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
