"""Dialogue context, memory and values. A turn is (conv_id, turn, role, text); assistant turns are the system's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorweave.functions import text as X


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def acts(text: Column) -> Column:
    """What a system turn does, as sorted distinct marks: ASK, LIST or SAY."""
    each = F.array(F.when(F.contains(text, F.lit("?")), "ASK"), F.when(F.contains(text, F.lit(":")) | F.contains(text, F.lit("|")), "LIST"))
    found = F.array_sort(F.array_distinct(F.array_compact(each)))
    return F.when(F.size(found) == 0, F.array(F.lit("SAY"))).otherwise(found)


def with_context(turns: DataFrame) -> DataFrame:
    """User turns with the acts of the last system turn before them, START if there is none."""
    last = F.last(F.when(F.col("role") == "assistant", acts(F.col("text"))), ignorenulls=True).over(by_turn().rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("context", F.coalesce(last, F.array(F.lit("START")))).filter("role = 'user'")


def coarse_key(rows: DataFrame) -> DataFrame:
    """A key that recurs: the first normalised word and the context."""
    return rows.withColumn("key", F.concat_ws("##", F.element_at(F.split(X.norm(F.col("text")), " "), 1), F.array_join("context", "|")))


def slots(text: Column) -> Column:
    """slot -> value of an utterance: its first and last word and its length class."""
    w = X.words(text)
    return F.create_map(F.lit("first"), F.get(w, F.lit(0)), F.lit("last"), F.element_at(w, -1), F.lit("size"), F.when(F.size(w) < 20, "short").otherwise("long"))


def delta(now: Column, before: Column) -> Column:
    """The slots whose value changed."""
    return F.map_filter(now, lambda k, v: ~v.eqNullSafe(F.element_at(before, k)))


def exact_memory(records: DataFrame, asked: DataFrame, key: str = "key", label: str = "label", least: int = 2, agreement: float = 0.8) -> DataFrame:
    """asked with the majority label of its key where enough records agree, else null."""
    from .metrics import majority

    found = majority(records, [key], label, least, agreement).withColumnRenamed(label, "predicted")
    return asked.join(found.select(key, "predicted", "n", "agreement"), key, "left")


def value_index(values: DataFrame, least: int = 2, shortest: int = 3) -> DataFrame:
    """(value, concept, n): the concept that a value stands for most often, first seen wins ties; rare, short and short numeric
    values are no evidence. values (concept, value, seq)."""
    counts = values.groupBy(F.lower("value").alias("value"), "concept").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    best = counts.groupBy("value").agg(F.max_by(F.struct("concept", "n"), F.struct("n", -F.col("seq"))).alias("b")).select("value", "b.*")
    return best.filter((F.col("n") >= least) & (F.length("value") >= shortest) & ~F.col("value").rlike(r"^\d{1,3}$"))


def longest_matches(tokens: DataFrame, index: DataFrame, longest: int = 3) -> DataFrame:
    """(id, start, end, value, concept): from left to right the longest known run of tokens at each place, none overlapping, a concept
    once. tokens (id, toks array). All runs meet the index in one hash join; the greedy choice is a fold over a text's few matches."""
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("toks") - n, F.lit(-1))), lambda i: F.struct(i.alias("start"), (i + n).alias("end"), F.array_join(F.slice("toks", i + 1, n), " ").alias("value")))))
    runs = tokens.filter(F.size("toks") > 0).select("id", F.explode(spans).alias("s")).select("id", "s.*").filter((F.col("start") >= 0))
    found = runs.join(index.select("value", "concept"), "value").filter("value <> ''")
    kind = "array<struct<start:int,end:int,value:string,concept:string>>"
    order = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("far"), "value", "concept"))).alias("m"))
    zero = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("at"))
    fits = lambda acc, x: (x["start"] >= acc["at"]) & ~F.exists(acc["out"], lambda y: y["concept"] == x["concept"])
    step = lambda acc, x: F.when(fits(acc, x), F.struct(F.concat(acc["out"], F.array(F.struct(x["start"].alias("start"), (-x["far"]).alias("end"), x["value"].alias("value"), x["concept"].alias("concept")))).alias("out"), (-x["far"]).alias("at"))).otherwise(acc)
    return order.select("id", F.explode(F.aggregate("m", zero, step, lambda acc: acc["out"])).alias("x")).select("id", "x.*")


def span_labels(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """BIO labels: a token inside a span is B-slot if it begins it, else I-slot, and O outside. tokens (id, i, start, end)."""
    s = spans.select("id", "slot", F.col("start").alias("s"), F.col("end").alias("e"))
    inside = tokens.join(s, "id").filter((F.col("start") >= F.col("s")) & (F.col("end") <= F.col("e")))
    tag = inside.groupBy("id", "i").agg(F.min(F.struct("s", F.concat(F.when(F.col("start") == F.col("s"), "B-").otherwise("I-"), "slot").alias("tag"))).alias("t")).select("id", "i", "t.tag")
    return tokens.join(tag, ["id", "i"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def simulate(turns: DataFrame, step, schema: str) -> DataFrame:
    """Runs step(state, turn) -> (state, row) over each dialogue in order: what a turn gives out is what the next one takes in."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for row in pdf.sort_values("turn").to_dict("records"):
            state, got = step(state, row)
            out.append(got)
        return pd.DataFrame(out)

    return turns.groupBy("conv_id").applyInPandas(run, schema)


def blend(model: Column, memory: Column, weight: float) -> Column:
    """(1 - w) * model + w * memory over two label -> probability maps; a label that one lacks counts 0."""
    return F.map_zip_with(model, memory, lambda k, a, b: (1 - weight) * F.coalesce(a, F.lit(0.0)) + weight * F.coalesce(b, F.lit(0.0)))


def decide(probability: Column, negated: Column, buys: Column, supported: Column) -> Column:
    """What a turn may do: an unsupported request is refused, a negated purchase blocked, and a call needs half the probability."""
    return F.when(~supported, "refuse").when(negated & buys, "block").when(probability >= 0.5, "call").otherwise("ask")
