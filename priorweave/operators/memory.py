"""Episode memory: what was validated before for the same key, else for the most similar earlier texts, within the scopes asked for.

Records are (scope, key, label, text, seq). Equal texts and equal keys are one row from the start, so a phrase that everybody says
costs one row for each scope and label, not one for each time it was said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorweave.functions import text as X


def features(text: Column, context: Column, intent: Column) -> Column:
    """The lower-cased text with a mark for each act before it and one for the intent in force."""
    marks = F.transform(context, lambda a: F.concat(F.lit("__pa_"), a))
    return F.lower(F.concat_ws(" ", text, marks, F.concat(F.lit("__pi_"), intent)))


def _terms(texts: DataFrame) -> DataFrame:
    """(text, term, tf): words and pairs of neighbouring words."""
    pairs = F.transform("w", lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))
    split = texts.select("text", X.words(F.col("text")).alias("w"))
    grams = F.concat("w", F.slice(pairs, F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))))
    return split.select("text", F.explode(grams).alias("term")).groupBy("text", "term").agg(F.count("*").alias("tf"))


def vectors(texts: DataFrame, vocabulary: DataFrame, similarity: float) -> DataFrame:
    """(text, term, x, first): unit TF-IDF vectors, and whether a term belongs to the part that a similar text must meet.

    Terms are ordered from rare to common. If the rarest common term of two texts lay where the rest of one vector is shorter than
    `similarity`, their product would be smaller than that, so similar texts share a term that is `first` in both.
    """
    weighted = _terms(texts).join(vocabulary, "term").withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    rest = Window.partitionBy("text").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    squares = weighted.withColumns({"rest": F.sum(F.col("x") * F.col("x")).over(rest), "all": F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("text"))})
    return squares.select("text", "term", (F.col("x") / F.sqrt("all")).alias("x"), (F.col("rest") >= (similarity * similarity - 1e-6) * F.col("all")).alias("first"))


def similar_texts(records: DataFrame, asked: DataFrame, similarity: float, min_df: int = 2) -> DataFrame:
    """(a, r, sim): for each distinct text of asked the texts of records of at least that cosine, rounded to 9 digits.

    Words and word pairs weigh (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), n and df counting records, repeated texts as often as
    they are; terms of fewer than min_df records are unknown.
    """
    said = records.filter("text is not null").groupBy("text").agg(F.count("*").alias("times"))
    df = _terms(said.select("text")).join(said, "text").groupBy("term").agg(F.sum("times").alias("df")).filter(F.col("df") >= min_df)
    n = said.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("records"))
    vocabulary = df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("records")) / (1 + F.col("df"))) + 1).alias("idf"))
    known = vectors(said.select("text"), vocabulary, similarity).select(F.col("text").alias("r"), "term", F.col("x").alias("y"), "first")
    new = vectors(asked.select("text").filter("text is not null").distinct(), vocabulary, similarity).withColumnRenamed("text", "a")
    met = new.filter("first").select("a", "term").join(known.filter("first").select("r", "term"), "term").select("a", "r").distinct()
    products = met.join(new.select("a", "term", "x"), "a").join(known.select("r", "term", "y"), ["r", "term"])
    sims = products.groupBy("a", "r").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("sim"))
    return sims.filter(F.col("sim") >= similarity)


def _shares(rows: DataFrame, by: list[str], weight: str, n: str) -> DataFrame:
    """by, n and dist: each label's share of the weight. rows have one row for each label of a group."""
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x["w"])
    each = rows.groupBy(*by).agg(F.sum(n).alias("n"), F.max(n).alias("most"), F.collect_list(F.struct("label", F.col(weight).cast("double").alias("w"))).alias("e"))
    return each.select(*by, "n", "most", F.map_from_entries(F.transform("e", lambda x: F.struct(x["label"], (x["w"] / total).alias("share")))).alias("dist"))


def consult(records: DataFrame, asked: DataFrame, least: int = 2, agreement: float = 0.8, k: int = 5, similarity: float = 0.8, weights: tuple[float, float] = (0.8, 0.5)) -> DataFrame:
    """asked (id, scopes, key, text) -> id, source, weight, n, dist, one row for each row of asked.

    source 'hash': records of the key in one of the scopes, if there are `least` of them and one label has that share. Else
    'retrieval': the k records of the most similar texts in the scopes, those of at least that similarity, weighted by it; ties go to
    the smaller seq. Else source, weight, n and dist are null, as they are for null keys and texts without known terms.
    """
    records = records.filter("label is not null")
    asked = asked.withColumn("scopes", F.array_sort(F.array_distinct("scopes")))
    counts = records.groupBy("key", "scope", "label").agg(F.count("*").alias("c"))
    keys = asked.select("key", "scopes").distinct()
    votes = keys.withColumn("scope", F.explode("scopes")).join(counts, ["key", "scope"]).groupBy("key", "scopes", "label").agg(F.sum("c").alias("c"))
    exact = _shares(votes, ["key", "scopes"], "c", "c").filter((F.col("n") >= least) & (F.col("most") >= agreement * F.col("n"))).drop("most")

    rest = asked.join(exact.select("key", "scopes"), ["key", "scopes"], "left_anti").select("text", "scopes").distinct()
    oldest = Window.partitionBy("text", "scope").orderBy("seq")
    firsts = records.withColumn("at", F.row_number().over(oldest)).filter(F.col("at") <= k).select(F.col("text").alias("r"), "scope", "seq", "label")
    near = similar_texts(records, rest, similarity).join(rest.withColumnRenamed("text", "a"), "a")
    near = near.withColumn("scope", F.explode("scopes")).join(firsts, ["r", "scope"])
    best = Window.partitionBy("a", "scopes").orderBy(F.desc("sim"), "seq")
    top = near.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k)
    top = top.groupBy("a", "scopes", "label").agg(F.sum("sim").alias("sim"), F.count("*").alias("c"))
    found = _shares(top, ["a", "scopes"], "sim", "c").select(F.col("a").alias("text"), "scopes", F.col("n").alias("n2"), F.col("dist").alias("dist2"))

    both = asked.join(exact, ["key", "scopes"], "left").join(found, ["text", "scopes"], "left")
    pick = lambda a, b: F.when(F.col("n").isNotNull(), a).when(F.col("n2").isNotNull(), b)
    return both.select("id", pick(F.lit("hash"), F.lit("retrieval")).alias("source"), pick(F.lit(weights[0]), F.lit(weights[1])).alias("weight"), F.coalesce("n", "n2").alias("n"), F.when(F.col("n").isNotNull(), F.col("dist")).otherwise(F.col("dist2")).alias("dist"))
