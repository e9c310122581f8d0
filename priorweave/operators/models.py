"""Learned operators: a closed-form metric, linear classifiers, a token tagger and cross-fitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, HashingTF, IDF, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def second_moment(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """The sum of (x - y)(x - y)' over pairs (x, y), and their number: one d*d matrix leaves each task."""

    def run(batches):
        total, n = None, 0
        for batch in batches:
            x, y = (np.stack(batch.column(k).to_pylist()).astype(float) for k in (0, 1))
            m = (x - y).T @ (x - y)
            total, n = m if total is None else total + m, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([n])], ["m", "n"])

    parts = pairs.select("x", "y").mapInArrow(run, "m array<double>, n long")
    sums = parts.select(F.posexplode("m").alias("i", "v"), "n").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    size = int(round(len(sums) ** 0.5))
    return np.array([r["v"] for r in sums]).reshape(size, size), sums[0]["n"] if sums else 0


def kissme(similar: DataFrame, different: DataFrame, eps: float = 1e-3) -> np.ndarray:
    """L with M = L'L the positive part of inv(S) - inv(D), S and D being the mean outer products of the pairs' differences."""
    (s, ns), (d, nd) = second_moment(similar), second_moment(different)
    s, d = s / max(ns, 1), d / max(nd, 1)
    ridge = lambda m: m + eps * np.trace(m) / len(m) * np.eye(len(m))
    values, vectors = np.linalg.eigh(np.linalg.inv(ridge(s)) - np.linalg.inv(ridge(d)))
    keep = values > 0
    return np.sqrt(values[keep])[:, None] * vectors[:, keep].T


def transformed(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """vectors (pos, v, ...) in the learned space, at length 1."""
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)  # d*d numbers at most
    at = vectors.columns.index("v")

    def run(batches):
        for batch in batches:
            z = np.stack(batch.column(at).to_pylist()).astype(float) @ shared.value.T
            z /= np.linalg.norm(z, axis=1, keepdims=True) + 1e-9
            yield batch.set_column(at, "v", pa.array(z.astype(np.float32).tolist(), pa.list_(pa.float32())))

    return vectors.mapInArrow(run, vectors.schema)


def text_classifier(text: str, label: str, min_df: int = 2, c: float = 4.0, n: int = 1) -> Pipeline:
    """TF-IDF of 1- and 2-grams into logistic regression; c is the inverse of the penalty over n rows."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[\p{L}\p{N}_]+", gaps=False),
        NGram(n=2, inputCol="_w", outputCol="_b"),
        SQLTransformer(statement="select *, concat(_w, _b) as _t from __THIS__"),
        CountVectorizer(inputCol="_t", outputCol="_c", minDF=min_df),
        IDF(inputCol="_c", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="features", labelCol="_y", regParam=1.0 / (c * max(n, 1)), maxIter=40),
    ])


def token_tagger(label: str = "tag", buckets: int = 1 << 15) -> Pipeline:
    """Tags of tokens from hashed features (feats array<string>)."""
    return Pipeline(stages=[HashingTF(inputCol="feats", outputCol="features", numFeatures=buckets), StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc"), LogisticRegression(featuresCol="features", labelCol="_y", regParam=1e-4, maxIter=40)])


def token_features(tokens: DataFrame) -> DataFrame:
    """(id, i, token, start, end) -> with feats: the token, its shape, suffix and neighbours."""
    from pyspark.sql.window import Window

    from priorweave.functions import text as X

    w = Window.partitionBy("id").orderBy("i")
    low = F.lower("token")
    f = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit("-")))
    return tokens.withColumn("feats", F.array(f("w", low), f("shape", X.shape(F.col("token"))), f("suffix", F.right(low, F.lit(3))), f("before", F.lag(low).over(w)), f("after", F.lead(low).over(w)), f("digit", F.col("token").rlike(r"^\d+$").cast("string"))))


def decode_spans(tagged: DataFrame) -> DataFrame:
    """(id, concept, start, end, confidence): runs B-x I-x ... of tags; of a concept's spans the surest, a span being as sure as its
    least sure token. tagged (id, i, start, end, tag, p)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("id").orderBy("i")
    t = tagged.withColumn("concept", F.when(F.col("tag") != "O", F.substring("tag", 3, 1000)))
    begins = F.col("tag").startswith("B-") | (F.col("concept").isNotNull() & ~F.col("concept").eqNullSafe(F.lag("concept").over(w)))
    t = t.withColumn("begins", begins.cast("int"))
    t = t.withColumn("span", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("concept is not null")
    spans = t.groupBy("id", "concept", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("p").alias("confidence"))
    return spans.groupBy("id", "concept").agg(F.max_by(F.struct("start", "end", "confidence"), F.struct("confidence", -F.col("start"))).alias("b")).select("id", "concept", "b.*")


def cross_fitted(rows: DataFrame, fold: str, fit) -> DataFrame:
    """Predictions for each fold from a model of the others: what a second stage may learn from. fit(train) -> model."""
    out = None
    for f in sorted(r[0] for r in rows.select(fold).distinct().collect()):
        part = fit(rows.filter(F.col(fold) != f)).transform(rows.filter(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out
