"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's score is a logistic function of its words and their prefixes; the document's is
1 - prod(1 - sentence score), so a gradient of the document's loss reaches the sentences that raise it, and the scores locate them.
Trained on a bounded sample of labelled documents: first the SELECTED features whose presence tells the labels apart best, then
their weights. All other rows only get scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .langid import held_out
from .storage import Stash, arrow_batches

SAMPLE_PER_LABEL = 4000
SELECTED = 4096
PREFIXES = (4, 5, 6, 7)
LEAST_DOCUMENTS = 4

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of Latin-1 letters, in place of the bytes."""
    out = K.LOWER[data]
    accent = (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97) & (out[:-1] == 0xC3)
    out[1:][accent] += 32
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hash, text number and sentence number (over all texts) of each word and each of its prefixes."""
    data = folded(data)
    inside = LETTER[data]
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets[:-1]] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    first = inside & (~before | starts_text[:-1])
    after = np.concatenate([inside[1:] & ~starts_text[1:-1], [False]]) if len(data) else inside
    starts, ends = np.flatnonzero(first), np.flatnonzero(inside & ~after) + 1
    cuts = np.cumsum(np.concatenate([[0], STOP[data]])[:-1] + starts_text[:-1]) if len(data) else np.zeros(0, int)
    sentence = cuts[starts]
    text = np.searchsorted(offsets, starts, side="right") - 1
    prefix = K.prefix_hash(data)
    hashes, texts, sentences = [K.span_hash(prefix, starts, ends)], [text], [sentence]
    for n in PREFIXES:
        long = ends - starts > n
        hashes.append(K.mix(K.span_hash(prefix, starts[long], starts[long] + n) + K.U(n)))
        texts.append(text[long])
        sentences.append(sentence[long])
    return np.concatenate(hashes), np.concatenate(texts), np.concatenate(sentences)


class Model:
    """Weights of selected features, sorted by hash, and the bias of a sentence."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[hashes & K.U(0xFFFF)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that have a weight, and the weights' numbers."""
        at = np.flatnonzero(self.maybe[hashes & K.U(0xFFFF)])
        if not len(self.hashes):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes[at]
        return at[hit], place[hit]

    def scores(self, column: pa.Array) -> np.ndarray:
        """Noisy-or of the sentence scores of each text."""
        data, offsets = K.string_bytes(column)
        out = []
        for i, j in K.slices(offsets):
            hashes, text, sentence = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out.append(self.joined(hashes, text, sentence, j - i))
        return np.concatenate(out) if out else np.zeros(0)

    def joined(self, hashes, text, sentence, n: int) -> np.ndarray:
        if not len(hashes):
            return np.zeros(n)
        bags = np.zeros(int(sentence.max()) + 1, np.int64) - 1
        bags[sentence] = text
        z = np.full(len(bags), self.bias)
        at, place = self.find(hashes)
        np.add.at(z, sentence[at], self.weights[place])
        log_clean = -np.logaddexp(0, z)
        real = bags >= 0
        return 1 - np.exp(np.bincount(bags[real], weights=log_clean[real], minlength=n))

    def sentences(self, text: str) -> list[tuple[str, float]]:
        """The sentences of a text with their scores, in order."""
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        cuts = np.concatenate([[0], np.flatnonzero(STOP[data]) + 1, [len(raw)]])
        parts = [raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:]) if raw[a:b].strip()]
        return list(zip(parts, self.scores(pa.array(parts, pa.string())).tolist()))


def fit(bags: list[tuple[int, np.ndarray, np.ndarray, int]], n_features: int, steps: int = 400, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, sentence of each hit, feature of each hit, number of sentences) of each document."""
    y = np.array([b[0] for b in bags], float)
    shift = np.cumsum([0] + [b[3] for b in bags])
    sentence = np.concatenate([b[1] + s for b, s in zip(bags, shift)]) if bags else np.zeros(0, int)
    feature = np.concatenate([b[2] for b in bags]) if bags else np.zeros(0, int)
    bag = np.repeat(np.arange(len(bags)), [b[3] for b in bags])
    w = np.zeros(n_features + 1)
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(sentence, weights=w[feature], minlength=len(bag)) + w[-1]
        p = 1 / (1 + np.exp(-z))
        log_clean = np.bincount(bag, weights=-np.logaddexp(0, z), minlength=len(bags))
        toxic = np.clip(-np.expm1(log_clean), 1e-9, None)
        # d loss / d z of a sentence: p for a clean bag, -p * (1-P)/P for a toxic one
        pull = np.where(y == 1, -(1 - toxic) / toxic, 1.0)[bag] * p / max(len(bags), 1)
        g = np.concatenate([np.bincount(feature, weights=pull[sentence], minlength=n_features), [pull.sum()]])
        g[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE_PER_LABEL) -> Model:
    """A model from at most `sample` labelled documents of either label, those of the smallest id hashes, outside the held-out fold."""
    spark = docs.sparkSession
    stash = Stash(spark, "toxicity")
    rows = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = None
    for y in (0, 1):
        part = rows.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    chosen = stash.keep(chosen)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    texts = stash.keep(texts.join(F.broadcast(chosen), "id").select("y", "text"))  # 2 * sample ids at most
    n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(np.zeros(0, K.U), np.zeros(0), -30.0)

    def present(batches):
        for batch in batches:
            y = batch.column(0).to_numpy()
            data, offsets = K.string_bytes(batch.column(1))
            hashes, toxic = [], []
            for i, j in K.slices(offsets):
                found, text, _ = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                order = np.lexsort((text, found))
                found, text = found[order], text[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
                hashes.append(found[new])
                toxic.append(y[i + text[new]])
            all_h, all_y = np.concatenate(hashes), np.concatenate(toxic)
            codes, inverse = np.unique(all_h, return_inverse=True)
            a = np.bincount(inverse, weights=all_y, minlength=len(codes)).astype(np.int64)
            b = np.bincount(inverse, minlength=len(codes)) - a
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(codes)), pa.array(a), pa.array(b)], ["h", "a", "b"])

    counts = texts.mapInArrow(present, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(f"a + b >= {LEAST_DOCUMENTS}")
    pa_, pb = F.col("a") / n[1], F.col("b") / n[0]
    both = (F.col("a") + F.col("b")) / (n[0] + n[1])
    z = F.abs(pa_ - pb) / F.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]) + F.lit(1e-6))
    picked = np.array([r["h"] for r in counts.orderBy(F.desc(z), "h").limit(SELECTED).select("h").collect()], np.int64).view(K.U)
    blank = Model(picked, np.arange(len(picked), dtype=float), 0.0)
    shared = spark.sparkContext.broadcast(blank)

    def hits(batches):
        for batch in batches:
            y = batch.column(0).to_pylist()
            data, offsets = K.string_bytes(batch.column(1))
            out = []
            for i in range(len(y)):
                h, _, sentence = features(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                used, number = np.unique(sentence, return_inverse=True)
                at, place = shared.value.find(h)
                pairs = np.unique(np.stack([number[at], place], 1), axis=0) if len(at) else np.zeros((0, 2), int)
                out.append((pairs[:, 0].tolist(), pairs[:, 1].tolist(), len(used)))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), *(pa.array([x[k] for x in out], pa.list_(pa.int32())) for k in (0, 1)), pa.array([x[2] for x in out], pa.int32())], ["y", "s", "f", "n"])

    table = texts.mapInArrow(hits, "y int, s array<int>, f array<int>, n int").toArrow()
    bags = [(y, np.array(s, np.int64), np.array(f, np.int64), n) for y, s, f, n in zip(*(table.column(k).to_pylist() for k in range(4))) if n]
    weights, bias = fit(bags, len(picked))
    return Model(blank.hashes, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; a text without letters has no sentence and scores 0."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SELECTED weights

    def run(batches):
        for batch in batches:
            p = np.clip(shared.value.scores(batch.column(2)), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence and sentence_score of each sentence with at least that score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = [(i, s, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s, p in shared.value.sentences(t or "") if p >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.float64()))], ["doc_id", "sentence", "sentence_score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, sentence string, sentence_score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, learn(docs, labels))
