"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams of a language, by rank. A document's own list is compared with each:
the out-of-place distance sums, over the document's n-grams, how far its rank is from the profile's, and PROFILE for an n-gram
that the profile lacks. The nearest profile names the language. Case is folded; runs of characters that are no letters become one
gap, and n-grams do not reach across gaps.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import arrow_batches

PROFILE = 300
SAMPLE_PER_LANGUAGE = 1500
BITS = 10


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """A number from 1 on for each letter's code point, 0 for the others; letters from U+0200 on share 512 numbers."""
    code = np.arange(0x110000, dtype=np.int64)
    letter = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, np.where(code < 512, code, 512 + (code * 2654435761 >> 7) % 512), 0).astype(np.uint32)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams, ascending, and their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.zeros(len(points) + 2, np.uint32)
    c[1:-1] = letter_classes()[points]
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    c = c[keep]
    if not len(c):
        return c, np.zeros(0, np.int64)
    one = c[c != 0] | np.uint32(1 << 31)
    c = np.concatenate([np.zeros(1, np.uint32), c])
    two = (c[:-1] << np.uint32(BITS)) | c[1:] | np.uint32(1 << 30)
    middle = c[1:-1] != 0
    three = ((c[:-2] << np.uint32(2 * BITS)) | (c[1:-1] << np.uint32(BITS)) | c[2:])[middle]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent codes, most frequent first, ties to the smaller code."""
    key = (counts.astype(np.int64) << 32) - codes.astype(np.int64)
    if len(key) > n:
        top = np.argpartition(-key, n - 1)[:n]
        codes, key = codes[top], key[top]
    return codes[np.argsort(-key, kind="stable")]


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint32)]))
        self.rank = np.full((len(self.names), len(self.codes)), -1, np.int32)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.codes, profiles[name])] = np.arange(len(profiles[name]))

    def identify(self, text: str | None) -> tuple[str, float, float]:
        """Language, 1 less the share of the largest possible distance, and how much nearer the best profile is than the next."""
        codes, counts = ngram_counts(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0, 0.0
        own = ranked(codes, counts)
        at = np.minimum(np.searchsorted(self.codes, own), max(len(self.codes) - 1, 0))
        known = self.codes[at] == own
        theirs = self.rank[:, at[known]]
        place = np.flatnonzero(known)
        far = np.where(theirs < 0, PROFILE, np.minimum(np.abs(theirs - place), PROFILE))
        distance = (far.sum(axis=1) + PROFILE * int((~known).sum())) / (PROFILE * len(own))
        best = int(np.argmin(distance))
        others = np.delete(distance, best)
        margin = float((others.min() - distance[best]) / max(others.min(), 1e-9)) if len(others) else 1.0
        return self.names[best], float(1 - distance[best]), margin


def held_out(id_col: Column) -> Column:
    """Rows from which nothing is learned: CRC-32 of the id as text, modulo 5, is 0 (a null id counts as '')."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles from about `sample` documents of each language (all, if fewer), those of the smallest id hashes, whole texts."""
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit("profile"), F.col(id_col)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({})
    limit = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, sample / n) * (1 << 32)))))
    chosen = rows.filter(F.shiftrightunsigned("h", 32) < limit[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                found = [ngram_counts(texts[i]) for i in np.flatnonzero(langs == lang)]
                codes, inverse = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                sums = np.bincount(inverse, weights=np.concatenate([y for _, y in found]), minlength=len(codes))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(sums.astype(np.int64))], ["lang", "gram", "n"])

    grams = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = grams.withColumn("rank", order).filter(F.col("rank") <= PROFILE).select("lang", "gram", "rank").collect()
    lists: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles({k: np.array(v, np.uint32) for k, v in lists.items()})


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and margin of each row; `und` and 0 if the text is null or has no letter."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE codes a language

    def run(batches):
        for batch in batches:
            found = [shared.value.identify(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), *(pa.array([x[k] for x in found], pa.float64()) for k in (1, 2))],
                ["doc_id", "held_out", "lang_pred", "score", "margin"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, margin double")


def recognised(docs: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has letters and a score of at least `least`, with their own columns."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = [shared.value.identify(x) for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([x[0] != "und" and x[1] >= least for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))
