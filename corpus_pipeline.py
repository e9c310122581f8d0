"""A training corpus from raw documents: language ID, near-dedup, substring dedup, mixing, tokenizing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorweave.llm import bpe, langid, mixing, neardup, substring
from priorweave.llm.storage import Stash, release

#: A document goes if no profile of a known language is nearer than this (1: the same ranking, 0: no n-gram in common).
LEAST_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus names; texts without letters and in no known language go."""
    return langid.recognised(docs, langid.learn(docs), LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return neardup.without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one, or an earlier part of the same, has already."""
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and the last one as far, as their source's share asks for."""
    return mixing.mixed_texts(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, for each row of the mix."""
    return bpe.digests(docs)


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mix_sources), ("byte-level BPE", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on documents; release(spark) removes the tables that it reads once it has been written."""
    stash = Stash(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        known = frozenset(Stash.left)
        docs = stash.keep(stage(spark, docs, sf_dir), *([docs] if k else []))
        release(spark, known)
    return STAGES[-1][1](spark, docs, sf_dir).select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
