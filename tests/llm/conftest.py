import random

import pytest

WORDS = "the of and to in is it that for on with as at by this from".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and long texts, ties, copies, near copies, shared passages, repeated rows, clashing names."""
    rng = random.Random(3)
    base, passage = sentence(rng, 60), sentence(rng, 45)
    rows = [(i, sentence(rng, rng.randint(1, 80)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(100 + i, base, "en", "a") for i in range(5)]
    words = base.split()
    rows += [(200 + i, " ".join([f"x{i}", *words[1:]]), "en", "b") for i in range(4)]
    rows += [(300 + i, sentence(rng, 20) + " " + passage + "\n" + sentence(rng, 15), "de", "") for i in range(5)]
    rows += [(400, None, None, None), (401, "", "en", "a"), (402, " \t\n", "en", "a"), (403, "one two three", "en", "b"), (404, "one two three", None, "b"), (405, "12 34 !!", "en", "b"), (406, "la " * 200, "en", "a")]
    rows += [(500, sentence(rng, 30000), "en", "a"), (None, sentence(rng, 30), "en", "a"), (7, "a row that shares an id with another text of some length", "en", "b")]
    rows += [rows[0], rows[1], (-20, "héllo wörld — ünïcode <|endoftext|> text 漢字", "de", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({"n_chars": F.length("text").cast("long"), "node": F.lit(1), "value": F.lit("v"), "size": F.lit(None).cast("string"), "shard": F.lit(0), "id": F.lit(9), "lab": F.lit(2)})


@pytest.fixture(scope="session")
def plain(odd_docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in odd_docs.collect()]
