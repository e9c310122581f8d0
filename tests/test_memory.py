"""Episode memory on small inputs, against a loop over all records."""

import collections
import math
import random
import re

from pyspark.sql import functions as F

from priorweave.operators import memory as E

RECORDS = "scope string, key string, label string, text string, seq long"
ASKED = "id long, scopes array<string>, key string, text string"


def grams(text):
    w = re.findall(r"\w+", text.lower())
    return collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def by_loop(records, asked):
    said = [r for r in records if r[3] is not None and r[2] is not None]
    df = collections.Counter(t for r in said for t in grams(r[3]))

    def vector(text):
        x = {t: (1 + math.log(c)) * (math.log((1 + len(said)) / (1 + df[t])) + 1) for t, c in grams(text).items() if df[t] >= 2}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {t: v / size for t, v in x.items()}

    known = [(r, vector(r[3])) for r in said]
    out = {}
    for i, scopes, key, text in asked:
        same = [r[2] for r in records if r[1] == key and key is not None and r[0] in scopes and r[2] is not None]
        c = collections.Counter(same)
        if len(same) >= 2 and max(c.values()) >= 0.8 * len(same):
            out[i] = ("hash", 0.8, len(same), {k: round(v / len(same), 6) for k, v in c.items()})
            continue
        x = vector(text) if text is not None else {}
        sims = [(round(sum(v * y.get(t, 0.0) for t, v in x.items()), 9), r) for r, y in known if r[0] in scopes]
        top = sorted((-s, r[4], r[2]) for s, r in sims if s >= 0.8)[:5]
        total, share = -sum(s for s, _, _ in top), collections.Counter()
        for s, _, label in top:
            share[label] -= s
        out[i] = ("retrieval", 0.5, len(top), {k: round(v / total, 6) for k, v in share.items()}) if top else (None, None, None, None)
    return out


def consulted(spark, records, asked):
    got = E.consult(spark.createDataFrame(records, RECORDS), spark.createDataFrame(asked, ASKED)).collect()
    assert len(got) == len(asked)
    return {r.id: (r.source, r.weight, r.n, r.dist and {k: round(v, 6) for k, v in r.dist.items()}) for r in got}


def test_memory_equals_a_loop(spark):
    rng = random.Random(5)
    phrases = [" ".join(rng.choice("i want a table for two people in the city tomorrow at noon please".split()) for _ in range(rng.randint(3, 9))) for _ in range(30)]
    vary = lambda t: t if rng.random() < 0.4 else t + " " + rng.choice(["now", "ok", "thanks"])
    records = [(rng.choice("abc"), f"k{rng.randint(0, 60)}", rng.choice(["x", "x", "x", "y"]), vary(rng.choice(phrases)), s) for s in range(250)]
    asked = [(i, rng.sample("abc", rng.randint(1, 2)), f"k{rng.randint(0, 90)}", vary(rng.choice(phrases))) for i in range(80)]
    want = by_loop(records, asked)
    assert {"hash", "retrieval"} <= {v[0] for v in want.values()}
    assert consulted(spark, records, asked) == want


def test_memory_of_odd_rows(spark):
    """Null keys and texts, empty texts, unknown words, labels that are null, repeated rows and more equal texts than are asked for."""
    records = [("a", "k", "x", "yes please", s) for s in range(8)] + [("a", None, "y", None, 8), ("a", "q", None, "yes please", 9), ("b", "k", "y", "", 10), ("a", "one", "x", "yes please", 11)]
    asked = [(1, ["a"], "k", "no"), (2, ["a"], None, "yes please"), (3, ["a"], "one", None), (4, ["c"], "k", "yes please"), (5, ["a", "a"], "z", "Yes, please!"), (6, ["b"], "k", ""), (7, [], "k", "yes please"), (8, ["a"], "z", "unknown words")]
    got = consulted(spark, records, asked)
    assert got[1] == ("hash", 0.8, 8, {"x": 1.0}) and got[2] == got[5] == ("retrieval", 0.5, 5, {"x": 1.0})
    assert all(got[i] == (None, None, None, None) for i in (3, 4, 6, 7, 8))


def test_memory_without_records(spark):
    assert consulted(spark, [], [(1, ["a"], "k", "yes please")]) == {1: (None, None, None, None)}


def test_features(spark):
    df = spark.createDataFrame([("Yes", ["ASK", "LIST"], "NONE"), (None, ["START"], "buy")], "t string, c array<string>, i string")
    got = [r[0] for r in df.select(E.features(F.col("t"), F.col("c"), F.col("i"))).collect()]
    assert got == ["yes __pa_ask __pa_list __pi_none", "__pa_start __pi_buy"]
