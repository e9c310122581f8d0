"""Lists are fused to a depth of 100, not after a cut to what is shown."""

from collections import defaultdict

from priorweave.plans import registry
from priorweave.plans.lexical import lexicon

SF = "/root/testdata/sf0.001"


def test_fusion_counts_places_after_the_tenth(spark):
    x = lexicon(spark, SF)
    scores, deepest = defaultdict(float), 0
    for part in (x.bm25_deep, x.tfidf_deep):
        for r in part.collect():
            scores[r.q, r.d] += 1 / (60 + r.rank)
            deepest = max(deepest, r.rank)
    assert 10 < deepest <= 100
    want = defaultdict(list)
    for (q, d), s in scores.items():
        want[q].append((-round(s, 9), d))
    got = defaultdict(list)
    for r in registry.QUERIES["rrf_hybrid_deep"](spark, SF).orderBy("q", "rank").collect():
        got[r.q].append((-r.score, r.d))
    assert got == {q: sorted(v)[:10] for q, v in want.items()}


def test_recall_is_measured_to_fifty(spark):
    rows = registry.QUERIES["recall_at_k_deep"](spark, SF).collect()
    assert {r.k for r in rows} == {5, 10, 20, 50} and {r.method for r in rows} == {"bm25", "tfidf", "rrf"}
