"""The last lists, those of large groups of near copies, are worked off in few rounds that read the texts once."""

import random
from collections import Counter

from test_documents import near_brute

from priorweave.llm import neardup


def test_texts_are_read_once_for_the_last_lists(spark, monkeypatch):
    rng, base = random.Random(1), [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(80), rng.randint(1, 5)):
            w[j] = f"e{rng.randint(0, 3)}" if rng.random() < 0.5 else f"u{i}-{j}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "SMALL", 2)
    seen, last = [], []
    full, rare = neardup.Sets.full, neardup._rare_postings
    monkeypatch.setattr(neardup.Sets, "full", lambda self, nodes: (seen.append(bool(last)), full(self, nodes))[1])
    monkeypatch.setattr(neardup, "_rare_postings", lambda left, sets, wide: (last.append(1) if wide is None else None, rare(left, sets, wide))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == near_brute(rows)
    assert last and sum(seen) == 1
