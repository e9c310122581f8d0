"""Means of word vectors have every component."""

from priorweave.plans import registry

SF = "/root/testdata/sf0.001"


def test_all_components(spark):
    rows = registry.QUERIES["mean_word_vectors_64"](spark, SF).groupBy("conv_id", "turn").count().collect()
    assert rows and {r["count"] for r in rows} == {64}
