"""Every event asks for versions and answers, not those of one residue."""

from priorweave.plans import registry

SF = "/root/testdata/sf0.001"


def test_events_of_any_residue(spark):
    for name in ("asof_per_query_all", "asof_best_answer_all"):
        asked = {r.q for r in registry.QUERIES[name](spark, SF).select("q").distinct().collect()}
        assert {q % 50 for q in asked} == set(range(50)), name
