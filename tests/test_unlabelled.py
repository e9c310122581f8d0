"""Rankers, gates and thresholds take queries without a link too."""

import pytest

from priorweave.plans import registry
from priorweave.plans.fixtures import every, vectors

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["m1_topk_all", "popularity_control_all", "m3_topk", "m4_topk"])
def test_every_evaluated_query_has_a_list(spark, name):
    x = vectors(spark, SF)
    assert x.labelled.count() < x.evaluated.count()
    assert {r.q for r in registry.QUERIES[name](spark, SF).collect()} == {r.pos for r in x.evaluated.collect()}


def test_gates_and_thresholds_count_every_query(spark):
    x = every(spark, SF)
    n, labelled = x.evaluated.count(), x.labelled.count()
    for r in registry.QUERIES["gate_table_all"](spark, SF).collect():
        assert (r.labelled, r.unlabelled) == (labelled, n - labelled)
        assert r.opened_labelled == r.gains + r.losses + r.neutral and r.opened_unlabelled <= r.unlabelled
    assert max(r.opened_unlabelled for r in registry.QUERIES["gate_table_all"](spark, SF).collect()) > 0
    assert registry.QUERIES["threshold_search_all"](spark, SF).first().n == n
