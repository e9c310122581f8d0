"""Bootstraps draw 2,000 times unless told otherwise."""

import inspect

from priorweave.operators import metrics as M
from priorweave.plans import registry

SF = "/root/testdata/sf0.001"


def test_replicates(spark):
    assert inspect.signature(M.bootstrap).parameters["replicates"].default == 2000
    for name in ("bootstrap_ci_2000", "bootstrap_ratio_2000"):
        assert all(r.lo <= r.hi for r in registry.QUERIES[name](spark, SF).collect() if r.lo is not None)
