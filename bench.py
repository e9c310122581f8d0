"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Queries run once each, in one session: the first one of a family (m0/m1, bm25) also builds the score table or index that the
session keeps for the others.
"""

from __future__ import annotations

import json
import os
import time

from priorweave.plans import registry
from priorweave.session import session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = (
    "m0_topk m1_topk m2_beta_grid interleave_h hit_rates relative_gain gate_table gold_rank_position bm25_topk tfidf_topk rrf_hybrid candidate_map_mrr "
    "bootstrap_ci kappa_agreement exact_memory_vote key_coverage_grouping_sets asof_best_answer asof_version hash_split norm_text html_clean event_tumbling stream_versions"
).split()


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
