"""The population bootstrap: its point by hand, its spread by the formula of the variance."""

import math

from priorweave.operators import metrics as M

SCORES, SIZES = "g string, part string, d int", "g string, marked long, unmarked long, pool long"


def test_population_bootstrap(spark):
    scores = [("a", "F", d) for d in [1] * 60 + [-1] * 20] + [("a", "P", d) for d in [1] * 50 + [0] * 50] + [("b", "F", 1)] * 2
    sizes = [("a", 200, 300, 120), ("b", 2, 0, 0), ("none", 10, 5, 3), ("empty", 0, 0, 0)]
    one, two = ({r.g: tuple(r)[1:] for r in M.population_bootstrap(spark.createDataFrame(scores, SCORES), spark.createDataFrame(sizes, SIZES), "g", 2.0).collect()} for _ in range(2))
    assert one == two
    point, lo, hi = one["a"]
    assert point == round((40 + 2 * 120 * 0.5) / 800, 6)
    marked = 200 * (80 / 200 - (40 / 200) ** 2)
    pool = 4 * (0.25 * 300 * 0.4 * 0.6 + 120**2 * 0.25 / 100 + 300 * 0.4 * 0.6 * 0.25 / 100)
    sd = math.sqrt(marked + pool) / 800
    assert abs((hi - lo) / (2 * 1.96 * sd) - 1) < 0.1 and lo < point < hi
    assert one["b"] == (1.0, 1.0, 1.0) and one["none"] == (0.0, 0.0, 0.0) and one["empty"] == (None, None, None)
