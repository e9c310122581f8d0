"""Retrieval and agreement statistics. Rates divide by all evaluated items, labelled or not; undefined ratios are null."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorweave.functions.vectors import draw


def hits(lists: DataFrame, keys: DataFrame, ks: tuple[int, ...] = (1, 5), asked: DataFrame | None = None) -> DataFrame:
    """(method, key, k, q, hit) for each query with a key: whether one of the first k is in it. asked (key, q), if keys has listed
    documents only."""
    asked = (keys if asked is None else asked).select("key", "q").distinct().join(lists.select("method", "q").distinct(), "q")
    first = lists.join(keys, ["q", "d"]).groupBy("method", "key", "q").agg(F.min("rank").alias("first"))
    rows = asked.join(first, ["method", "key", "q"], "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return rows.select("method", "key", "k", "q", F.coalesce((F.col("first") <= F.col("k")).cast("int"), F.lit(0)).alias("hit"))


def rates(hit: DataFrame, n: DataFrame) -> DataFrame:
    """Hits over the number of all evaluated rows n."""
    sums = hit.groupBy("method", "key", "k").agg(F.sum("hit").alias("hits"))
    return sums.crossJoin(F.broadcast(n)).withColumn("rate", F.round(F.col("hits") / F.col("n"), 9))


def relative_gain(hit: DataFrame, base: str) -> DataFrame:
    """Sum of a method's hits over the base's, less one."""
    sums = hit.groupBy("method", "key", "k").agg(F.sum("hit").alias("x"))
    b = sums.filter(F.col("method") == base).select("key", "k", F.col("x").alias("y"))
    return sums.filter(F.col("method") != base).join(b, ["key", "k"]).withColumn("gain", F.round(F.try_divide("x", "y") - 1, 9))


def paired(hit: DataFrame, x: str, y: str) -> DataFrame:
    """(key, k, q, x, y) of two methods."""
    each = lambda m, n: hit.filter(F.col("method") == m).select("key", "k", "q", F.col("hit").alias(n))
    return each(x, "x").join(each(y, "y"), ["key", "k", "q"])


def bootstrap(pairs: DataFrame, value: Column, replicates: int = 2000, by: tuple[str, ...] = ("key", "k"), unit: str = "q", seed: str = "boot") -> DataFrame:
    """2.5 and 97.5 % points of a statistic over resamples, and the statistic itself.

    A unit is in a resample Poisson(1) times, by a hash of seed, replicate and unit: resamples need no order, no collected list and no
    random state, and partial sums combine before the shuffle. `value` is an aggregate over columns of pairs and the weight w.
    """
    u = draw(F.lit(seed), F.col("rep").cast("string"), F.col(unit).cast("string")) / F.lit(float(1 << 32))
    w = sum((u >= F.lit(p)).cast("int") for p in POISSON)
    reps = pairs.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", w)
    each = reps.groupBy(*by, "rep").agg(value.alias("value"))
    point = pairs.withColumn("w", F.lit(1)).groupBy(*by).agg(value.alias("point"))
    ends = each.groupBy(*by).agg(*(F.percentile("value", F.lit(p)).alias(n) for n, p in (("lo", 0.025), ("hi", 0.975))))
    return point.join(ends, list(by)).select(*by, *(F.round(c, 6).alias(c) for c in ("point", "lo", "hi")))


#: Cumulative probabilities of a Poisson variable of mean 1 at 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def stratified(diff: DataFrame, weights: DataFrame) -> DataFrame:
    """The weighted mean over strata of mean differences; diff (stratum, d), weights (stratum, w)."""
    means = diff.groupBy("stratum").agg(F.avg("d").alias("mean"), F.sum((F.col("d") < 0).cast("int")).alias("minus"), F.sum((F.col("d") > 0).cast("int")).alias("plus"))
    each = means.join(F.broadcast(weights), "stratum")
    return each.agg(F.round(F.sum(F.col("w") * F.col("mean")), 9).alias("difference"), F.sum("minus").alias("minus"), F.sum("plus").alias("plus"))


def population_bootstrap(scores: DataFrame, sizes: DataFrame, by: str, scale: float = 1.0, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(by, point, lo, hi): the mean effect on all eligible rows, with 2.5 and 97.5 % points over resamples.

    sizes (by, marked, unmarked, pool): eligible rows with and without a mark, the latter counting `scale` times, and how many of these
    differ. scores (by, part, d): part 'F' are marked rows that differ, the other marked rows count as zeros; part 'P' is a judged
    sample of the pool, whose mean stands for the pool. A resample draws the marked rows and the sample anew, and the pool's size as a
    binomial. Equal scores are counted first, so what a task holds is the distinct scores of a group. Without eligible rows all are null.
    """
    counted = scores.groupBy(by, "part", "d").agg(F.count("*").alias("c"))

    def run(pdf):
        import pandas as pd

        rng = np.random.default_rng(seed)
        marked, unmarked, pool = (int(pdf[c].iloc[0]) for c in ("marked", "unmarked", "pool"))
        whole = marked + scale * unmarked
        if not whole:
            return pd.DataFrame({by: pdf[by].iloc[:1], "point": [None], "lo": [None], "hi": [None]})
        part = lambda name: (pdf[pdf.part == name].sort_values("d")[c].to_numpy() for c in ("d", "c"))
        (f, nf), (p, n_p) = part("F"), part("P")
        f, nf = np.append(f.astype(float), 0.0), np.append(nf, max(marked - nf.sum(), 0)).astype(np.int64)
        p, n_p = (p.astype(float), n_p.astype(np.int64)) if len(p) else (np.zeros(1), np.ones(1, np.int64))
        again = lambda x, n: rng.multinomial(n.sum(), n / max(n.sum(), 1), replicates) @ x if n.sum() else np.zeros(replicates)
        marks, means = again(f, nf), again(p, n_p) / n_p.sum()
        drawn = (marks + scale * rng.binomial(unmarked, min(pool / max(unmarked, 1), 1.0), replicates) * means) / whole
        point = (f @ nf + scale * pool * (p @ n_p) / n_p.sum()) / whole
        lo, hi = np.percentile(drawn, [2.5, 97.5])
        return pd.DataFrame({by: pdf[by].iloc[:1], "point": [round(point, 6)], "lo": [round(lo, 6)], "hi": [round(hi, 6)]})

    kind = sizes.schema[by].dataType.simpleString()
    return sizes.join(counted, by, "left").groupBy(by).applyInPandas(run, f"{by} {kind}, point double, lo double, hi double")


def sensitivity(truth: str, said: str) -> list[Column]:
    """Sensitivity, false-positive rate and whether both make a judge valid."""
    t, s = F.col(truth).cast("boolean"), F.col(said).cast("double")
    tpr, fpr = F.avg(F.when(t, s)), F.avg(F.when(~t, s))
    ok = (tpr >= 0.30) & (fpr <= 0.15) & (tpr - fpr >= 0.25)
    return [F.round(tpr, 9).alias("sensitivity"), F.round(fpr, 9).alias("false_positive"), F.coalesce(ok, F.lit(False)).alias("valid")]


def corrected(rate: Column, tpr: Column, fpr: Column) -> Column:
    """A judged rate without the judge's errors, within 0 and 1; null if the judge tells nothing apart."""
    return F.when(tpr > fpr, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (rate - fpr) / (tpr - fpr))))


def kappa(x: str, y: str) -> list[Column]:
    """Cohen's kappa, raw agreement, and yes rates of y given x."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    p, q = F.avg(a), F.avg(b)
    agree = F.avg((F.col(x) == F.col(y)).cast("double"))
    chance = p * q + (1 - p) * (1 - q)
    return [F.count("*").alias("n"), F.round(F.try_divide(agree - chance, 1 - chance), 9).alias("kappa"), F.round(agree, 9).alias("agreement"), F.round(F.avg(F.when(a == 1, b)), 9).alias("yes_if_yes"), F.round(F.avg(F.when(a == 0, b)), 9).alias("yes_if_no")]


def average_precision(ranked: DataFrame) -> DataFrame:
    """P@1, AP and reciprocal rank of each list (q, rank, hit); AP divides by the hits that the list has."""
    w = Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = ranked.withColumn("prec", F.sum("hit").over(w) / F.col("rank"))
    return each.groupBy("q").agg(F.max(F.when((F.col("rank") == 1) & (F.col("hit") == 1), 1).otherwise(0)).alias("p1"), F.coalesce(F.avg(F.when(F.col("hit") == 1, F.col("prec"))), F.lit(0.0)).alias("ap"), F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"))


def threshold(scored: DataFrame, scale: float, least: float = 0.5) -> DataFrame:
    """The lowest score down to which cumulative precision stays at `least`; unlabelled rows count scale times. scored (score, hit,
    labelled): rows of one score count together, so the running sum is over distinct scores only."""
    w = F.when(F.col("labelled"), F.lit(1.0)).otherwise(F.lit(scale))
    by_score = scored.groupBy("score").agg(F.sum("hit").alias("good"), F.sum(w).alias("all"))
    run = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = by_score.withColumn("precision", F.sum("good").over(run) / F.sum("all").over(run))
    return each.filter(F.col("precision") >= least).agg(F.min("score").alias("tau"))


def majority(rows: DataFrame, key: list[str], label: str, least: int = 2, agreement: float = 0.8) -> DataFrame:
    """The label of each key with at least `least` records of which a share agrees; ties to the smaller label."""
    counts = rows.groupBy(*key, label).agg(F.count("*").alias("c"))
    best = counts.groupBy(*key).agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.min_by(label, F.struct(-F.col("c"), label)).alias(label))
    return best.filter((F.col("n") >= least) & (F.col("top") >= agreement * F.col("n"))).select(*key, label, "n", F.round(F.col("top") / F.col("n"), 9).alias("agreement"))


def wins(rows: DataFrame, x: Column, y: Column) -> list[Column]:
    """Wins, losses, ties and their mean of +1, -1 and 0."""
    sign = F.when(x > y, 1).when(x < y, -1).otherwise(0)
    return [F.sum((sign == 1).cast("int")).alias("wins"), F.sum((sign == -1).cast("int")).alias("losses"), F.sum((sign == 0).cast("int")).alias("ties"), F.round(F.avg(sign.cast("double")), 9).alias("delta")]


def saturation(levels: DataFrame, base: str, middle: float = 0.5) -> DataFrame:
    """(method, index): of the gain over the base that full density brings, what comes after the middle to what comes before it;
    null if nothing does. levels (method, level, rate), level 0 to 1 with 0, middle and 1 among them."""
    b = levels.filter(F.col("method") == base).select("level", F.col("rate").alias("b"))
    gain = levels.filter(F.col("method") != base).join(b, "level").withColumn("g", F.col("rate") - F.col("b"))
    at = lambda x: F.max(F.when(F.abs(F.col("level") - x) < 1e-9, F.col("g")))
    early = at(middle) - at(0.0)
    return gain.groupBy("method").agg(F.round(F.when(early > 0, (at(1.0) - at(middle)) / early), 9).alias("index"))


def growth(levels: DataFrame, base: str) -> DataFrame:
    """(method, level, rate, relative, points): the gain relative to the base at a number of participants, null where the base is 0, and
    the points that each participant added since the level before. levels (method, level, rate); methods and levels are few."""
    b = levels.filter(F.col("method") == base).select("level", F.col("rate").alias("b"))
    order = Window.partitionBy("method").orderBy("level")
    rows = levels.join(b, "level").withColumn("points", 100 * (F.col("rate") - F.lag("rate").over(order)) / (F.col("level") - F.lag("level").over(order)))
    return rows.select("method", "level", "rate", F.round(F.try_divide(F.col("rate") - F.col("b"), "b"), 9).alias("relative"), F.round("points", 9).alias("points"))
