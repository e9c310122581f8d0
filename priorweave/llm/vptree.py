"""Nearest vectors by inner product: vantage-point trees per shard, pruned by the triangle inequality.

Within a shard a vector x of norm at most M becomes (x, sqrt(M^2 - |x|^2)) and a query q (q, 0): the Euclidean distance then falls
as the inner product rises. A node keeps, for either child, the least and largest distance from its vantage point; a query skips
a child when factor times the least distance that the triangle inequality allows is more than that of its k-th best. Factor 1 is
exact; a larger one skips more. Equal vectors are one point of a tree with all their ids. All queries of a block descend together.

A shard has about SHARD_FLOATS numbers and is a row of the index table; queries come in blocks of at most about BLOCK vectors,
broadcast one after the other.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Stash, arrow_batches

SHARD_FLOATS = 1 << 19
BLOCK = 8192
LEAF = 128
SLACK = 12


def build(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """A serialised tree; vectors has a row for each id."""
    points, inverse = np.unique(vectors, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by_point = np.lexsort((ids, inverse))
    starts = np.searchsorted(inverse[by_point], np.arange(len(points) + 1))
    x = points.astype(np.float64)
    norms = (x * x).sum(axis=1)
    x = np.concatenate([x, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1)
    order, nodes, stack = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    rng = np.random.default_rng(0)
    while stack:
        a, b, parent, side = stack.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = number
        node = [a, b, -1, -1, 0, 0.0, 0.0, 0.0, 0.0]
        nodes.append(node)
        if b - a <= LEAF:
            continue
        vantage = order[a + rng.integers(b - a)]
        d = np.sqrt(np.maximum(((x[order[a:b]] - x[vantage]) ** 2).sum(axis=1), 0))
        ranked = np.argsort(d, kind="stable")
        order[a:b], d, half = order[a:b][ranked], d[ranked], (b - a) // 2
        node[4:] = [vantage, d[0], d[half - 1], d[half], d[-1]]
        stack += [(a, a + half, number, 0), (a + half, b, number, 1)]
    out = io.BytesIO()
    np.savez(out, ids=ids[by_point], starts=starts, points=points, order=order, nodes=np.array(nodes, np.float64))
    return out.getvalue()


class Tree:
    def __init__(self, blob: bytes):
        z = np.load(io.BytesIO(blob))
        self.ids, self.starts, self.points, self.order = z["ids"], z["starts"], z["points"].astype(np.float64), z["order"]
        self.nodes = z["nodes"]
        self.top2 = float((self.points * self.points).sum(axis=1).max())
        self.sorted_points = self.points[self.order]
        self.visited = 0

    def _distance(self, q: np.ndarray, q2: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(q2 + self.top2 - 2 * scores, 0))

    def _leaf(self, node, q, active, best, which) -> None:
        a, b = int(node[0]), int(node[1])
        self.visited += len(active)
        s = q[active] @ self.sorted_points[a:b].T
        k = best.shape[1]
        least = best[active].min(axis=1)
        useful = s.max(axis=1) >= least
        active, s = active[useful], s[useful]
        if not len(active):
            return
        all_s = np.concatenate([best[active], s], axis=1)
        all_w = np.concatenate([which[active], np.broadcast_to(np.arange(a, b), s.shape)], axis=1)
        top = np.argpartition(-all_s, k - 1, axis=1)[:, :k]
        best[active], which[active] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_w, top, 1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of the k best for each query among rows of other ids, ties to smaller ids."""
        q = queries.astype(np.float64)
        q2 = (q * q).sum(axis=1)
        keep = min(k + 1 + SLACK, len(self.points))
        best, which = np.full((len(q), keep), -np.inf), np.zeros((len(q), keep), np.int64)
        seed, stack = np.zeros(len(q), np.int64), [(0, np.arange(len(q)))]
        while stack:  # each query's nearest leaf first, for a bound
            i, active = stack.pop()
            node = self.nodes[i]
            if node[2] < 0:
                seed[active] = i
                self._leaf(node, q, active, best, which)
                continue
            d = self._distance(q[active], q2[active], q[active] @ self.points[int(node[4])])
            near = d <= (node[6] + node[7]) / 2
            stack += [(int(c), x) for c, x in ((node[2], active[near]), (node[3], active[~near])) if len(x)]
        stack = [(0, np.arange(len(q)))]
        while stack:
            i, active = stack.pop()
            node = self.nodes[i]
            if node[2] < 0:
                active = active[seed[active] != i]
                if len(active):
                    self._leaf(node, q, active, best, which)
                continue
            d = self._distance(q[active], q2[active], q[active] @ self.points[int(node[4])])
            bound = self._distance(q[active], q2[active], best[active].min(axis=1)) + 1e-7 * (1 + d)
            for child, low, high in ((3, node[7], node[8]), (2, node[5], node[6])):
                least = np.maximum(low - d, d - high)
                go = ~(least * factor > bound)
                if go.any():
                    stack.append((int(node[child]), active[go]))
        return self._exact(query_ids, q, best, which, k)

    def _exact(self, query_ids, q, best, which, k):
        out_q, out_i, out_s = [], [], []
        for n in range(len(q)):
            found = self.order[which[n][np.isfinite(best[n])]]
            cut = np.partition(best[n], -min(k + 1, len(best[n])))[-min(k + 1, len(best[n]))]
            if best[n].min() >= cut - 1e-9 * (1 + abs(cut)) and len(found) < len(self.points):
                found = np.arange(len(self.points))  # more ties than were kept
            s = np.add.accumulate(self.points[found] * q[n], axis=1)[:, -1]  # one order of addition for all
            if len(found) > k + 1:
                top = np.argpartition(-s, k)[: k + 1]
                s_cut = s[top].min()
                found, s = found[s >= s_cut], s[s >= s_cut]
            ids = [self.ids[self.starts[f] : self.starts[f + 1]] for f in found]
            ids = [x[x != query_ids[n]][:k] for x in ids]
            scores = np.repeat(s, [len(x) for x in ids])
            ids = np.concatenate(ids) if ids else self.ids[:0]
            first = np.lexsort((ids, -scores))[:k]
            out_q.append(np.full(len(first), n))
            out_i.append(ids[first])
            out_s.append(scores[first])
        return tuple(map(np.concatenate, (out_q, out_i, out_s))) if out_q else (np.zeros(0, int),) * 3


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), v.alias("d"))
    sound = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("d", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("d").isNotNull()).filter(sound).select("id", "v", F.size("v").alias("dim"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products for each row whose id is divisible by `every`.

    Candidates are all rows of other ids and equal length. Rows with a null id and vectors that are null, empty, zero or hold null or
    non-finite components take no part. Rows that share an id are candidates each. Other columns are ignored.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    stash = Stash(spark, "vptree")
    rows = stash.keep(_usable(vectors, id_col, vector_col))
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row for each vector length
    found = None
    shards = F.lit(0)
    for dim, n in sizes.items():
        shards = F.when(F.col("dim") == dim, F.pmod(F.xxhash64("id"), F.lit(-(-n * dim // SHARD_FLOATS)))).otherwise(shards)

    def make(key, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "tree": [build(group["id"].to_numpy(), np.stack(group["v"].to_numpy()))]})

    trees = stash.keep(rows.withColumn("shard", shards).groupBy("dim", "shard").applyInPandas(make, "dim int, tree binary"))
    queries = rows.filter(F.col("id") % every == 0)
    asked = {r["dim"]: r["count"] for r in queries.groupBy("dim").count().collect()}
    for dim, n in sorted(asked.items()):
        own, blocks = queries.filter(F.col("dim") == dim), -(-n // BLOCK)
        for block in range(blocks):
            part = own.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "v").toArrow()
            shared = spark.sparkContext.broadcast((part.column(0).to_numpy(), np.stack(part.column(1).to_pandas().to_numpy())) if len(part) else None)

            def search(batches, shared=shared):
                for batch in batches:
                    for blob in batch.column(1):
                        ids, q = shared.value
                        at, found, scores = Tree(blob.as_py()).search(ids, q, k, factor)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])

            if len(part):
                got = trees.filter(F.col("dim") == dim).mapInArrow(search, "query_id long, vec_id long, score double")
                found = got if found is None else found.union(got)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vptree_search(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))



ORACLE_SQL = {
    "op5_vptree_search": """
        with v as (select vec_id, embedding::double[] as e from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                     and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s as (select q.vec_id as query_id, c.vec_id as vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) as score
              from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e))
        select query_id, rank, vec_id, score from (
          select query_id, vec_id, score, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
        where rank <= 20"""
}
