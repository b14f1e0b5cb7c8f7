"""Nearest neighbours by vantage-point trees, one for each shard of rows.

Rows are dealt into shards of bounded size; each shard's tree is built once and meets the queries block by block. A subtree is left
out when the triangle inequality shows that nothing in it can be nearer than the k-th neighbour so far. `factor` relaxes that test:
with 1 the search is exact, with smaller factors more is left out and some neighbours may be missed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import discard, materialize

SHARD_ROWS = 8192
QUERY_ROWS = 512
LEAF = 256
SLACK = 1e-9  # rounding in the bounds must not lose ties


class VPTree:
    """Points of one shard. Inner nodes split at the median distance to a vantage point; the vantage point stays in the inner half."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.points, self.leaf = points, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # of a few random points, the one whose distances spread most
        sample = self.points[self.rng.choice(rows, min(64, len(rows)), replace=False)]
        tries = self.rng.choice(rows, 4, replace=False)
        spread = [np.std(np.sqrt(((sample - self.points[t]) ** 2).sum(1))) for t in tries]
        v = tries[int(np.argmax(spread))]
        d = np.sqrt(((self.points[rows] - self.points[v]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = rows[order[:half]], rows[order[half:]]
        return (v, d[order[0]], d[order[half - 1]], d[order[half]], d[order[-1]], self._build(inner), self._build(outer))

    def search(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest points of each query but those that have its own id, ties to smaller ids; inf where there are none."""
        best = np.full((len(queries), k), np.inf)
        names = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                if not len(node):
                    return
                d = np.empty((len(q), len(node)))
                step = max(1, 4_000_000 // (len(node) * self.points.shape[1]))
                for i in range(0, len(q), step):
                    diff = queries[q[i : i + step], None, :] - self.points[None, node, :]
                    d[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
                d[ids[node][None, :] == own[q][:, None]] = np.inf
                d = np.concatenate([best[q], d], axis=1)
                n = np.concatenate([names[q], np.broadcast_to(ids[node], (len(q), len(node)))], axis=1)
                order = np.lexsort((n, d), axis=1)[:, :k]
                best[q], names[q] = np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)
                return
            v, in_lo, in_hi, out_lo, out_hi, inner, outer = node
            d = np.sqrt(((queries[q] - self.points[v]) ** 2).sum(1))
            low = {0: np.maximum(np.maximum(in_lo - d, d - in_hi), 0), 1: np.maximum(np.maximum(out_lo - d, d - out_hi), 0)}
            near_inner = low[0] <= low[1]
            for side, mine in ((0, near_inner), (1, ~near_inner), (1, near_inner), (0, ~near_inner)):
                # the bounds are looked at when their turn comes, as the first visits tighten them
                go = mine & (low[side] <= factor * best[q, k - 1] + SLACK)
                visit((inner, outer)[side], q[go])

        visit(self.root, np.arange(len(queries)))
        names[np.isinf(best)] = -1
        return best, names


def usable(vector: str | Column) -> Column:
    """Not null, not empty, without null or non-finite components, not zero."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _packed(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.collect_list(c).alias(c) for c in columns])


def knn(rows: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query by Euclidean distance, but the query's own id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor rows without an id. Vectors of another
    dimension are never neighbours. Repeated ids: each row stands for itself. An empty side gives an empty result.
    """
    def side(df: DataFrame) -> DataFrame:
        return df.where(usable(vector_column) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))

    rows, queries = side(rows).withColumn("dim", F.size("v")), side(queries).withColumn("dim", F.size("v"))
    n_rows, n_queries = rows.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_queries // query_rows))
    # dealt by the whole row, so that repeated ids spread too
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(blocks)).cast("int"))
    index = _packed(dealt, "shard", ["id", "v"])
    # a stated query set against all rows: each block of queries visits each shard
    asked = _packed(blocked, "block", ["id", "v"]).select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    met = index.join(asked.hint("shuffle_hash"), "shard") if shards > 1 else index.join(asked, "shard")

    def run(frames):
        kept, tree_of = None, {}
        for pdf in frames:
            for shard, ids, vs, qids, qvs in zip(pdf.shard, pdf.id, pdf.v, pdf.qid, pdf.qv):
                if shard != kept:
                    kept, ids, dims = shard, np.asarray(ids, np.int64), np.array([len(v) for v in vs])
                    tree_of = {d: (VPTree(np.stack(list(np.asarray(vs, object)[dims == d])).astype(float)), ids[dims == d]) for d in set(dims.tolist())}
                qids, qd = np.asarray(qids, np.int64), np.array([len(v) for v in qvs])
                for d in set(qd.tolist()) & set(tree_of):
                    q = np.stack(list(np.asarray(qvs, object)[qd == d])).astype(float)
                    tree, names = tree_of[d]
                    score, found = tree.search(q, names, qids[qd == d], k, factor)
                    for_query, place = np.nonzero(np.isfinite(score))
                    yield pd.DataFrame({"query_id": qids[qd == d][for_query], "vec_id": found[for_query, place], "score": score[for_query, place]})

    found = materialize(met.mapInPandas(run, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    discard(found)
    return out
