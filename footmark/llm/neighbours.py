"""Nearest neighbours by inner product with one vantage-point tree per shard.

Vectors are dealt to shards by a hash of their id.  Within a shard each vector gets one more component that brings
all to the same length, so that the largest inner product is the smallest Euclidean distance and the triangle
inequality holds.  A side of a node is skipped when |distance to the vantage point - radius| > factor * (distance of
the k-th neighbour so far): factor 1 is exact, smaller factors skip more.  All queries of a shard go down the tree
together, as numpy arrays.  Scores are sums over components in order, in double precision, on the original vectors.

The queries are a stated part of the rows, in blocks, against all shards; the k best of each shard are merged.

Nulls and edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows with a null id; vectors are compared with those of the same number of components; of rows with one id the
smallest vector counts; ties go to the smaller id; with fewer than k candidates all are returned; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footmark.llm.common import arrow_map

NEAR = 1e-9  # scores closer than this are compared by their exact sums


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


class Tree:
    """A vantage-point tree over the rows of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 512):
        self.ids, self.vectors, self.leaf = ids, vectors, leaf
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(norms.max())
        self.lifted = np.c_[vectors, np.sqrt(np.maximum(self.top - norms, 0))]
        self.root = self.grow(np.arange(len(ids)))

    def grow(self, rows: np.ndarray):
        if len(rows) > self.leaf:
            center = self.lifted[rows[len(rows) // 2]]
            far = np.linalg.norm(self.lifted[rows] - center, axis=1)
            radius = float(np.median(far))
            inside = far < radius
            if inside.any():  # else most rows are the same vector: one leaf
                return center, radius, self.grow(rows[inside]), self.grow(rows[~inside])
        return rows

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float):
        """(query row, id, score) of the k nearest of each query, its own id left out."""
        self.own, self.queries, self.k, self.factor = own, queries, k, factor
        self.lifted_queries = np.c_[queries, np.zeros(len(queries))]
        self.lengths = np.einsum("ij,ij->i", queries, queries) + self.top
        self.kth = np.full(len(queries), -np.inf)
        self.near = np.full((len(queries), k), -1, np.int64)  # ids and scores of the nearest so far, best first
        self.score = np.full((len(queries), k), -np.inf)
        self.visit(self.root, np.arange(len(queries)))
        row, place = np.nonzero(self.score > -np.inf)
        return row, self.near[row, place], self.score[row, place]

    def visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self.scan(node, active)
            return
        center, radius, inside, outside = node
        gap = np.linalg.norm(self.lifted_queries[active] - center, axis=1) - radius
        self.visit(inside, active[gap < 0])
        self.visit(outside, active[gap >= 0])
        reach = np.sqrt(np.maximum(self.lengths[active] - 2 * self.kth[active], 0)) * self.factor + NEAR
        open_ = np.abs(gap) <= reach
        self.visit(outside, active[(gap < 0) & open_])
        self.visit(inside, active[(gap >= 0) & open_])

    def scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        close = self.queries[active] @ self.vectors[rows].T
        hit = (close >= self.kth[active, None] - NEAR) & (self.own[active, None] != self.ids[rows][None, :])
        if len(rows) > 4 * self.k and len(active):  # only those that can be among the k nearest of this leaf
            close[~hit] = -np.inf
            hit &= close >= np.partition(close, -self.k, axis=1)[:, -self.k, None] - NEAR
        q, c = np.nonzero(hit)
        if not len(q):
            return
        q, c = active[q], rows[c]
        met, own = np.unique(q, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(met)), self.k), own])
        ids = np.concatenate([self.near[met].ravel(), self.ids[c]])
        score = np.concatenate([self.score[met].ravel(), inner(self.queries[q], self.vectors[c])])
        order = np.lexsort((ids, -score, row))
        best = order[np.searchsorted(row[order], np.arange(len(met)))[:, None] + np.arange(self.k)]
        self.near[met], self.score[met] = ids[best], score[best]
        self.kth[met] = self.score[met, -1]


def smallest_per_id(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
    return ids[first], vectors[first]


def runs_of(batches):
    """(dims, shard, is query, ids, vectors) for each run of rows with one key."""
    for batch in batches:
        dims, shard, kind = (batch.column(n).to_numpy() for n in ("dims", "shard", "is_query"))
        ids, vectors = batch.column("vec_id").to_numpy(), batch.column("vector")
        edge = np.flatnonzero(np.r_[True, (np.diff(dims) != 0) | (np.diff(shard) != 0) | (np.diff(kind) != 0), True])
        for a, b in zip(edge[:-1], edge[1:]):
            part = vectors.slice(a, b - a).flatten().to_numpy().reshape(b - a, dims[a])
            yield dims[a], shard[a], kind[a], ids[a:b], part


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, per_shard: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for each row that ``is_query`` names, against all rows but those of its id."""
    rows = (vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
            .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("q"))
            .withColumn("dims", F.size("vector")))
    n = rows.count()
    shards = max(1, -(-n // per_shard))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    base = rows.select("dims", shard.alias("shard"), F.lit(0).alias("is_query"), "vec_id", "vector")
    asked = rows.where("q").groupBy("dims", "vec_id").agg(F.min("vector").alias("vector"))
    asked = asked.select("dims", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("is_query"),
                         "vec_id", "vector")
    keyed = base.unionByName(asked).repartition(shards, "dims", "shard").sortWithinPartitions("dims", "shard", "is_query")

    def work(batches):
        key, tree, held = None, None, []
        for dims, part, query, ids, vectors in runs_of(batches):
            if (dims, part) != key:
                key, tree, held = (dims, part), None, []
            if not query:
                held.append((ids, vectors))
                continue
            if tree is None:
                if not held:
                    continue
                tree = Tree(*smallest_per_id(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])))
                held = []
            for at in range(0, len(ids), 512):
                row, found, score = tree.search(ids[at:at + 512], vectors[at:at + 512], k, factor)
                yield {"query_id": ids[at:at + 512][row], "vec_id": found, "score": score}

    found = arrow_map(keyed, work, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
