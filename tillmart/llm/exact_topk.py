"""Exact top-k by inner product with KD-trees per shard.

Vectors are dealt by hash into shards of bounded size. A task cuts each shard by median splits into leaves with tight
bounding boxes; the largest inner product a query can have inside a box bounds its leaf. Searching goes over blocks of
queries and groups of shards, both of bounded size: trees best-first by the bound of their roots, and in each tree the
leaves best-first per query, leaving out those whose bound is under the k-th score so far, which is carried from leaf to
leaf and tree to tree. The groups' results are merged by rank.

The stated queries meet all rows in blocks. In many dimensions boxes bound little; the result is exact all the same.

Defined cases: a vector that is null, or holds a null or a component that is not finite, takes no part, and neither does
one with a null id; vectors meet only vectors of equal length; rows with the query's id are its own and no candidates,
so repeated rows do not find each other, and a query row repeated exactly counts once; ties go to the smaller id; an
empty table gives an empty one; a score beyond a long raises an error; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillmart.deploy import ship

from .storage import stored

SHARD, LEAF, GROUP, BLOCK = 2048, 128, 8, 2048
EXACT = float(1 << 53)


def quantized(vector: Column) -> Column:
    """floor(64 * x) of each component, x as double; null for a vector that takes no part."""
    values = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(values, lambda x: F.floor(x * 64).cast("double")))


def _leaves(frame: pd.DataFrame) -> pd.DataFrame:
    """One shard as the leaves of a KD-tree."""
    vectors = np.stack(frame["vector"].to_numpy()).astype(np.float64)
    ids, out = frame["id"].to_numpy(), []
    open_nodes = [np.arange(len(ids))]
    while open_nodes:
        rows = open_nodes.pop()
        inside = vectors[rows]
        low, high = (inside.min(axis=0), inside.max(axis=0)) if inside.shape[1] else (np.empty(0), np.empty(0))
        if len(rows) <= LEAF or not len(low) or (high == low).all():
            for a in range(0, len(rows), LEAF):
                out.append((ids[rows[a:a + LEAF]], vectors[rows[a:a + LEAF]].ravel(), low, high))
            continue
        order = np.argsort(inside[:, int(np.argmax(high - low))], kind="stable")
        half = len(rows) // 2
        open_nodes += [rows[order[:half]], rows[order[half:]]]
    first = frame.iloc[0]
    return pd.DataFrame({"dim": int(first["dim"]), "shard": int(first["shard"]), "ids": [o[0] for o in out],
                         "vectors": [o[1] for o in out], "low": [o[2] for o in out], "high": [o[3] for o in out]})


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with a point of each box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class _Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.found = np.empty(0, np.int64), np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.floor = np.full(len(ids), -np.inf)  # the k-th score
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, query: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        self.waiting.append((query, found, score))

    def settle(self) -> None:
        if not self.waiting:
            return
        query, found, score = (np.concatenate([old, *new]) for old, new in zip(
            (self.query, self.found, self.score), zip(*self.waiting)))
        self.waiting = []
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        starts = np.searchsorted(query, query, "left")
        place = np.arange(len(query)) - starts
        last = place == self.k - 1
        self.floor[query[last]] = score[last]
        kept = place < self.k
        self.query, self.found, self.score = query[kept], found[kept], score[kept]


def _scores(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in queries], object).reshape(queries.shape)
    other = np.array([[int(x) for x in row] for row in vectors], object).reshape(vectors.shape)
    return (whole @ other.T).astype(np.int64)  # raises an error beyond a long


def _searcher(k: int):
    def search(key: tuple, block: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "same": [], "id": [], "score": []}).astype("int64")
        if not len(block) or not len(leaves):
            return empty
        dim = int(key[0])
        queries = np.stack(block["vector"].to_numpy()).astype(np.float64).reshape(len(block), dim)
        ids = block["id"].to_numpy(np.int64)
        low, high = (np.stack(leaves[c].to_numpy()).reshape(len(leaves), dim) for c in ("low", "high"))
        largest = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * np.abs(queries).max(initial=0) * dim
        exact = largest < EXACT
        bounds = _bounds(queries, low, high) if exact else np.full((len(queries), len(leaves)), np.inf)
        shards = leaves["shard"].to_numpy()
        trees = [np.flatnonzero(shards == s) for s in np.unique(shards)]
        best = _Best(ids, k)
        for tree in sorted(trees, key=lambda t: -float(bounds[:, t].max(axis=1).mean())):
            order = np.argsort(-bounds[:, tree], axis=1, kind="stable")
            for step in range(len(tree)):  # each query's next best leaf
                leaf = tree[order[:, step]]
                live = np.flatnonzero(bounds[np.arange(len(queries)), leaf] >= best.floor)
                if not len(live):
                    break
                for one in np.unique(leaf[live]):
                    rows = live[leaf[live] == one]
                    there = np.asarray(leaves["ids"].iloc[one], np.int64)
                    scores = _scores(queries[rows], np.asarray(leaves["vectors"].iloc[one]).reshape(len(there), dim), exact)
                    good = (scores >= best.floor[rows][:, None]) & (there[None, :] != ids[rows][:, None])
                    q, v = np.nonzero(good)
                    best.offer(rows[q], there[v], scores[q, v])
                best.settle()
        best.settle()
        return pd.DataFrame({"query": ids[best.query], "same": block["same"].to_numpy(np.int64)[best.query],
                             "id": best.found, "score": best.score})

    return search


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "vector"
          ) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for each query row; components are whole numbers as doubles."""
    ship(vectors.sparkSession)

    def rows(df: DataFrame) -> DataFrame:
        out = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))
        return out.filter("id is not null and vector is not null").select("id", "vector", F.size("vector").alias("dim"))

    points = rows(vectors)
    asked = stored(rows(queries).withColumn("same", F.xxhash64("vector")).dropDuplicates(["id", "same", "dim"]), "queries")
    shards = max(1, -(-points.count() * 3 // (2 * SHARD)))
    blocks = max(1, -(-asked.count() * 3 // (2 * BLOCK)))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int"))
    leaves = stored(dealt.groupBy("dim", "shard").applyInPandas(
        _leaves, "dim int, shard int, ids array<long>, vectors array<double>, low array<double>, high array<double>"),
        "kd-trees")
    left = (asked.withColumn("block", F.pmod(F.xxhash64("id", "same", F.lit(1)), F.lit(blocks)).cast("int"))
            .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // GROUP)))))
    right = (leaves.withColumn("group", (F.col("shard") / GROUP).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    by = ["dim", "block", "group"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(
        _searcher(k), "query long, same long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query", "same").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20
"""
