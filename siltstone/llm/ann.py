"""Approximate nearest neighbours by a permutation index.

`n_pivots` vectors of a bounded sample (smallest hashed ids) serve as pivots, none within a cosine of 0.9
of another: copies of one vector would move by a rank as one and drown all other pivots. A vector is represented
by its `n_near` nearest pivots in order. Vectors are dealt to blocks; a block posts each vector, with
the pivot's rank, in the inverted file of each of its pivots. A query walks the files of its own
pivots and accumulates the footrule distance (a pivot missing from a list counts as rank n_near); the
`share` of a block that is nearest by footrule (`least` vectors at least) is reranked by exact cosine.
The best k of all blocks are the result.

A query meets every block of the index, in blocks of queries: the index grows by blocks, and so does
the work on each, never a list in memory. Every row is indexed. Recall against brute force is measured
in the tests (0.9 at least).

Defined cases: vectors null, empty, zero, of another dimension than the most frequent one or with null
or non-finite components take no part; equal scores go by the smaller id; a query has fewer than k
rows if fewer candidates exist; rows may repeat: a copy of the query's own id is no candidate, and a
repeated id may be found as often as it occurs; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of the sample that pivots are chosen from.
SAMPLE = 4096
#: Pivots stay below the first of these cosines that leaves half of n_pivots at least (vectors may all lie in a narrow cone).
LEVELS = (0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999, 0.9999, 0.99999, 0.999999)


def usable(vectors: DataFrame) -> DataFrame:
    """(id long, v array<double>) of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vectors.where(F.col("id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    common = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return ok.where(F.size("v") == (common.n if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


class Block:
    """The index of one block: vectors in ascending id order, and one inverted file per pivot."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, n_near: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.pivots, self.near = ids[order], vectors[order], pivots, n_near
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        lists = permutations(self.vectors, pivots, n_near)
        flat, rank = lists.ravel(), np.tile(np.arange(n_near, dtype=np.int32), len(ids))
        order = np.argsort(flat, kind="stable")
        starts = np.searchsorted(flat[order], np.arange(len(pivots) + 1))
        self.files = [(order[a:b] // n_near, rank[order[a:b]]) for a, b in zip(starts, starts[1:], strict=False)]

    def footrule(self, near: np.ndarray) -> np.ndarray:
        total = np.full(len(self.ids), self.near * (self.near + 1), np.int32)
        for rank, pivot in enumerate(near):
            rows, ranks = self.files[pivot]
            total[rows] += np.abs(ranks - rank) - (self.near - rank) - (self.near - ranks)
        return total

    def search(self, query_id: int, q: np.ndarray, near: np.ndarray, k: int, share: float, least: int) -> list[tuple[int, float]]:
        n = min(len(self.ids), max(least, int(np.ceil(share * len(self.ids)))))
        distance = self.footrule(near).astype(np.int64) * len(self.ids) + np.arange(len(self.ids))
        rows = np.argpartition(distance, n - 1)[:n] if n < len(self.ids) else np.arange(n)
        rows = rows[self.ids[rows] != query_id]
        score = (self.vectors[rows] * q).sum(1) / (self.norms[rows] * np.sqrt((q * q).sum()))
        best = np.lexsort((self.ids[rows], -score))[:k]
        return [(int(self.ids[rows[i]]), float(score[i])) for i in best]


def permutations(vectors: np.ndarray, pivots: np.ndarray, n_near: int) -> np.ndarray:
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :n_near]


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n unit vectors of the sample, first ones first, none close to one before it."""
    unit = sample / np.sqrt((sample * sample).sum(1, keepdims=True))
    for level in LEVELS:
        chosen: list[int] = []
        closest = np.full(len(unit), -2.0)
        while len(chosen) < n and len(free := np.flatnonzero(closest < level)):
            chosen.append(int(free[0]))
            closest = np.maximum(closest, unit @ unit[free[0]])
            closest[free[0]] = 2.0
        if 2 * len(chosen) >= n:
            break
    return unit[chosen]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, n_pivots: int = 128, n_near: int = 96, share: float = 0.1, least: int = 256, block_rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """(id, v) and queries (id, v) -> query_id, rank, vec_id, score."""
    vectors, spark = usable(vectors), vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, n_pivots)).select("v").toArrow()["v"].combine_chunks()  # SAMPLE vectors
    n, n_q = vectors.count(), queries.count()
    pivots = spread(matrix(sample), n_pivots) if len(sample) else np.zeros((0, 0))
    dim = pivots.shape[1]
    near = min(n_near, len(pivots))
    shared = spark.sparkContext.broadcast(pivots)
    blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-n_q // query_rows))
    index = vectors.withColumn("b", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)))
    index = index.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    asked = usable_as(queries, dim).withColumn("qb", F.pmod(F.xxhash64("id", F.lit("query")), F.lit(q_blocks)))
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            block = Block(left["id"].to_numpy(), matrix(left["v"].combine_chunks()), shared.value, near)
            ids, q = right["id"].to_numpy(), matrix(right["v"].combine_chunks())
            for i, row, lists in zip(ids, q, permutations(q, shared.value, near), strict=True):
                rows += [(int(i), *x) for x in block.search(int(i), row, lists, k, share, least)]
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = index.groupBy("b", "qb").cogroup(asked.groupBy("b", "qb")).applyInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable_as(queries: DataFrame, dim: int) -> DataFrame:
    """Queries of the index's dimension that take part, each id once."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return queries.where(F.col("id").isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)).dropDuplicates(["id"])


def columns(table: DataFrame, key: str, vector: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
