"""Exact dense search: matrix products over blocks of vectors and blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised(df: DataFrame, vector: str) -> DataFrame:
    """Vectors scaled to length one; zero vectors stay."""
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn("__n", n).withColumn(vector, F.transform(vector, lambda x: F.when(F.col("__n") > 0, x / F.col("__n")).otherwise(x))).drop("__n")


def checked(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Fails the job on a vector of another dimension than the index's."""
    return df.where(F.assert_true(F.size(vector) == dim, F.lit(f"dimension is not {dim}")).isNull())


#: Queries whose scores are held at a time, and the places that scores are ranked by.
TILE, PLACES = 64, 9
#: Queries up to which they go to where the vectors are read.
FEW = 4_096


def best(score: np.ndarray, k: int) -> list[np.ndarray]:
    """The k columns of every row with the largest scores as they are rounded, ties to the first column; no infinite ones."""
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k] if k < n else np.full(len(score), -np.inf)
    out = []
    for row, low in zip(score, least, strict=True):
        c = np.flatnonzero((row >= low - 2 * 10.0**-PLACES) & np.isfinite(row))  # all that may be rounded to the k-th score
        out.append(c[np.argsort(-np.round(row[c], PLACES), kind="stable")[:k]])
    return out


def _found(ids: np.ndarray, a: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a block in order of their ids -> rows of queries, columns of vectors and scores: the k best of each query, TILE queries at a time."""
    rows, cols, out = [], [], []
    for at in range(0, len(q), TILE):
        t = q[at : at + TILE]
        score = t @ a.T
        if metric == "l2":
            score *= 2
            score -= (t * t).sum(1)[:, None]
            score -= (a * a).sum(1)
        score[own[at : at + TILE, None] == ids] = -np.inf
        for i, c in enumerate(best(score, k)):
            rows.append(np.full(len(c), at + i))
            cols.append(c)
            out.append(score[i, c] if metric == "ip" else -score[i, c])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(out)


def _matrix(t: pa.Table, c: str) -> np.ndarray:
    return t[c].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1)


def exact(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip", block_rows: int = 16_384, query_rows: int = 4_096) -> DataFrame:
    """vectors and queries (id, v) -> query_id, id, score, rank; metric ip (largest product first) or l2 (smallest squared distance first).

    Every block keeps k rows a query, so what is shuffled follows queries times blocks, not pairs. Up to FEW queries go to where the
    vectors are read, and no vector is shuffled; with more of them blocks of vectors meet blocks of queries. A query never finds its own id.
    """
    few = queries.select("id", "v").limit(FEW + 1).toArrow()
    found = _where_read(vectors, few, k, metric, block_rows) if few.num_rows <= FEW else _by_blocks(vectors, queries, k, metric, block_rows, query_rows)
    score = F.col("score").desc() if metric == "ip" else F.col("score").asc()
    w = Window.partitionBy("query_id").orderBy(score, "id")
    return found.withColumn("score", F.bround("score", PLACES)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _where_read(vectors: DataFrame, queries: pa.Table, k: int, metric: str, block_rows: int) -> DataFrame:
    """Each task searches what it reads, block_rows vectors at a time."""
    key = vectors.schema["id"].dataType.simpleString()

    def search(held: list[pa.RecordBatch], q: np.ndarray) -> pa.RecordBatch:
        x = pa.Table.from_batches(held)
        x = x.take(pa.array(np.argsort(x["id"].to_numpy(), kind="stable")))
        ids = x["id"].to_numpy()
        rows, cols, score = _found(ids, _matrix(x, "v"), queries["id"].to_numpy(), q, k, metric)
        pa.default_memory_pool().release_unused()
        return pa.record_batch([queries["id"].combine_chunks().take(pa.array(rows)), x["id"].combine_chunks().take(pa.array(cols)), pa.array(score)], ["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not queries.num_rows:
            return
        q, held, n = _matrix(queries, "v"), [], 0
        for b in batches:
            at = 0
            while at < len(b):
                held.append(b.slice(at, block_rows - n))
                at, n = at + len(held[-1]), n + len(held[-1])
                if n == block_rows:
                    yield search(held, q)
                    held, n = [], 0
        if n:
            yield search(held, q)

    return vectors.select("id", "v").mapInArrow(run, f"query_id {key}, id {key}, score double")


def _by_blocks(vectors: DataFrame, queries: DataFrame, k: int, metric: str, block_rows: int, query_rows: int) -> DataFrame:
    n, n_q = vectors.count(), queries.count()
    blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-n_q // query_rows))
    to = lambda d, m, name: d.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(m)).alias(name))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = to(vectors, blocks, "b").withColumn("qb", every(q_blocks))
    right = to(queries, q_blocks, "qb").withColumn("b", every(blocks)).select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("b").alias("b2"), F.col("qb").alias("qb2"))
    key = vectors.schema["id"].dataType.simpleString()

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        empty = {"query_id": x["id"].slice(0, 0), "id": x["id"].slice(0, 0), "score": pa.array([], pa.float64())}
        if not x.num_rows or not y.num_rows:
            return pa.table(empty)
        order = np.argsort(x["id"].to_numpy(), kind="stable")
        ids = x["id"].to_numpy()[order]
        rows, cols, score = _found(ids, _matrix(x, "v")[order], y["qid"].to_numpy(), _matrix(y, "qv"), k, metric)
        pa.default_memory_pool().release_unused()
        return pa.table({"query_id": y["qid"].take(pa.array(rows)), "id": pa.array(ids[cols]), "score": pa.array(score)})

    return left.groupBy("b", "qb").cogroup(right.groupBy("b2", "qb2")).applyInArrow(run, f"query_id {key}, id {key}, score double")
