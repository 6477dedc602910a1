"""Rank fusion, score scaling and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The constant of reciprocal ranks and the weights of the two rankings.
RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 60, 0.3, 0.7


def candidate_pool(k: int, n: int | None = None) -> int:
    """How many candidates each ranker gives: ten times k, a hundred at least, all at most."""
    pool = max(100, 10 * k)
    return pool if n is None else min(pool, n)


def _part(weight, rank: Column) -> Column:
    return F.coalesce(weight / (RRF_K + rank), F.lit(0.0))


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, query: str, item: str, k: int | None, dense_weight=DENSE_WEIGHT, sparse_weight=SPARSE_WEIGHT, extra: tuple[str, ...] = ()) -> DataFrame:
    """Lists with ranks from 1 -> query, item, dense_rrf, sparse_rrf, score (6 places), rank by the unrounded score.

    An item absent from a list gets nothing from it. Weights may be columns of both lists, named in extra.
    """
    keys = [query, item, *extra]
    d, s = dense.select(*keys, F.col("rank").alias("__d")), sparse.select(*keys, F.col("rank").alias("__s"))
    both = d.join(s, keys, "full")
    a, b = _part(F.lit(dense_weight) if isinstance(dense_weight, float) else dense_weight, F.col("__d")), _part(F.lit(sparse_weight) if isinstance(sparse_weight, float) else sparse_weight, F.col("__s"))
    out = both.select(*keys, a.alias("__a"), b.alias("__b")).withColumn("__t", F.bround(F.col("__a") + F.col("__b"), 10))
    w = Window.partitionBy(query, *extra).orderBy(F.col("__t").desc(), item)
    out = out.withColumn("rank", F.row_number().over(w))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.select(*keys, F.bround("__a", 6).alias("dense_rrf"), F.bround("__b", 6).alias("sparse_rrf"), F.bround("__t", 6).alias("score"), "rank")


def preferred(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of either list by key, each field from the first list where it has one, else from the second."""
    names = [c for c in first.columns if c != key]
    a, b = first.alias("a"), second.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in names)).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col("__k"), "full")
    return both.select(F.coalesce(f"a.{key}", "__k").alias(key), *(F.coalesce(f"a.{c}", f"__{c}").alias(c) for c in names))


def min_max(df: DataFrame, query: str, score: str, low: float = 0.5, high: float = 1.0) -> DataFrame:
    """Scores of every query scaled to low..high; equal scores divide by a guard instead of zero."""
    w = Window.partitionBy(query)
    span = F.max(score).over(w) - F.min(score).over(w)
    return df.withColumn(score, low + (high - low) * (F.col(score) - F.min(score).over(w)) / F.when(span == 0, F.lit(1e-9)).otherwise(span))


def at_least(df: DataFrame, query: str, score: str, least: float) -> DataFrame:
    """Rows of at least that score; all rows of a query that has none."""
    passing = F.count_if(F.col(score) >= least).over(Window.partitionBy(query))
    return df.withColumn("__p", passing).where((F.col(score) >= least) | (F.col("__p") == 0)).drop("__p")


def token_overlap(question: Column, text: Column, tokens) -> Column:
    """The default scorer: share of the question's distinct tokens that the text has."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def rerank(candidates: DataFrame, query: str, k: int, scorer: Callable[[DataFrame], Column], candidate_k: int = 20, least: float | None = None, item: str = "chunk_id", label: str = "+rerank") -> DataFrame:
    """The first candidate_k rows scored anew; k stay, with rerank fields and the first method's name kept."""
    pool = candidates.where(F.col("rank") <= candidate_k)
    pool = pool.withColumn("__s", scorer(pool))
    if least is not None:
        pool = at_least(pool, query, "__s", least)
    w = Window.partitionBy(query).orderBy(F.col("__s").desc(), "rank", item)
    pool = pool.withColumn("rerank_rank", F.row_number().over(w)).where(F.col("rerank_rank") <= k)
    pool = pool.withColumns({"base_retrieval_method": F.col("retrieval_method"), "rerank_score": F.bround("__s", 6), "rank": F.col("rerank_rank")})
    return pool.withColumn("retrieval_method", F.concat("base_retrieval_method", F.lit(label))).drop("__s")


def weight_grid(steps: int = 9) -> list[tuple[float, float]]:
    """Coarse grid of weight pairs that sum to one: 0.1 to 0.9."""
    return [(round(i / (steps + 1), 2), round(1 - i / (steps + 1), 2)) for i in range(1, steps + 1)]


def fine_grid(best: float, seen: set[float], step: float = 0.05, reach: float = 0.10) -> list[tuple[float, float]]:
    """Weights within `reach` of the best coarse one that were not tried yet."""
    n = round(reach / step)
    near = [round(best + i * step, 2) for i in range(-n, n + 1)]
    return [(w, round(1 - w, 2)) for w in near if 0 < w < 1 and w not in seen]
