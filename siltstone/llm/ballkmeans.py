"""Centroid clustering by ball k-means, exact in whole numbers.

A component x becomes floor(SCALE * x). A cluster is a ball: its centroid and a radius that no member exceeds. After a
round the centroids are exact means of their members, rounded down, and

* the neighbours of a ball are the centroids within twice its radius; no other centroid can be as near to a member;
* a member nearer to its centroid than half way to the nearest neighbour is in the stable core and stays;
* the others lie in annuli between half distances to the neighbours in ascending order, and a member is compared with
  those neighbours only whose half distance it reaches. All comparisons are of whole squared distances, so none is lost
  to rounding: a centroid with 4 * distance(member, own) < distance(own, other) is farther than its own, ties included.

Members are dealt as they come; a batch sends one row of sums, counts and radii for each of its clusters, so what
reaches the driver is one row a cluster. A round's assignment is a written table and replaces that of the round before.

Defined cases: vectors null, of another length, or with null or non-finite components take no part; larger components
than `most(dim)` / SCALE fail (squared distances would leave 64 bits); fewer vectors than clusters give fewer clusters;
equal distances go to the smaller number; an empty cluster keeps its centroid; rows may repeat, and repeated ids are
taken as initial centroids in the order of their vectors; a null id counts as the empty text there; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import lean
from .common import collecting, discard, materialise

SCALE = 256


def most(dim: int) -> int:
    """Components below this keep four squared distances within 63 bits."""
    return isqrt((1 << 59) // dim)


def whole_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, v array<double>) -> (id, x array<long>) of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long"))
    bounded = F.forall(v, lambda c: F.abs(c * SCALE) < most(dim))
    x = F.when(bounded, x).otherwise(F.raise_error(F.lit(f"a component times {SCALE} is {most(dim)} or more")).cast("array<long>"))
    return vectors.where((F.size(v) == dim) & finite).select("id", x.alias("x"))


def first_centroids(rows: DataFrame, k: int, dim: int, seed: str) -> np.ndarray:
    """The k vectors with smallest hash of `seed:id`, in this order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in first], np.int64).reshape(len(first), dim)


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances [a, b] of whole vectors."""
    out = np.empty((len(a), len(b)), np.int64)
    for j in range(len(b)):
        d = a - b[j]
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Balls:
    """Centroids with the neighbours of every ball, nearest first."""

    def __init__(self, centroids: np.ndarray, radius: np.ndarray | None = None):
        """radius: for every cluster no less than the distance of any member, rounded up; None: nothing is known yet."""
        self.centroids, self.apart = centroids, between(centroids, centroids)
        self.near = []
        for i in range(len(centroids)):
            order = np.lexsort((np.arange(len(centroids)), self.apart[i]))
            keep = [j for j in order if j != i and (radius is None or int(self.apart[i, j]) <= 4 * int(radius[i]) ** 2)]
            self.near.append(np.array(keep, np.int64))

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of members x of the clusters they had in the round before."""
        new, best = cluster.copy(), np.empty(len(x), np.int64)
        for i in np.unique(cluster):
            rows = np.flatnonzero(cluster == i)
            d = x[rows] - self.centroids[i]
            own = np.einsum("ij,ij->i", d, d)
            low, name = own.copy(), np.full(len(rows), i)
            for j in self.near[i]:
                reach = np.flatnonzero(4 * own >= self.apart[i, j])  # beyond half way to j: not core to it
                if not len(reach):
                    break  # farther neighbours are reached by none
                d = x[rows[reach]] - self.centroids[j]
                other = np.einsum("ij,ij->i", d, d)
                wins = (other < low[reach]) | ((other == low[reach]) & (j < name[reach]))
                low[reach[wins]], name[reach[wins]] = other[wins], j
            new[rows], best[rows] = name, low
        return new, best


def _whole(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _assigned(rows: DataFrame, balls: Balls) -> DataFrame:
    """Rows (id, x and, after the first round, cluster) with their nearest cluster and its squared distance."""
    known = "cluster" in rows.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _whole(b)
            before = b.column(b.schema.get_field_index("cluster")).to_numpy().astype(np.int64) if known else np.zeros(len(x), np.int64)
            cluster, distance = balls.assign(x, before)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "x", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, x array<long>, cluster int, distance long")


def _sums(assigned: DataFrame) -> list:
    """One row a cluster: its number of members, their sums by component and the largest distance. Batches are pre-added."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x, cluster, distance = _whole(b), b.column(b.schema.get_field_index("cluster")).to_numpy(), b.column(b.schema.get_field_index("distance")).to_numpy()
            names = np.unique(cluster)
            order = np.argsort(cluster, kind="stable")
            starts = np.searchsorted(cluster[order], names)
            sums = np.add.reduceat(x[order], starts, axis=0)
            far = np.maximum.reduceat(distance[order], starts)
            count = np.diff(np.append(starts, len(x)))
            yield pa.record_batch([pa.array(names, pa.int32()), pa.array(count, pa.int64()), pa.array(far, pa.int64()), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "far", "s"])

    part = assigned.select("x", "cluster", "distance").mapInArrow(run, "cluster int, n long, far long, s array<long>")
    part = part.select("cluster", "n", "far", F.posexplode("s").alias("i", "s"))
    added = part.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("s").alias("s"))
    return added.groupBy("cluster").agg(F.first("n").alias("n"), F.first("far").alias("far"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s")).collect()  # at most k rows


def _root(d: int) -> int:
    """The square root, rounded up."""
    r = isqrt(d)
    return r + (r * r < d)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2") -> DataFrame:
    """(id, v) -> id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    with collecting() as made:
        rows = materialise(whole_vectors(vectors, dim), "ballkmeans-vectors")
    centroids = first_centroids(rows, k, dim, seed)
    radius = None
    for round_ in range(rounds + 1):
        before = made
        with collecting() as made:
            rows = materialise(_assigned(rows, Balls(centroids, radius)), "ballkmeans-round")
        discard(spark, before)
        if round_ == rounds:
            break
        found, moved = {r.cluster: r for r in _sums(rows)}, centroids.copy()
        radius = np.zeros(len(centroids), object)
        for c, r in found.items():
            moved[c] = [s.s // r.n for s in r.s]
            step = moved[c] - centroids[c]
            radius[c] = _root(r.far) + _root(int((step * step).sum()))  # a member is no farther from where the centroid went
        centroids = moved
    inertia = {r.cluster: r.d for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), d) for i, d in enumerate(digest)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2") -> str:
    """DuckDB: the same rounds without balls, every vector against every centroid."""
    apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    kept = f"""x AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS k, x AS c
  FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM x ORDER BY h, x LIMIT {k}))"""
    steps = [kept]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(x) AS x, min({{'d': d, 'k': k}}) AS m
  FROM (SELECT n, vec_id, x, k, {apart} AS d FROM (SELECT row_number() OVER () AS n, * FROM x) CROSS JOIN c{r}) GROUP BY n, vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT k, coalesce(s, c) AS c FROM c{r} LEFT JOIN (
    SELECT kk, list(v ORDER BY i) AS s
    FROM (SELECT kk, i, (sum(v) // count(*) - CASE WHEN sum(v) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS v
          FROM (SELECT m.k AS kk, unnest(x) AS v, unnest(range({dim})) AS i FROM a{r}) GROUP BY kk, i) GROUP BY kk) ON k = kk)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, m.k AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia,
  (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON m.k = k"""
