"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed byte n-grams of the lower-cased text, present or absent in a whole text. On a
bounded sample of labelled texts (`most_rows` distinct rows, smallest hash of id and text first) executors count in how
many toxic and other texts each feature occurs. A feature whose rates differ by z standard errors has the
ratio r = log(p / q) of smoothed rates, shrunk by z^2 / (z^2 + half_z^2), so that chance weighs little; below
`least_z`, about the usual 5 % level, a difference is none. A ridge logistic regression is fitted to
presence * r on the driver by Newton steps, each solved by conjugate gradients over the sparse presences.
No feature beyond that level is cut, however many there are (2^BITS at most).

Scoring reads every byte of every text, in blocks, and looks n-grams up in one table; nothing shuffles.

Defined cases: a null or empty text has no features and scores the model's intercept; rows and ids may repeat (training takes each
distinct row once); a label other than 0 and 1 is no label, several labels of one id count as toxic if one does; without labelled rows
of both classes the score is the share of toxic ones (0 without any); extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, flat, grams, lean
from .common import materialise, small_batches

BITS = 20
ORDERS = (4, 5, 6)
THREADS = 4  # of the regression on the driver


@dataclass
class Model:
    table: np.ndarray  # hash -> feature number + 1, 0 for none
    weights: np.ndarray  # regression weight times ratio
    bias: float


def hits(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of all n-grams in the table, each pair once, in ascending order.

    Bytes are read in blocks. A repeated feature of a text is told by the text in which each feature was last found, and
    within a block by the last place written for it, so that only different features are kept and sorted.
    """
    begins, ends = offsets[:-1], offsets[1:]
    last = np.full(int(table.max(initial=0)), -1, np.int64)
    place = np.zeros(len(last), np.int32)
    features: list[np.ndarray] = [np.zeros(0, np.int32)] * len(ends)
    for at in range(0, len(data), block):
        here = np.arange(np.searchsorted(ends, at, side="right"), np.searchsorted(begins, min(at + block, len(data))))
        found = []
        for n in ORDERS:
            f = table[grams(data[at : at + block + n - 1], n, BITS)]
            pos = np.flatnonzero(f)
            runs = np.searchsorted(pos, begins[here] - at), np.searchsorted(pos, ends[here] - n + 1 - at)
            found.append((f[pos] - 1, *runs))
        for k, i in enumerate(here):
            ids = np.concatenate([f[lo[k] : max(lo[k], hi[k])] for f, lo, hi in found])
            ids = ids[last[ids] != i]
            number = np.arange(len(ids), dtype=np.int32)
            place[ids] = number
            ids = ids[place[ids] == number]
            last[ids] = i
            features[i] = np.sort(np.concatenate([features[i], ids]))
    counts = np.array([len(f) for f in features], np.int64)
    return np.repeat(np.arange(len(ends)), counts), np.concatenate([np.zeros(0, np.int32), *features])


def packed(ascending: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences, about a byte each: what the driver gets of a row."""
    return zlib.compress(np.diff(ascending, prepend=0).astype("<i4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int32)


def presence(texts: DataFrame) -> DataFrame:
    """(text, y) -> (feature, pos, neg): in how many texts of each class a feature occurs."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for part in chunks(b, 0):
                data, offsets = flat(part.column(0))
                for i, y in enumerate(part.column(1).to_pylist()):
                    for n in ORDERS:
                        total[y][np.unique(grams(data[offsets[i] : offsets[i + 1]], n, BITS))] += 1
        some = np.flatnonzero(total.sum(0))
        for at in range(0, len(some), 100_000):
            s = some[at : at + 100_000]
            yield pa.record_batch({"feature": s, "pos": total[1][s], "neg": total[0][s]})

    return texts.select("text", F.col("y").cast("int")).mapInArrow(count, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


class Runs:
    """Runs of an index array between neighbouring starts. `sums(source)` adds up source[index] over each run.

    Runs are worked through in blocks of about `block` elements by a few threads (numpy
    lets go of the interpreter there); no array of all elements in doubles is made, and a sum does not depend on the threads.
    """

    def __init__(self, index: np.ndarray, starts: np.ndarray, pool: ThreadPoolExecutor, block: int = 1 << 19):
        self.index, self.starts, self.pool, self.cuts = index, starts, pool, [0]
        while self.cuts[-1] < len(starts) - 1:
            i = self.cuts[-1]
            self.cuts.append(max(i + 1, int(np.searchsorted(starts, starts[i] + block, side="right")) - 1))

    def sums(self, source: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.starts) - 1)

        def add(i: int, j: int) -> None:
            starts = self.starts[i : j + 1]
            some = starts[1:] > starts[:-1]
            if some.any():
                values = np.take(source, self.index[starts[0] : starts[-1]], mode="clip")  # clip: no copy to check bounds
                out[i:j][some] = np.add.reduceat(values, (starts[:-1] - starts[0])[some])

        list(self.pool.map(add, self.cuts[:-1], self.cuts[1:]))
        return out


def dot(a: np.ndarray, b: np.ndarray) -> float:
    """Inner product without BLAS, whose threads wait in busy loops between such short calls."""
    return float((a * b).sum())


def by_feature_order(starts: np.ndarray, feature: np.ndarray, m: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ends): the rows that hold feature 0, then 1, ..., and where these runs end and start; sorted block by block in place."""
    count = np.zeros(m, np.int64)
    for at in range(0, len(feature), block):
        count += np.bincount(feature[at : at + block], minlength=m)
    ends = np.concatenate([[0], np.cumsum(count)])
    out, free = np.empty(len(feature), np.int32), ends[:-1].copy()
    for at in range(0, len(feature), block):
        f = feature[at : at + block]
        order = np.argsort(f, kind="stable")
        some, first, n = np.unique(f[order], return_index=True, return_counts=True)
        to = np.repeat(free[some] - first, n) + np.arange(len(f))
        out[to] = np.searchsorted(starts, at + order, side="right") - 1
        free[some] += n
    return out, ends


def newton(starts: np.ndarray, feature: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30, inner: int = 200) -> tuple[np.ndarray, float]:
    """Ridge logistic regression, weights and an unpenalised intercept, on x[row, f] = scale[f] for the features of each row.

    The features of a row are a run of `feature` between two starts; they are kept by rows and by features, never as a matrix.
    """
    with ThreadPoolExecutor(THREADS) as pool:
        return _newton(starts, feature, scale, y, ridge, steps, inner, pool)


def _newton(starts, feature, scale, y, ridge, steps, inner, pool) -> tuple[np.ndarray, float]:
    m = len(scale)
    row, ends = by_feature_order(starts, feature, m)
    by_row, by_feature = Runs(feature, starts, pool), Runs(row, ends, pool)
    penalty = np.append(np.full(m, ridge), 1e-6)

    def times(v: np.ndarray) -> np.ndarray:
        return by_row.sums(v[:m] * scale) + v[m]

    def back(u: np.ndarray) -> np.ndarray:
        return np.append(scale * by_feature.sums(u), u.sum())

    def loss(w: np.ndarray, z: np.ndarray) -> float:
        return float(np.logaddexp(0, z).sum() - dot(y, z) + 0.5 * (penalty * w * w).sum())

    w, z = np.zeros(m + 1), np.zeros(len(y))
    square = np.append(scale * scale, 1.0)
    now = first = loss(w, z)
    start = None
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        r = back(y - p) - penalty * w
        diagonal = square * np.append(by_feature.sums(s), s.sum()) + penalty
        step, d = np.zeros(m + 1), r / diagonal
        rd = dot(r, d)
        start = rd if start is None else start
        goal = min(0.01, rd / start) * rd  # loose steps first, tighter ones near the optimum
        for _ in range(inner):
            if rd <= goal:
                break
            hd = back(s * times(d)) + penalty * d
            at = rd / dot(d, hd)
            step += at * d
            r = r - at * hd
            fresh = r / diagonal
            rd, old = dot(r, fresh), rd
            d = fresh + rd / old * d
        dz = times(step)
        t = 1.0
        while t > 1e-6 and (new := loss(w + t * step, z + t * dz)) > now:
            t /= 2
        if t <= 1e-6:
            break
        w, z, gain, now = w + t * step, z + t * dz, now - new, new
        if gain <= 1e-6 * first:
            break
    return w[:m], float(w[m])


def training_rows(labelled: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(text, y) that a model learns from: the most_rows distinct rows of (doc_id, text) with the smallest hashes.

    Rows are bounded, not ids: an id may stand on any number of rows, and copies of a row are one. An id with both labels counts as 1.
    """
    spark = labelled.sparkSession
    y = labels.where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = labelled.where("doc_id is not null").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = texts.select("doc_id", "h").join(y, "doc_id").distinct().orderBy("h", "doc_id").limit(most_rows)
    chosen = spark.createDataFrame(chosen.toPandas(), chosen.schema)  # at most most_rows rows of numbers
    return texts.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("text", "y")


def train(labelled: DataFrame, labels: DataFrame, most_rows: int = 20_000, least_z: float = 2.0, half_z: float = 10.0, smoothing: float = 1.0, ridge: float = 1.0) -> Model:
    """Model from texts (doc_id, text) and labels (doc_id, y 0/1); only ids in both count."""
    spark = labelled.sparkSession
    table = np.zeros(1 << BITS, np.int32)
    sample = materialise(training_rows(labelled, labels, most_rows), "toxicity-sample")  # most_rows texts at most, read three times
    sizes = sample.groupBy("y").count().toPandas().set_index("y")["count"]
    n1, n0 = int(sizes.get(1, 0)), int(sizes.get(0, 0))
    prior = n1 / (n1 + n0) if n1 + n0 else 0.0
    bias = float(np.log((prior + 1e-4) / (1 - prior + 1e-4)))
    if not n1 or not n0:
        return Model(table, np.zeros(0), bias)
    p, q, r = F.col("pos") / n1, F.col("neg") / n0, (F.col("pos") + F.col("neg")) / (n1 + n0)
    z = (p - q) / F.sqrt(r * (1 - r) * (1 / n1 + 1 / n0))
    best = presence(sample).withColumn("z", F.when((r > 0) & (r < 1), z).otherwise(0.0)).where(F.abs("z") >= least_z)
    best = best.orderBy("feature").toPandas()  # 2^BITS rows of numbers at most
    if best.empty:
        return Model(table, np.zeros(0), bias)
    ratio = np.log(((best.pos + smoothing) / (n1 + 2 * smoothing)) / ((best.neg + smoothing) / (n0 + 2 * smoothing))).to_numpy()
    ratio *= (best.z**2 / (best.z**2 + half_z**2)).to_numpy()
    table[best.feature.to_numpy()] = np.arange(1, len(best) + 1)
    shared = spark.sparkContext.broadcast(table)

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(b, 0):
                doc, feature = hits(*flat(part.column(0)), shared.value)
                per = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.record_batch({"y": part.column(1).cast(pa.int32()), "n": per[1:] - per[:-1], "f": [packed(feature[per[i] : per[i + 1]]) for i in range(part.num_rows)]})

    got = sample.select("text", F.col("y").cast("int")).mapInArrow(rows, "y int, n long, f binary").toArrow()  # most_rows short rows
    y = got["y"].to_numpy().astype(float)
    starts = np.concatenate([[0], np.cumsum(got["n"].to_numpy())]).astype(np.int64)
    feature = np.empty(starts[-1], np.int32)
    for i, f in enumerate(got["f"]):
        feature[starts[i] : starts[i + 1]] = unpacked(f.as_py())
    del got
    w, bias = newton(starts, feature, ratio, y, ridge)
    return Model(table, w * ratio, bias)


def score(docs: DataFrame, model: Model, passed: str) -> DataFrame:
    """(doc_id, score) plus a passed boolean column, for every row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for part in chunks(b, 1):
                doc, feature = hits(*flat(part.column(1)), m.table)
                total = np.bincount(doc, m.weights[feature], part.num_rows) + m.bias
                yield pa.record_batch({"doc_id": part.column(0), passed: part.column(2), "score": 1 / (1 + np.exp(-np.clip(total, -500, 500)))})

    d = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text"), passed)
    return d.mapInArrow(run, f"doc_id long, {passed} boolean, score double")
