"""Language identification by a byte convolutional network, trained and applied in numpy.

A window of 256 bytes goes through filters of widths 2, 3 and 4 over one-hot bytes, a rectifier, max
pooling over the window and a softmax layer. A text is cut into windows that cover all its bytes (the
last one ends with the text and is padded if the text is shorter); its class probabilities are the
means over its windows, weighted by bytes.

Training: of every language the `per_language` texts with the smallest hashed ids (a bounded sample; languages are few),
of each up to `per_text` windows spread over the whole text; mini-batch Adam with a fixed seed. Max
pooling passes a gradient to one position per filter, so a step costs little more than a forward pass.

Applying: filters over byte pairs are tabulated, so that a convolution is one or two lookups a byte;
memory is bounded by a block of windows, whatever the length of a text. Nothing shuffles.

A network is sure of bytes that it never met, too. So `predict(fit=True)` adds the mean log-probability of a
text's bytes, each given the one before it, in the training windows of the language where it is highest: -ln 256 is chance.

Defined cases: a null text or one without a letter is `und` with score 0; without training rows
every text is; of equal probabilities the first language in order wins; rows and ids may repeat (training takes each distinct row once); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import chunks, flat, lean
from .common import small_batches

WIDTHS = (2, 3, 4)
SIZE = 256
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]  # per width: [width, 256, filters]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray
    pairs: np.ndarray | None = None  # [languages, 65536]: log-probability of a byte given the one before

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Per width: (offset, table) lookups; tables of 65536 rows take byte pairs, those of 256 bytes."""
        out = []
        for k in self.filters:
            parts = []
            for at in range(0, len(k), 2):
                pair = at + 1 < len(k)
                parts.append((at, np.ascontiguousarray((k[at][:, None] + k[at + 1][None]).reshape(65536, -1) if pair else k[at])))
            out.append(parts)
        return out

    def probabilities(self, windows: np.ndarray, tables) -> np.ndarray:
        pairs = (windows[:, :-1].astype(np.uint16) << 8) | windows[:, 1:]
        pooled = []
        for w, parts in zip(WIDTHS, tables, strict=True):
            n = SIZE - w + 1
            total = None
            for at, table in parts:
                x = np.take(table, (pairs if len(table) > 256 else windows)[:, at : at + n], axis=0)
                total = x if total is None else np.add(total, x, out=total)
            pooled.append(total.max(axis=1))
        h = np.maximum(np.hstack(pooled) + self.bias, 0)
        z = h @ self.dense + self.out
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of one text, and how many of its bytes each one counts for."""
    n = len(data)
    if n <= SIZE:
        w = np.zeros((1, SIZE), np.uint8)
        w[0, :n] = data
        return w, np.array([max(n, 1)], np.float64)
    full = n // SIZE
    w = data[: full * SIZE].reshape(full, SIZE)
    rest = n - full * SIZE
    if not rest:
        return w, np.full(full, float(SIZE))
    return np.vstack([w, data[None, n - SIZE :]]), np.append(np.full(full, float(SIZE)), rest)


def fit(windows: np.ndarray, y: np.ndarray, languages: list[str], n_filters: int = 8, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.1, (w, 256, n_filters)).astype(np.float32) for w in WIDTHS]
    hidden, classes = n_filters * len(WIDTHS), len(languages)
    bias = np.zeros(hidden, np.float32)
    dense = rng.normal(0, 0.2, (hidden, classes)).astype(np.float32)
    out = np.zeros(classes, np.float32)
    params = [*filters, bias, dense, out]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    cols = np.arange(n_filters)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, t = windows[pick], y[pick]
            pooled, where = [], []
            for w, k in zip(WIDTHS, filters, strict=True):
                n = SIZE - w + 1
                s = sum(k[j][x[:, j : j + n]] for j in range(w))
                a = s.argmax(axis=1)
                where.append(a)
                pooled.append(np.take_along_axis(s, a[:, None], axis=1)[:, 0])
            pre = np.hstack(pooled) + bias
            h = np.maximum(pre, 0)
            z = h @ dense + out
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(t)), t] -= 1
            p /= len(t)
            gh = (p @ dense.T) * (pre > 0)
            grads = [np.zeros_like(k) for k in filters] + [gh.sum(0), h.T @ p, p.sum(0)]
            for i, w in enumerate(WIDTHS):
                g = gh[:, i * n_filters : (i + 1) * n_filters]
                for j in range(w):
                    np.add.at(grads[i][j], (x[np.arange(len(x))[:, None], where[i] + j], cols[None]), g)
            step += 1
            for q, g, a, b in zip(params, grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model(languages, filters, bias, dense, out)


def byte_pairs(windows: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Smoothed log-probabilities of bytes given the byte before, per class; padding does not count."""
    out = []
    for i in range(n):
        w = windows[y == i].astype(np.int64)
        some = (w[:, :-1] > 0) & (w[:, 1:] > 0)
        count = np.bincount((w[:, :-1] * 256 + w[:, 1:])[some], minlength=65536).reshape(256, 256) + 0.5
        out.append(np.log(count / count.sum(1, keepdims=True)).ravel())
    return np.array(out, np.float32)


def fits(data: np.ndarray, offsets: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Mean log-probability of the byte pairs of each text in the language that has the highest; 0 for a text of one byte."""
    n = len(offsets) - 1
    if len(data) < 2:
        return np.zeros(n)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    inside = owner[1:] == owner[:-1]
    code, owner = ((data[:-1].astype(np.int32) << 8) | data[1:])[inside], owner[1:][inside]
    total = np.max([np.bincount(owner, p[code], n) for p in pairs], axis=0)
    return total / np.maximum(np.bincount(owner, minlength=n), 1)


def training_rows(labelled: DataFrame, per_language: int = 1000, most_languages: int = 200) -> DataFrame:
    """(lang, text) that a model learns from: per language the per_language distinct rows of (doc_id, text) with the smallest hashes.

    Only rows with a letter count, for the threshold on the hash too; rows are bounded, not ids, so an id may stand on
    any number of rows and copies of a row are one. More than most_languages languages: those with the most rows.
    """
    top = 1 << 40
    h = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(top)).alias("h")
    rows = labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", "text", h)
    # a threshold on the hash, from one sketch a language, leaves about twice the rows that are needed for the ranking
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages)
    limit = (F.least(F.lit(1.0), (2 * per_language + 100) / F.col("n")) * top).alias("limit")
    some = rows.select("lang", "h").join(F.broadcast(counts.select("lang", limit)), "lang").where("h < limit").select("lang", "h").distinct()
    w = Window.partitionBy("lang").orderBy("h")
    chosen = some.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language).select("lang", "h")
    chosen = labelled.sparkSession.createDataFrame(chosen.toPandas(), chosen.schema)  # per_language hashes of most_languages at most
    return rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")


def train(labelled: DataFrame, per_language: int = 1000, per_text: int = 4, most_languages: int = 200, **options) -> Model | None:
    """Model from (doc_id, text, lang); None without a text that has a language and a letter."""
    got = training_rows(labelled, per_language, most_languages)

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column(1))
            out, langs = [], []
            for i, lang in enumerate(b.column(0).to_pylist()):
                w, _ = windows_of(data[offsets[i] : offsets[i + 1]])
                for j in np.unique(np.linspace(0, len(w) - 1, per_text).astype(int)):
                    out.append(w[j].tobytes())
                    langs.append(lang)
            yield pa.record_batch({"lang": pa.array(langs, pa.string()), "w": pa.array(out, pa.binary())})

    got = got.mapInArrow(cut, "lang string, w binary").toPandas().sort_values(["lang", "w"], ignore_index=True)  # per_text windows of each
    if got.empty:
        return None
    languages = sorted(got.lang.unique())
    x = np.frombuffer(b"".join(got.w), np.uint8).reshape(-1, SIZE)
    y = got.lang.map({g: i for i, g in enumerate(languages)}).to_numpy()
    model = fit(x, y, languages, **options)
    model.pairs = byte_pairs(x, y, len(languages))
    return model


def predict(docs: DataFrame, model: Model | None, block: int = 512, fit: bool = False) -> DataFrame:
    """docs (doc_id, text, any passed columns) -> doc_id, passed columns, lang_pred, score and, if asked for, fit (columns of these names are replaced)."""
    small_batches(docs.sparkSession)
    passed = [c for c in docs.columns if c not in ("doc_id", "text", "lang_pred", "score", *["fit"] * fit)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("doc_id", *passed).schema

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tables = m.tables() if m else None
        for b in batches:
            for part in chunks(b, 0, 1 << 20):
                data, offsets = flat(part.column(0))
                lettered = np.array(part.column(1).to_pylist(), bool)
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if m and lettered.any():
                    docs_at = np.flatnonzero(lettered)
                    cut = [windows_of(data[offsets[i] : offsets[i + 1]]) for i in docs_at]
                    windows, share = np.vstack([c[0] for c in cut]), np.concatenate([c[1] for c in cut])
                    owner = np.repeat(np.arange(len(docs_at)), [len(c[0]) for c in cut])
                    total = np.zeros((len(docs_at), len(m.languages)))
                    for at in range(0, len(windows), block):
                        p = m.probabilities(windows[at : at + block], tables)
                        np.add.at(total, owner[at : at + block], p * share[at : at + block, None])
                    total /= total.sum(axis=1, keepdims=True)
                    best = total.argmax(axis=1)
                    for i, j, row in zip(docs_at, best, total, strict=True):
                        names[i], scores[i] = m.languages[j], min(1.0, row[j])
                added = {"lang_pred": pa.array(names), "score": pa.array(scores)}
                if fit:
                    added["fit"] = pa.array(fits(data, offsets, m.pairs) if m else np.zeros(part.num_rows))
                yield pa.record_batch([*part.columns[2:], *added.values()], names=[*part.schema.names[2:], *added])

    d = docs.select(F.coalesce("text", F.lit("")).alias("__text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter"), "doc_id", *passed)
    schema = schema.add("lang_pred", "string").add("score", "double")
    return d.mapInArrow(run, schema.add("fit", "double") if fit else schema)
