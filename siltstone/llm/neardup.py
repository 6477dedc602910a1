"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF word shingles.

Words are runs of letters and digits of the lower-cased text, shingles five words (all, if fewer). A
shingle weighs tf * idf with idf = 2 + ln(N / df) / ln(N), df counted over all N documents (a damped form: the rarest
shingle weighs half as much again as one in every document, whatever N is, so that a large group of copies,
whose common shingles are frequent only by these copies, stays alike). Two texts are linked if their weighted Jaccard similarity, sum of minima over sum of maxima, is at least 0.8;
equal texts are one text; a class is a connected component of links.

1. Documents are dealt to splits. Every split sends its shingle hashes, packed and pre-counted, to
   buckets of the hash range; a bucket adds the counts and answers each split with the shingles that
   occur in two documents or more. So a frequent shingle is one entry per split, never a row per document.
2. A text whose shared shingles hold less than 0.8 of its weight can have no link and is done (exact). For
   the others the shingles that no other document has are replaced by one element of their total weight:
   similarity and sampling distribution stay the same, and work falls to the shared shingles. Improved
   consistent weighted sampling gives 63 samples, banded 21 x 3: a pair at 0.8 is missed with probability 3e-7.
3. Texts that share buckets are chained to regions. A region is verified by exact weighted Jaccard, all pairs
   at once as matrix products over blocks of texts; a block gives each text one text that it is linked to, never
   its pairs. Regions of several blocks join their blocks' components by their heads first, and compare
   blocks in full only where components are still apart. No candidate is capped, and no link between classes is lost.

Defined cases: null counts as the empty text; texts without words are alike only if equal; rows may
repeat; a class is named by its smallest doc_id (null only if all are null); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import lean
from .common import hash128, materialise, small_batches
from .components import components
from .shared import pack, planes, shared_hashes, text_batches, unpack, unplanes
from .shingles import HASH_BITS, mix, shingles

BANDS, ROWS = 21, 3
SAMPLES = BANDS * ROWS
TABLE_BITS = 16
#: The least weight of a shingle: that of one in every document.
FLOOR = 2.0


class Sampler:
    """Improved consistent weighted sampling; the variates of (element, sample) come from fixed tables by hash."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = 1 << TABLE_BITS
        self.r, self.beta = rng.gamma(2, 1, n).astype(np.float32), rng.random(n, np.float32)
        self.inverse, self.log_c = (1 / self.r).astype(np.float32), np.log(rng.gamma(2, 1, n)).astype(np.float32)
        self.odd = rng.integers(1, 1 << 62, SAMPLES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, element: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sample hashes [SAMPLES, sets] of weighted sets, each a run of elements from its start on."""
        log_w = np.log(weight.astype(np.float32))
        index = np.arange(len(element), dtype=np.uint64)
        out = np.zeros((SAMPLES, len(starts)), np.uint64)
        for k in range(SAMPLES):
            i = (element * self.odd[k]) >> np.uint64(64 - TABLE_BITS)
            i = i.astype(np.int32)
            r, beta = self.r[i], self.beta[i]
            t = np.floor(log_w * self.inverse[i] + beta)
            log_a = self.log_c[i] - r * (t - beta + 1)
            bits = log_a.view(np.uint32)
            bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))  # unsigned, in the order of the floats
            best = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | index, starts) & np.uint64(0xFFFFFFFF)
            best = best.astype(np.int64)
            out[k] = mix(element[best] + mix(t[best].astype(np.int64).astype(np.uint64) + np.uint64(k)))
        return out


def signatures(docs: DataFrame, replies: DataFrame, n_docs: int, threshold: float, n_words: int) -> DataFrame:
    """(split, doc_id, t1, t2, text) and replies by split -> doc_id, t1, t2 and, for texts that can have links, w, size (shared shingles), bands, vec, val."""
    log_n = math.log(max(n_docs, 2))

    @lean
    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        h = np.concatenate([unplanes(x.as_py()) for x in right["h"]]) if right.num_rows else np.zeros(0, np.uint64)
        n = np.concatenate([unpack(x.as_py(), "<u8") for x in right["n"]]) if right.num_rows else np.zeros(0, np.uint64)
        order = np.argsort(h)
        h, idf = h[order], (FLOOR + np.log(n_docs / n[order].astype(np.float64)) / log_n).astype(np.float32)
        sampler, rows = Sampler(), left.num_rows
        lone = np.float32(FLOOR + math.log(n_docs) / log_n) if n_docs > 1 else np.float32(FLOOR)
        t1 = left["t1"].to_numpy().astype(np.int64)
        w_out, size, bands, vec, val = ([None] * rows for _ in range(5))
        for at, data, offsets in text_batches(left["text"]):
            doc, x, tf = shingles(data, offsets, n_words)
            place = np.minimum(np.searchsorted(h, x), max(len(h) - 1, 0))
            shared = (h[place] == x) if len(h) else np.zeros(len(x), bool)
            weight = tf.astype(np.float32) * (np.where(shared, idf[place], lone) if len(h) else lone)
            m = len(offsets) - 1
            total = np.bincount(doc, weight, m)
            common = np.bincount(doc[shared], weight[shared], m)
            able = (common > 0) & (common >= (threshold - 1e-6) * total)
            if not able.any():
                continue
            keep = shared & able[doc]
            doc, x, weight = doc[keep], x[keep], weight[keep]
            ids = np.flatnonzero(able)
            starts = np.searchsorted(doc, ids)
            ends = np.searchsorted(doc, ids, side="right")
            rest = (total - common)[ids]
            # one element stands for all shingles that no other document has
            own = mix(t1[at + ids].astype(np.uint64))
            some = rest > 1e-4 * total[ids]
            element, ww = np.insert(x << np.uint64(64 - HASH_BITS), ends[some], own[some]), np.insert(weight, ends[some], rest[some].astype(np.float32))
            shift = np.concatenate([[0], np.cumsum(some)[:-1]])
            got = sampler.samples(mix(element), ww, starts + shift)
            band = got.reshape(BANDS, ROWS, -1)
            key = np.zeros(band.shape[::2], np.uint64)
            for i in range(ROWS):
                key = mix(key + band[:, i])
            key = mix(key + np.arange(BANDS, dtype=np.uint64)[:, None]).astype(np.int64)
            for j, i in enumerate(ids):
                w_out[at + i], size[at + i], bands[at + i] = float(total[i]), int(ends[j] - starts[j]), key[:, j]
                vec[at + i], val[at + i] = planes(x[starts[j] : ends[j]]), pack(weight[starts[j] : ends[j]])
        return pa.table({"doc_id": left["doc_id"], "t1": left["t1"], "t2": left["t2"], "w": pa.array(w_out, pa.float64()), "size": pa.array(size, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())), "vec": pa.array(vec, pa.binary()), "val": pa.array(val, pa.binary())})

    return docs.groupBy("split").cogroup(replies.groupBy("split")).applyInArrow(sign, "doc_id long, t1 long, t2 long, w double, size long, bands array<long>, vec binary, val binary")


def overlaps(x: list[np.ndarray], v: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 1024) -> np.ndarray:
    """Sums of minima [left, right] of weighted sets: hashes x and weights v of every set.

    Every distinct weight of an element is a column worth its step over the next smaller one, and a set
    has the columns up to its own weight; so the sums are products of indicator matrices.
    """
    h, w = np.concatenate(x), np.concatenate(v)
    owner = np.repeat(np.arange(len(x), dtype=np.int32), [len(i) for i in x])
    order = np.lexsort((w, h))
    h, w, owner = h[order], w[order], owner[order]
    del order
    fresh = np.concatenate([[True], h[1:] != h[:-1]])
    del h
    column = np.concatenate([[True], fresh[1:] | (w[1:] != w[:-1])])
    at = np.flatnonzero(column)
    w = w[at].astype(np.float64)
    step = w - np.where(fresh[at], 0, np.concatenate([[0], w[:-1]]))
    number = np.cumsum(column, dtype=np.int32) - np.int32(1)
    below = number - number[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] + np.int32(1)  # columns of the element up to this weight
    ends = np.cumsum(below, dtype=np.int64)
    col = (np.repeat(number - below + 1 - (ends - below), below) + np.arange(int(ends[-1]))).astype(np.int32)
    row = np.repeat(owner, below)
    shared = np.bincount(col, minlength=len(at)) >= 2
    place = (np.cumsum(shared) - 1).astype(np.int32)
    keep = shared[col]
    col, row, step = place[col[keep]], row[keep], np.sqrt(step[shared])
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    del order, keep, place
    out = np.zeros((len(left), len(right)))
    dense = np.zeros((len(x), width))
    for lo in range(0, len(step), width):
        i, j = np.searchsorted(col, [lo, lo + width])
        dense[row[i:j], col[i:j] - lo] = step[col[i:j]]
        out += dense[left] @ dense[right].T
        dense[row[i:j], col[i:j] - lo] = 0
    return out


def _blocks(rows: DataFrame, texts: DataFrame, block: int, elements: int) -> DataFrame:
    """(t, region) with the texts' vectors, the number of blocks of their region and their own block i.

    A block has about `block` texts and `elements` vector elements at most, so a task's memory follows neither long texts nor regions.
    """
    rows = rows.join(texts.select("t", "size"), "t")
    need = F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("size") / F.lit(elements))
    sizes = rows.groupBy("region").agg(F.ceil(need).cast("int").alias("blocks"))
    r = rows.drop("size").join(sizes, "region").join(texts, "t")
    return r.withColumn("i", F.pmod(F.xxhash64("t", F.lit("block")), F.col("blocks")).cast("int"))


def _near(table: pa.Table, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether left and right rows are linked."""
    x = [unplanes(o.as_py()) for o in table["vec"]]
    m = overlaps(x, [unpack(o.as_py(), "<f4") for o in table["val"]], left, right)
    w = table["w"].to_numpy()
    return m >= (threshold - 1e-9) * (w[left][:, None] + w[right][None] - m)


def reached(near: np.ndarray) -> np.ndarray:
    """Component numbers of a symmetric link matrix, whole frontiers at a time."""
    number = np.full(len(near), -1)
    for i in range(len(near)):
        if number[i] < 0:
            front = np.array([i])
            while len(front):
                number[front] = i
                front = np.flatnonzero(near[front].any(axis=0) & (number < 0))
    return number


def joins(near: np.ndarray, left_root: np.ndarray, right_root: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that join roots, one for each join; roots are looked at group by group, not pair by pair."""
    parent: dict[int, int] = {}

    def find(r: int) -> int:
        while parent.setdefault(r, r) != r:
            r = parent[r]
        return r

    out = []
    for root in np.unique(left_root):
        rows = np.flatnonzero(left_root == root)
        columns = np.flatnonzero(near[rows].any(axis=0))
        for other, first in zip(*np.unique(right_root[columns], return_index=True), strict=True):
            p, q = find(int(root)), find(int(other))
            if p != q:
                parent[p] = q
                c = int(columns[first])
                out.append((int(rows[np.argmax(near[rows, c])]), c))
    return out


def _within(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(t, head): every text of a block with one text of its component in the block."""

    @lean
    def run(key: tuple, table: pa.Table) -> pa.Table:
        every = np.arange(table.num_rows)
        number = reached(_near(table, every, every, threshold)) if table.num_rows > 1 else every
        t = table["t"].combine_chunks()
        return pa.table({"t": t, "head": t.take(pa.array(number))})

    r = rows.select("region", "i", "t", "w", "vec", "val")
    return r.groupBy("region", "i").applyInArrow(run, f"t {kind}, head {kind}")


def _across(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(a, b): links between different blocks of a region, one for each join of two roots in a pair of blocks."""

    @lean
    def run(key: tuple, table: pa.Table) -> pa.Table:
        i = table["i"].to_numpy()
        left, right, root = np.flatnonzero(i == key[1].as_py()), np.flatnonzero(i == key[2].as_py()), table["root"].to_numpy()
        found = joins(_near(table, left, right, threshold), root[left], root[right]) if len(left) and len(right) else []
        t = table["t"].combine_chunks()
        return pa.table({"a": t.take(pa.array([left[a] for a, _ in found], pa.int64())), "b": t.take(pa.array([right[b] for _, b in found], pa.int64()))})

    r = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> j")
    r = r.select("region", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "t", F.xxhash64("root").alias("root"), "w", "vec", "val")
    return r.groupBy("region", "p", "q").applyInArrow(run, f"a {kind}, b {kind}")


def linked(banded: DataFrame, texts: DataFrame, threshold: float, block: int = 1000, elements: int = 1 << 19) -> DataFrame:
    """(t, band) and texts (t, w, size, vec, val) -> t, head: texts with one text of their component, for all that share a bucket.

    Texts that share buckets are chained to regions, and a region is verified in blocks of texts. A region of one
    block is done after `_within`. In a larger one the components' heads are compared first, which joins a
    group of close copies of any size; only between components that are still apart all pairs of blocks follow.
    """
    hubs = banded.groupBy("band").agg(F.min("t").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = banded.join(hubs, "band").where("t <> hub").select(F.col("t").alias("a"), F.col("hub").alias("b"))
    region = components(edges, "neardup-regions").select(F.col("node").alias("t"), F.col("root").alias("region"))
    kind = texts.schema["t"].dataType.simpleString()
    rows = materialise(_blocks(region, texts, block, elements), "neardup-blocks")
    heads = materialise(_within(rows, threshold, kind), "neardup-heads")
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return heads
    some = large.select("t", "region").join(heads, "t")
    tops = some.select(F.col("head").alias("t"), "region").distinct()
    links = _within(_blocks(tops, texts, block, elements), threshold, kind).select(F.col("t").alias("a"), F.col("head").alias("b"))
    joins = materialise(links.union(some.select(F.col("t").alias("a"), F.col("head").alias("b"))), "neardup-joins")
    root = components(joins, "neardup-roots")
    open_ = large.join(root, F.col("t") == F.col("node"), "left").withColumn("root", F.coalesce("root", "t")).drop("node")
    apart = open_.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("region")
    more = _across(open_.join(apart, "region"), threshold, kind)
    final = components(joins.union(more), "neardup-roots").select(F.col("node").alias("t"), F.col("root").alias("head"))
    small = heads.join(large.select("t"), "t", "left_anti")
    return small.union(large.select("t").join(final, "t", "left").select("t", F.coalesce("head", "t").alias("head")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n_words: int = 5, split_chars: int = 4 << 20, bucket_chars: int = 8 << 20) -> DataFrame:
    """(doc_id, text) -> doc_id, t1, t2 (the text's 128-bit hash), class_id: one row per document."""
    text = F.coalesce("text", F.lit(""))
    small_batches(docs.sparkSession)
    n_docs, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    splits, buckets = max(1, chars // split_chars), max(1, chars // bucket_chars)
    t1, t2 = hash128(text)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.lower(text).alias("text"))
    # equal texts go to one split unless there are many: their copies spread by id
    d = d.withColumn("split", F.pmod(F.xxhash64("t1", "doc_id"), F.lit(splits)))
    signed = materialise(signatures(d, shared_hashes(d, buckets, lambda data, offsets: shingles(data, offsets, n_words)[1], HASH_BITS), max(n_docs, 1), threshold, n_words), "neardup-signed")
    key = F.struct("t1", "t2").alias("t")
    able = signed.where("bands is not null")
    texts = able.groupBy(key).agg(*(F.first(c).alias(c) for c in ("w", "size", "vec", "val")))
    texts = materialise(texts, "neardup-texts")
    banded = able.select(key, "bands").dropDuplicates(["t"]).select("t", F.explode("bands").alias("band"))
    heads = linked(banded, texts, threshold)
    names = signed.groupBy(key).agg(F.min("doc_id").alias("lowest")).join(heads, "t", "left")
    names = names.select(F.col("t.t1").alias("t1"), F.col("t.t2").alias("t2"), F.coalesce("head", "t").alias("root"), "lowest")
    classes = names.groupBy("root").agg(F.min("lowest").alias("class_id"))
    named = names.join(classes, "root").select("t1", "t2", "class_id")
    return signed.select("doc_id", "t1", "t2").join(named, ["t1", "t2"]).select("doc_id", "t1", "t2", "class_id")
