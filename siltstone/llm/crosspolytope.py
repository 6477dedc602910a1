"""Near-duplicate vectors of equal labels by cross-polytope hashing after fast Hadamard rotations.

1. Equal vectors of a label are one vector with a count.
2. A rotation is three rounds of random signs and a fast Hadamard transform; a vector's hash is the axis, with its sign, that the
   rotated vector is nearest to. A table joins `k` such hashes, and a vector is posted in the `PROBES` buckets of a table that it is
   nearest to (multiprobe). k follows from the number of vectors, so that a bucket holds few vectors by chance, and the number of tables
   from the chance, measured on random pairs at the threshold, that a table brings a pair together: a pair is missed with MISS at most.
3. Vectors within half the threshold's angle of one of them are linked to each other: a core, of which only this centre,
   its radius and its count go on. Cores are found in blocks of the vectors of a first bucket, and then among the centres
   of several blocks; so a group of close copies of any size becomes few cores, and no pair inside a core is ever looked at.
4. Vectors and cores that share buckets are compared block by block. Exact cosines in double precision decide between vectors;
   a link counts in the first table and bucket that its vectors share, so it counts once and pairs are never listed.
   Between cores the angle of the centres less or more the radii decides; what this leaves open is compared member by member.
5. Linked vectors and cores are chained to components.

What travels of a pair of vectors are counts by vector and one link to a member of its group. Working tables are written to the
shared folder. The joins that give members their core, rows their vector or component are salted.

Defined cases: vectors null, empty, zero or with null or non-finite components, and null labels, link with nothing; nor do vectors of
different length; rows may repeat, each counts; a null id names a component only if all its ids are null; -0.0 and 0.0 link by their
cosine like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import lean
from .common import attach, hash128, materialise, small_batches
from .components import components
from .shingles import mix

PROBES = 4
#: A pair at the threshold shares no bucket with this probability at most.
MISS = 1e-4
#: Random pairs that a table's chance is measured on.
TRIALS = 2000
#: Angles are only trusted this far where they decide instead of cosines.
SLACK = 1e-6
#: Buckets of up to this many entries are compared row shift by row shift, larger ones by matrix products.
FEW = 64
#: What a row found says: links of a vector, a link between members of components, two cores linked as a whole, two to compare by members.
COUNT, LINK, WHOLE, OPEN = range(4)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows whose length is a power of two, up to a factor."""
    n, h = x.shape[1], 1
    while h < n:
        pair = x.reshape(len(x), -1, 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def padded(dim: int) -> int:
    """Vectors are filled with zeros to a power of two; short ones to 64, as signs alone give few rotations of less."""
    return max(64, 1 << (dim - 1).bit_length())


@lru_cache(maxsize=4096)
def signs(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng([7, seed, n]).integers(0, 2, (3, n)) * 2.0 - 1.0


def axes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The PROBES nearest axes (2 * number + sign) of rotated unit vectors, and how much farther each is than the first."""
    n = padded(x.shape[1])
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    for s in signs(seed, n):
        y = hadamard(y * s) / math.sqrt(n)
    size = np.abs(y)
    order = np.argsort(-size, axis=1, kind="stable")[:, :PROBES]
    best = np.take_along_axis(size, order, 1)
    return 2 * order + (np.take_along_axis(y, order, 1) > 0), (best[:, :1] - best) ** 2


def table_keys(x: np.ndarray, k: int, table: int) -> np.ndarray:
    """[vectors, PROBES] bucket keys of a table, nearest first: combinations of axes by their summed distance."""
    found = [axes(x, table * 64 + j) for j in range(k)]
    keys, cost = np.zeros((len(x), 1), np.uint64), np.zeros((len(x), 1))
    for axis, more in found:
        sums = (cost[:, :, None] + more[:, None, :]).reshape(len(x), -1)
        codes = mix(keys[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + axis[:, None, :].astype(np.uint64) + np.uint64(1)).reshape(len(x), -1)
        order = np.argsort(sums, axis=1, kind="stable")[:, :PROBES]
        keys, cost = np.take_along_axis(codes, order, 1), np.take_along_axis(sums, order, 1)
    return keys


@lru_cache(maxsize=64)
def n_tables(dim: int, k: int, threshold: float) -> int:
    """Tables that bring a pair at the threshold together but for MISS."""
    if dim == 1:
        return 1
    rng = np.random.default_rng(11)
    a, z = rng.normal(size=(2, TRIALS, dim))
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.sqrt((z * z).sum(1, keepdims=True))
    b = threshold * a + math.sqrt(1 - threshold * threshold) * z
    p, q = table_keys(a, k, 0), table_keys(b, k, 0)
    met = (p[:, :, None] == q[:, None, :]).any(axis=(1, 2)).mean()
    met = min(max(met - 2 * math.sqrt(met * (1 - met) / TRIALS), 1e-3), 0.999)
    return math.ceil(math.log(MISS) / math.log(1 - met))


def n_hashes(n: int, dim: int) -> int:
    """Hashes a table joins, so that n vectors share a bucket by chance every other time at most."""
    ways, k = 2 * padded(dim), 1
    while k < 12 and 2 * n * PROBES > ways**k:
        k += 1
    return k


def buckets(x: np.ndarray, lab: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """[vectors, tables, PROBES] bucket keys of unit vectors, in which labels and lengths are mixed."""
    dim = x.shape[1]
    k = n_hashes(n, dim)
    base = mix(lab.astype(np.int64).view(np.uint64) + np.uint64(dim))[:, None]
    return np.stack([mix(table_keys(x, k, t) + base + np.uint64(t)) for t in range(n_tables(dim, k, threshold))], 1).view(np.int64)


def units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of vector in a column; lengths do not overflow or vanish on the way."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)]
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])  # exact, so that squares stay in range
        yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


def distinct(vectors: DataFrame) -> DataFrame:
    """(t, lab, v) of rows that take part, t null for the others; t is the identity of label and vector."""
    v = F.col("v")
    fine = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    t1, t2 = hash128(F.struct("label", "v"))
    return vectors.withColumn("t", F.when(fine, F.struct(t1.alias("t1"), t2.alias("t2")))).withColumn("lab", F.xxhash64("label"))


def _sized(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (t, key) with `blocks` of about `block` rows for each key, and their own block; keys of one row have 0 blocks."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(key, F.when(F.col("n") == 1, 0).otherwise(F.ceil(F.col("n") / block)).cast("int").alias("blocks"))
    return attach(rows, sizes, [key], F.col("t")).withColumn("b", F.pmod(F.xxhash64("t", F.lit("block")), F.greatest("blocks", F.lit(1))).cast("int"))


def _ids(table: pa.Table) -> np.ndarray:
    t = table["t"].combine_chunks()
    return np.stack([t.field("t1").to_numpy(), t.field("t2").to_numpy()], 1)


def _t(ids: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(ids[:, 0], pa.int64()), pa.array(ids[:, 1], pa.int64())], ["t1", "t2"])


T = "struct<t1:long,t2:long>"


def posted(vectors: DataFrame, n: int, threshold: float) -> DataFrame:
    """(t, lab, v, lo, cnt) with `buckets` and `cell`, the vector's first bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lab = b.column(1).to_numpy()
            keys: list = [None] * len(b)
            for rows, x in units(b.column(2)):
                found = buckets(x, lab[rows], n, threshold)
                for i, key in zip(rows, found.reshape(len(rows), -1), strict=True):
                    keys[i] = key
            cells = np.array([key[0] for key in keys], np.int64)
            yield pa.record_batch([*b.columns, pa.array(keys, pa.list_(pa.int64())), pa.array(cells, pa.int64())], [*b.schema.names, "buckets", "cell"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select("t", "lab", "v", "lo", "cnt").mapInArrow(run, f"t {T}, lab long, v {kind}, lo long, cnt long, buckets array<long>, cell long")


def cores(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """(t, cell, v, rho) -> t, core, rho: centres within half the angle, radii included, of another one of their cell's block join it."""
    half = math.acos(threshold) / 2 - SLACK

    @lean
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell, rho = table["cell"].to_numpy(), table["rho"].to_numpy()
        t = _ids(table)
        core, radius = np.arange(len(cell)), rho.copy()
        for rows, x in units(table["v"].combine_chunks()):
            for c in np.unique(cell[rows]):
                at = np.flatnonzero(cell[rows] == c)
                at = at[np.lexsort((t[rows[at], 1], t[rows[at], 0], -rho[rows[at]]))]  # wide ones first, they join no other
                while len(at) > 1:
                    first = at[0]
                    angle = np.arccos(np.clip(x[at] @ x[first], -1, 1)) + rho[rows[at]]
                    angle[0] = rho[rows[first]]
                    mine = angle <= half
                    mine[0] = True
                    core[rows[at[mine]]] = rows[first]
                    if mine.sum() > 1:  # several members, and so a radius above zero
                        radius[rows[first]] = max(angle[mine].max(), SLACK)
                    at = at[~mine]
        return pa.table({"t": _t(t), "core": _t(t[core]), "rho": pa.array(radius)})

    r = _sized(rows.select("t", "cell"), "cell", block)
    alone = r.where("blocks = 0").select("t", F.col("t").alias("core"))
    alone = alone.join(rows.select("t", "rho"), "t").select("t", "core", "rho")
    some = r.where("blocks > 0").join(rows.select("t", "v", "rho"), "t")
    groups = max(1, -(-some.count() // block))
    some = some.withColumn("g", F.pmod(F.xxhash64("cell", "b"), F.lit(groups)))
    return some.select("g", "t", F.hash("b").cast("long").bitwiseXOR(F.col("cell")).alias("cell"), "v", "rho").groupBy("g").applyInArrow(run, f"t {T}, core {T}, rho double").union(alone)


def _crowded(rows: DataFrame, block: int) -> DataFrame:
    """Cells of more than one block."""
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("cell")


def gathered(vectors: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(members (t, core), entities (t, lab, v, lo, cnt, rho)) of posted vectors. 

    Centres of cells that had several blocks meet again while that joins half of them.
    """
    of = materialise(cores(vectors.withColumn("rho", F.lit(0.0)), threshold, block), "crosspolytope-cores")
    members, tops = of.select("t", "core"), of.where("t = core").select("t", "rho")
    crowd = _crowded(vectors, block)
    while not crowd.isEmpty():
        again = attach(tops.join(vectors.select("t", "cell", "v"), "t"), crowd, ["cell"], F.col("t"))
        more = materialise(cores(again, threshold, block), "crosspolytope-cores")
        up = more.select(F.col("t").alias("core"), F.col("core").alias("up"))
        members = materialise(attach(members, up, ["core"], F.col("t"), "left").select("t", F.coalesce("up", "core").alias("core")), "crosspolytope-members")
        wider = more.where("t = core").select(F.col("t").alias("core"), F.col("rho").alias("wider"))
        left = tops.join(up, F.col("t") == F.col("core"), "left").where("up is null or up = t").select("t", "rho")
        tops = materialise(left.join(wider, F.col("t") == F.col("core"), "left").select("t", F.coalesce("wider", "rho").alias("rho")), "crosspolytope-tops")
        if 2 * more.where("t <> core").count() < more.count():
            break  # the rest lies apart
        crowd = _crowded(again, block)
    about = members.join(vectors.select("t", "lo", "cnt"), "t").groupBy("core").agg(F.min("lo").alias("lo"), F.sum("cnt").alias("cnt"))
    entities = tops.join(about, F.col("t") == F.col("core")).drop("core").join(vectors.select("t", "lab", "v"), "t")
    return members, materialise(entities, "crosspolytope-entities")


def _links(pairs_i: np.ndarray, pairs_j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One link (row, head) for each row that is linked to an earlier one of its component."""
    head = np.arange(n)
    while True:
        low = np.minimum(head[pairs_i], head[pairs_j])
        new = head.copy()
        np.minimum.at(new, pairs_i, low)
        np.minimum.at(new, pairs_j, low)
        new = new[new]
        if (new == head).all():
            rows = np.flatnonzero(head != np.arange(n))
            return rows, head[rows]
        head = new


class Group:
    """The entries of some buckets, compared bucket by bucket."""

    def __init__(self, table: pa.Table, threshold: float, n: int):
        self.threshold, self.theta, self.n = threshold, math.acos(threshold), n
        self.t, self.key, self.block = _ids(table), table["bucket"].to_numpy(), table["b"].to_numpy()
        self.lab, self.rho, self.cnt, self.v = table["lab"].to_numpy(), table["rho"].to_numpy(), table["cnt"].to_numpy(), table["v"].combine_chunks()
        self.add = np.zeros(len(self.key), np.int64)
        self.linked: list[tuple[np.ndarray, np.ndarray]] = []
        self.other: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WHOLE: [], OPEN: []}

    def take(self, i: np.ndarray, j: np.ndarray, cos: np.ndarray, x: np.ndarray, rows: np.ndarray) -> None:
        """Pairs (i, j) of positions in `rows`, with their cosine."""
        a, b = rows[i], rows[j]
        same = self.lab[a] == self.lab[b]
        wide = same & ((self.rho[a] > 0) | (self.rho[b] > 0))
        near = same & ~wide & (cos >= self.threshold)
        if near.any():
            i, j, a_, b_ = i[near], j[near], a[near], b[near]
            used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            keys = buckets(x[used], self.lab[rows[used]], self.n, self.threshold)
            first = first_shared(keys, place[: len(i)], place[len(i) :]) == self.key[a_]
            a_, b_ = a_[first], b_[first]
            np.add.at(self.add, a_, self.cnt[b_])
            np.add.at(self.add, b_, self.cnt[a_])
            self.linked.append((a_, b_))
        if wide.any():
            a, b = a[wide], b[wide]
            angle, rho = np.arccos(np.clip(cos[wide], -1, 1)), self.rho[a] + self.rho[b]
            whole = angle + rho <= self.theta - SLACK
            open_ = ~whole & (angle - rho <= self.theta + SLACK)
            self.other[WHOLE].append((a[whole], b[whole]))
            self.other[OPEN].append((a[open_], b[open_]))

    def compare(self, left: int, right: int) -> None:
        """All pairs of entries of equal buckets; of blocks left and right (-1: of any)."""
        for rows, x in units(self.v):
            order = np.argsort(self.key[rows], kind="stable")
            rows, x = rows[order], x[order]
            key = self.key[rows]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            few = np.repeat(size <= FEW, size)
            for shift in range(1, int(size[size <= FEW].max(initial=1))):
                i = np.flatnonzero((key[shift:] == key[:-shift]) & few[shift:])
                for at in range(0, len(i), 1 << 16):
                    p = i[at : at + (1 << 16)]
                    self.pairs(p, p + shift, np.einsum("ij,ij->i", x[p], x[p + shift]), x, rows, left, right)
            for s, m in zip(starts[size > FEW], size[size > FEW], strict=True):
                for at in range(s, s + m, 256):
                    end = min(at + 256, s + m)
                    cos = x[at:end] @ x[at : s + m].T
                    lowest = min(self.threshold, math.cos(min(math.pi, self.theta + SLACK + 2 * float(self.rho[rows[s : s + m]].max()))))
                    i, j = np.nonzero(np.triu(cos >= lowest, 1))
                    for q in range(0, len(i), 1 << 16):
                        p = slice(q, q + (1 << 16))
                        self.pairs(at + i[p], at + j[p], cos[i[p], j[p]], x, rows, left, right)

    def pairs(self, i: np.ndarray, j: np.ndarray, cos: np.ndarray, x: np.ndarray, rows: np.ndarray, left: int, right: int) -> None:
        if left >= 0 and left != right:
            across = self.block[rows[i]] != self.block[rows[j]]
            i, j, cos = i[across], j[across], cos[across]
        self.take(i, j, cos, x, rows)

    def rows(self) -> pa.Table:
        some = np.flatnonzero(self.add)
        parts = [(COUNT, some, some, self.add[some])]
        if self.linked:
            a, b = _links(*(np.concatenate(p) for p in zip(*self.linked, strict=True)), len(self.key))
            parts.append((LINK, a, b, np.zeros(len(a), np.int64)))
        for kind, found in self.other.items():
            if found:
                a, b = (np.concatenate(p) for p in zip(*found, strict=True))
                parts.append((kind, a, b, np.zeros(len(a), np.int64)))
        what = np.concatenate([np.full(len(a), k) for k, a, _, _ in parts])
        a, b, n = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        return pa.table({"what": pa.array(what, pa.int32()), "a": _t(self.t[a]), "b": _t(self.t[b]), "n": pa.array(n, pa.int64())})


FOUND = f"what int, a {T}, b {T}, n long"


def first_shared(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first bucket, by table and then key, that vectors i and j share (keys [vectors, tables, PROBES]); they share one."""
    out, left = np.zeros(len(i), np.int64), np.arange(len(i))
    for t in range(keys.shape[1]):
        p, q = keys[i[left], t], keys[j[left], t]
        shared = np.where((p[:, :, None] == q[:, None, :]).any(2), p, np.iinfo(np.int64).max).min(1)
        met = (p[:, :, None] == q[:, None, :]).any(axis=(1, 2))
        out[left[met]] = shared[met]
        left = left[~met]
    return out


def compared(entries: DataFrame, entities: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """Entries (t, bucket) -> rows found (what, a, b, n)."""

    @lean
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = Group(table, threshold, n)
        group.compare(key[1].as_py(), key[2].as_py())
        return group.rows()

    shared = materialise(_sized(entries, "bucket", block).where("blocks > 0"), "crosspolytope-buckets")
    groups = max(1, -(-shared.count() // (2 * block)))
    own = F.col("b").cast("int")
    all_ = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("p"), F.greatest(own, o).alias("q")))
    meets = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("q")))).otherwise(all_)
    g = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(F.col("bucket"))
    rows = shared.select("t", "bucket", "b", g.alias("g"), F.explode(meets).alias("m")).join(entities.select("t", "lab", "v", "rho", "cnt"), "t")
    return rows.select("g", F.col("m.p").alias("p"), F.col("m.q").alias("q"), "t", "bucket", "b", "lab", "v", "rho", "cnt").groupBy("g", "p", "q").applyInArrow(run, FOUND)


def by_members(pairs: DataFrame, members: DataFrame, vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    """Pairs of cores (a, b), compared member by member: rows found of kinds COUNT (of vectors) and LINK (of the cores)."""

    @lean
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"what": [], "a": [], "b": [], "n": []}
        if left.num_rows and right.num_rows:
            (_, x), (_, y) = next(units(left["v"].combine_chunks())), next(units(right["v"].combine_chunks()))
            p, q, cores_ = _ids(left), _ids(right), right["core"].combine_chunks()
            other = np.stack([cores_.field("t1").to_numpy(), cores_.field("t2").to_numpy()], 1)
            core = left["core"].combine_chunks()
            own = np.array([[core.field("t1")[0].as_py(), core.field("t2")[0].as_py()]], np.int64)
            add, back, met = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), np.zeros(len(y), bool)
            m, c = left["cnt"].to_numpy(), right["cnt"].to_numpy()
            for at in range(0, len(x), 256):
                near = x[at : at + 256] @ y.T >= threshold
                add[at : at + 256] = near @ c
                back += m[at : at + 256] @ near
                met |= near.any(0)
            links = np.unique(other[met], axis=0)
            for ids, n in ((p, add), (q, back)):
                some = np.flatnonzero(n)
                out["what"].append(np.full(len(some), COUNT))
                out["a"].append(ids[some])
                out["b"].append(ids[some])
                out["n"].append(n[some])
            out["what"].append(np.full(len(links), LINK))
            out["a"].append(np.repeat(own, len(links), 0))
            out["b"].append(links)
            out["n"].append(np.zeros(len(links), np.int64))
        a, b = (np.concatenate(out[k]) if out[k] else np.zeros((0, 2), np.int64) for k in ("a", "b"))
        what, n = (np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64) for k in ("what", "n"))
        return pa.table({"what": pa.array(what, pa.int32()), "a": _t(a), "b": _t(b), "n": pa.array(n, pa.int64())})

    full = attach(members, pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("core")), ["core"], F.col("t"))
    full = full.join(vectors.select("t", "v", "cnt"), "t")
    of_left = full.join(pairs.select(F.col("a").alias("core")).distinct(), "core").withColumn("k", F.col("core"))
    of_right = pairs.join(full, F.col("b") == F.col("core")).withColumn("k", F.col("a"))
    blocks = lambda d: d.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    sizes = blocks(of_left).withColumnRenamed("n", "nl").join(blocks(of_right).withColumnRenamed("n", "nr"), "k")

    def dealt(d: DataFrame, own: str, other: str) -> DataFrame:
        d = attach(d, sizes, ["k"], F.col("t"))
        mine = F.pmod(F.xxhash64("t", F.lit("block")), F.col(own)).cast("int")
        d = d.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return d.select(*(F.col(c).alias(c) for c in ("k", "nl", "nr", "t", "core", "v", "cnt")))

    return dealt(of_left, "nl", "nr").groupBy("k", "nl", "nr").cogroup(dealt(of_right, "nr", "nl").groupBy("k", "nl", "nr")).applyInArrow(run, FOUND)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = 4096) -> DataFrame:
    """(id, v array<float or double>, label) -> id, n_links, component_id: one row per row."""
    small_batches(vectors.sparkSession)
    rows = distinct(vectors.select("id", "v", "label"))
    once = rows.where("t is not null").groupBy("t").agg(F.first("lab").alias("lab"), F.first("v").alias("v"), F.min("id").alias("lo"), F.count(F.lit(1)).alias("cnt"))
    once = materialise(once, "crosspolytope-vectors")
    most = once.groupBy("lab").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    hashed = materialise(posted(once, most, threshold), "crosspolytope-posted")
    members, entities = gathered(hashed, threshold, block)
    entries = hashed.select("t", "buckets").join(members, "t").select(F.col("core").alias("t"), F.explode("buckets").alias("bucket")).distinct()
    found = materialise(compared(entries, entities, most, threshold, block), "crosspolytope-found")
    ordered = F.when(F.col("a") < F.col("b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    cores_ = found.where(F.col("what") >= WHOLE).select("what", ordered.alias("p")).distinct().select("what", "p.a", "p.b")
    whole = cores_.where(F.col("what") == WHOLE).select("a", "b")
    open_ = materialise(cores_.where(F.col("what") == OPEN).select("a", "b"), "crosspolytope-open")
    parts = found.where(F.col("what") <= LINK)
    if not open_.isEmpty():
        parts = parts.union(materialise(by_members(open_, members, hashed, threshold, block), "crosspolytope-by-members"))
    both = whole.union(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = entities.select(F.col("t").alias("b"), "cnt")
    of_cores = both.join(size, "b").groupBy("a").agg(F.sum("cnt").alias("n")).select(F.col("a").alias("core"), "n")
    of_vectors = parts.where(F.col("what") == COUNT).groupBy(F.col("a").alias("t")).agg(F.sum("n").alias("own"))
    edges = parts.where(F.col("what") == LINK).select("a", "b").union(whole)
    root = components(edges, "crosspolytope-components").select(F.col("node").alias("t"), "root")
    named = entities.select("t", "lo", "cnt").join(root, "t", "left").withColumn("root", F.coalesce("root", "t"))
    lowest = named.groupBy("root").agg(F.min("lo").alias("component_id"))
    about = attach(named, lowest, ["root"], F.col("t")).select(F.col("t").alias("core"), "component_id", F.col("cnt").alias("within"))
    about = about.join(of_cores, "core", "left").select("core", "component_id", (F.col("within") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    per = attach(members, about, ["core"], F.col("t")).join(of_vectors, "t", "left")
    per = materialise(per.select("t", "component_id", (F.col("n_links") + F.coalesce("own", F.lit(0))).alias("n_links")), "crosspolytope-result")
    with_links = attach(rows.where("t is not null").select("id", "t"), per, ["t"], F.col("id")).select("id", "n_links", "component_id")
    return with_links.union(rows.where("t is null").select("id", F.lit(0).cast("long"), F.col("id")))


def sql(threshold: float = 0.93) -> str:
    """DuckDB: every pair of equal labels."""
    norm = "sqrt(list_inner_product(v, v))"
    return f"""WITH RECURSIVE x AS MATERIALIZED (
  SELECT vec_id, label, v, {norm} AS w FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda e: e IS NOT NULL AND isfinite(e))) = len(v) AND {norm} > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.w * b.w) >= {threshold}),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS m FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN lowest l ON l.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id"""
