"""Suffix-array dedup: bytes of strings that occur elsewhere, found by deep-shallow suffix sorting.

A byte is removed if a 200-byte string that covers it starts anywhere else in the corpus too. The suffixes
of a corpus (cut off at 200 bytes) do not fit one task, so they are dealt out by content:

1. Every 200-byte window belongs to its smallest hashed 64-gram; consecutive windows with the same one are
   a run (137 windows at most, a string of 336 bytes). Equal windows have equal 64-grams, so only runs
   whose 64-gram occurs twice can hold a repeated window; the exchange of `shared` tells these.
2. Pre-aggregation: copies of one whole run are one string with a count. If all runs of a 64-gram are
   copies, each suffix in them is repeated and there is nothing to sort. Otherwise the distinct strings of
   the 64-gram go to one sorting task, each once, however often it occurs.
3. Sorting task, deep-shallow: multikey quicksort, breadth first over 8-byte symbols, to a depth of 64 bytes;
   groups that still share that prefix are ordered by a blind trie each. Neighbours that share 200 bytes are
   repeated. A 64-gram with more distinct strings than `most_runs` (a passage with thousands of
   different contexts) is too much for one task. Its windows are dealt anew by their smallest 112-gram, and where that has as many strings by longer
   ones, up to the window itself; copies of a string are one at each step. So all windows are sorted, and only those that a longer gram
   is needed for are sent again.

A run counts as repeated only if two independent 64-bit hashes of its string both are; window and text hashes have 128
bits. Matches never cross documents.

Defined cases: null is the empty text; texts under 200 bytes stay; rows with the same id and text repeat
each other; a text may repeat itself, overlaps included; an empty table gives no rows; extra columns are ignored.
Kept bytes can cut a character: kept text leaves out the incomplete ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import lean
from .common import attach, hash128, materialise, small_batches
from .shared import shared_hashes, text_batches, unpack, unplanes
from .shingles import _BYTE, _BYTE2, _P, _P_INV, _power, mix

LENGTH, GRAM = 200, 64
#: Longer grams that the windows of a gram with too many strings are dealt by, one after the other; the last is the window itself.
LONGER = (112, 152, 184, LENGTH)
SHALLOW = 64
PLACE_BITS = 22
BLOCK = 1 << 21


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n = len(a)
    pad = -n % width
    x = np.concatenate([a, np.full(pad, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, width)
    head = np.minimum.accumulate(x, axis=1).ravel()
    tail = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, size_of_gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(start, number of windows, hash of the gram, two hashes of the run's string) of all runs of a batch of texts."""
    out = []
    length = np.diff(offsets)
    for base in range(0, max(len(data) - LENGTH + 1, 0), BLOCK):
        d = data[base : base + BLOCK + LENGTH - 1]
        n = len(d)
        if n < LENGTH:
            break
        total = np.zeros(n + 1, np.uint64)
        second = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[d] * _power(n, _P, "p"), out=total[1:])
        np.cumsum(_BYTE2[d] * _power(n, _P, "p"), out=second[1:])
        inverse = _power(n, _P_INV, "inverse")
        gram = mix((total[size_of_gram:] - total[:-size_of_gram]) * inverse[: n - size_of_gram + 1])
        key = ((gram >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS)) | np.arange(len(gram), dtype=np.uint64)
        place = (sliding_min(key, LENGTH - size_of_gram + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        edge = np.zeros(n - LENGTH + 2, np.int64)  # windows inside a text
        some = length >= LENGTH
        lo, hi = offsets[:-1][some] - base, offsets[1:][some] - LENGTH + 1 - base
        inside = (hi > 0) & (lo < len(edge) - 1)
        np.add.at(edge, np.maximum(lo[inside], 0), 1)
        np.add.at(edge, np.minimum(hi[inside], len(edge) - 1), -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(at):
            continue
        p = place[at]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (p[1:] != p[:-1])]))
        s, count = at[first], np.diff(np.append(first, len(at)))
        end, size = s + count + LENGTH - 1, count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        whole = [mix(mix((t[end] - t[s]) * inverse[s]) + size + np.uint64(i)) for i, t in enumerate((total, second))]
        out.append((s + base, count, mix(gram[p[first]] + np.uint64(1)), *whole))
    if not out:
        return *(np.zeros(0, np.int64) for _ in range(2)), *(np.zeros(0, np.uint64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class BlindTrie:
    """A Patricia trie of suffixes cut off at `length` bytes; inner nodes hold a depth and branch bytes only."""

    def __init__(self, data: bytes, depth: int, length: int):
        self.data, self.depth, self.length = data, depth, length
        self.root = None  # a leaf is a list of equal suffixes, an inner node (depth, {byte: child})

    def _common(self, p: int, q: int) -> int:
        """Length of the common prefix of two suffixes."""
        d, lo, hi = self.data, self.depth, self.length
        if d[p + lo : p + hi] == d[q + lo : q + hi]:
            return hi
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if d[p + lo : p + mid] == d[q + lo : q + mid]:
                lo = mid
            else:
                hi = mid
        return lo

    def insert(self, p: int) -> None:
        if self.root is None:
            self.root = [p]
            return
        d, node, path = self.data, self.root, []
        while type(node) is tuple:
            path.append(node)
            c = d[p + node[0]]
            node = node[1].get(c) or next(iter(node[1].values()))  # blindly: any leaf below tells the common prefix
        common = self._common(p, node[0])
        if common == self.length:
            node.append(p)
            return
        q = node[0]
        above, node = None, self.root
        while type(node) is tuple and node[0] < common:
            above, node = node, node[1].get(d[q + node[0]])
        if type(node) is tuple and node[0] == common:
            node[1][d[p + common]] = [p]
            return
        new = (common, {d[q + common]: node, d[p + common]: [p]})
        if above is None:
            self.root = new
        else:
            above[1][d[q + above[0]]] = new

    def leaves(self) -> Iterator[list[int]]:
        """Lists of equal suffixes, in order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node


def deep_shallow(data: np.ndarray, pos: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes pos of data in the order of their first `length` bytes, and whether each equals its predecessor in these.

    data has `length` bytes from every position on.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    symbol = np.zeros(len(data), np.uint64)
    for i in range(8):
        symbol = (symbol << np.uint64(8)) | padded[i : i + len(data)]
    order, same = np.arange(len(pos)), np.zeros(len(pos), bool)
    slots = np.arange(len(pos))
    group = np.zeros(len(pos), np.int64)
    shallow = min(shallow, length) // 8 * 8
    for depth in range(0, shallow, 8):
        if not len(slots):
            return order, same
        s = symbol[pos[order[slots]] + depth]
        by = np.lexsort((s, group))
        order[slots] = order[slots[by]]
        s, group = s[by], group[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (s[1:] != s[:-1])])
        group = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots, group = slots[tied], group[tied]
    if not len(slots):
        return order, same
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(slots)))
    # tries of two leaves, all together: one branch at the first different symbol
    two = starts[sizes == 2]
    a, b = order[slots[two]], order[slots[two + 1]]
    undecided, swap = np.ones(len(two), bool), np.zeros(len(two), bool)
    for depth in [*range(shallow, length - 7, 8), *([length - 8] if length % 8 else [])]:
        x, y = symbol[pos[a] + depth], symbol[pos[b] + depth]
        swap |= undecided & (x > y)
        undecided &= x == y
    order[slots[two]], order[slots[two + 1]] = np.where(swap, b, a), np.where(swap, a, b)
    same[slots[two + 1]] = undecided
    raw = data.tobytes()
    for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        place = slots[at : at + size]
        members = order[place]
        trie = BlindTrie(raw, shallow, length)
        by = {}
        for i in members.tolist():
            p = int(pos[i])
            by.setdefault(p, []).append(i)
            if len(by[p]) == 1:
                trie.insert(p)
        out, equal = [], []
        for leaf in trie.leaves():
            ids = [i for p in leaf for i in by[p]]
            out += ids
            equal += [False] + [True] * (len(ids) - 1)
        order[place], same[place] = out, equal
    return order, same


def repeated(data: np.ndarray, pos: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each suffix shares its first `length` bytes with another one."""
    order, same = deep_shallow(data, pos, length)
    both = same.copy()
    both[:-1] |= same[1:]
    out = np.zeros(len(pos), bool)
    out[order] = both
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint maximal spans [n, 2] of any spans; touching ones are one."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def cut_out(data: np.ndarray, spans: np.ndarray) -> bytes:
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    keep = np.cumsum(edge)[:-1] == 0
    return data[keep].tobytes()


EDGE = "array<struct<s:long,h:long,g1:long,g2:long,own:boolean,str:binary>>"
OUT = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("spans", pa.list_(pa.int64()))])
OUT_SQL = "doc_id long, t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<long>"


def finished(data: np.ndarray, spans: np.ndarray, with_text: bool) -> dict:
    spans = merged(spans)
    kept = cut_out(data, spans) if len(spans) else data.tobytes()
    return {"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode("utf-8", "ignore") if with_text else None, "spans": spans.ravel().tolist()}


def resolve(docs: DataFrame, replies: DataFrame, with_text: bool) -> DataFrame:
    """Per document the spans of runs that occur elsewhere as a whole, its undecided runs, and the result if there are none."""
    kind = OUT.append(pa.field("text", pa.binary())).append(pa.field("edges", pa.list_(pa.struct([("s", pa.int64()), ("h", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("own", pa.bool_()), ("str", pa.binary())]))))

    @lean
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h = np.concatenate([unplanes(x.as_py()) for x in right["h"]]) if right.num_rows else np.zeros(0, np.uint64)
        n = np.concatenate([unpack(x.as_py(), "<u8") for x in right["n"]]) if right.num_rows else np.zeros(0, np.uint64)
        order = np.argsort(h)
        h, n = h[order], n[order].astype(np.int64)

        def count(x: np.ndarray) -> np.ndarray:
            if not len(h):
                return np.ones(len(x), np.int64)
            p = np.minimum(np.searchsorted(h, x), len(h) - 1)
            return np.where(h[p] == x, n[p], 1)

        keys = [left[c].to_pylist() for c in ("doc_id", "t1", "t2")]
        rows, sent = [], set()
        for at, data, offsets in text_batches(left["text"]):
            s, size, gram, whole, second = runs(data, offsets)
            ng, nh = np.minimum(count(whole), count(second)), count(gram)
            doc = np.searchsorted(offsets, s, side="right") - 1
            all_of_it = ng >= 2
            mixed = (nh > ng) & (nh >= 2)
            spans = np.stack([s, s + size + LENGTH - 1], axis=1)
            per = np.searchsorted(doc, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                o, d = offsets[i], data[offsets[i] : offsets[i + 1]]
                r = np.arange(per[i], per[i + 1])
                found = spans[r[all_of_it[r]]] - o
                edges, own = [], False
                for j in r[mixed[r]]:
                    mine = not all_of_it[j]
                    g = int(whole[j].view(np.int64)), int(second[j].view(np.int64))
                    if not mine and g in sent:
                        continue
                    if not mine:
                        sent.add(g)
                    own |= mine
                    edges.append({"s": int(s[j] - o), "h": int(gram[j].view(np.int64)), "g1": g[0], "g2": g[1], "own": mine, "str": data[s[j] : s[j] + size[j] + LENGTH - 1].tobytes()})
                row = {"spans": merged(found).ravel().tolist(), "text": d.tobytes()} if own else finished(d, found, with_text)
                rows.append({"doc_id": keys[0][at + i], "t1": keys[1][at + i], "t2": keys[2][at + i], "edges": edges, **row})
        return pa.Table.from_pylist(rows, schema=kind)

    return docs.groupBy("split").cogroup(replies.groupBy("split")).applyInArrow(run, f"{OUT_SQL}, text binary, edges {EDGE}")


def sort_runs(edges: DataFrame, per_task: int) -> DataFrame:
    """(doc_id, t1, t2, s, h, own, str) -> doc_id, t1, t2, start, end: the repeated parts of owned runs."""

    @lean
    def run(key: tuple, table: pa.Table) -> pa.Table:
        strings = [x.as_py() for x in table["str"]]
        data = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(x) for x in strings])
        base = np.cumsum(sizes) - sizes
        windows = sizes - LENGTH + 1
        first = np.cumsum(windows) - windows
        pos = np.repeat(base - first, windows) + np.arange(int(windows.sum()))
        again = repeated(data, pos)
        own = table["own"].to_numpy(zero_copy_only=False).astype(bool)
        again &= np.repeat(own, windows)
        i = np.flatnonzero(again)
        run_of = np.repeat(np.arange(len(strings)), windows)[i]
        new = np.concatenate([[True], (i[1:] != i[:-1] + 1) | (run_of[1:] != run_of[:-1])]) if len(i) else np.zeros(0, bool)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(i)) - 1 if len(a) else a
        r = run_of[a]
        s = table["s"].to_numpy()[r]
        take = lambda c: table[c].take(pa.array(r))
        return pa.table({"doc_id": take("doc_id"), "t1": take("t1"), "t2": take("t2"), "start": pa.array(s + i[a] - first[r], pa.int64()), "end": pa.array(s + i[b] - first[r] + LENGTH, pa.int64())})

    n = edges.count()
    tasks = F.lit(max(1, n // per_task))
    return edges.groupBy(F.pmod(F.xxhash64("h"), tasks).alias("task")).applyInArrow(run, "doc_id long, t1 long, t2 long, start long, end long")


def divide(edges: DataFrame, size_of_gram: int) -> DataFrame:
    """The runs of the edges' strings by the smallest longer gram: doc_id, t1, t2, s, h, g1, g2, own, str."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                strings = [x.as_py() for x in part.column(5)]
                offsets = np.append(0, np.cumsum([len(x) for x in strings])).astype(np.int64)
                start, size, h, g1, g2 = runs(np.frombuffer(b"".join(strings), np.uint8), offsets, size_of_gram)
                row = np.searchsorted(offsets, start, side="right") - 1
                first = start - offsets[row]
                take = lambda i: part.column(i).take(pa.array(row))  # noqa: B023, E731
                text = [strings[r][f : f + n + LENGTH - 1] for r, f, n in zip(row, first, size, strict=True)]
                hashes = [pa.array(x.view(np.int64)) for x in (h, g1, g2)]
                yield pa.record_batch([*map(take, range(3)), pa.array(part.column(3).to_numpy()[row] + first), *hashes, take(4), pa.array(text, pa.binary())], ["doc_id", "t1", "t2", "s", "h", "g1", "g2", "own", "str"])

    e = edges.select("doc_id", "t1", "t2", "s", "own", "str")
    return e.mapInArrow(run, "doc_id long, t1 long, t2 long, s long, h long, g1 long, g2 long, own boolean, str binary")


def sort_all(edges: DataFrame, most_runs: int, per_task: int) -> DataFrame:
    """`sort_runs` of all edges. The windows of grams with more than most_runs distinct strings are dealt anew by longer grams, with copies of a string
    pre-aggregated again, until no gram has as many; the last gram is the window, of which there is one string."""
    parts = []
    for size in LONGER:
        many = edges.groupBy("h").agg(F.count(F.lit(1)).alias("runs"))
        edges = materialise(attach(edges, many, ["h"], F.struct("g1", "g2")), "suffixes-runs")  # a copy of a string may stand for it in one read and another in the next, but its hashes are the same
        parts.append(sort_runs(edges.where(F.col("runs") <= most_runs), per_task))
        hot = edges.where(F.col("runs") > most_runs)
        if hot.isEmpty():
            break
        sub = materialise(divide(hot, size), "suffixes-divided")
        copies = F.sum(F.when(F.col("own"), 1).otherwise(2)).alias("n")
        groups = materialise(sub.groupBy("h", "g1", "g2").agg(copies, F.first(F.struct("doc_id", "t1", "t2", "s", "str")).alias("e")), "suffixes-groups")
        again = attach(sub.where("own"), groups.where("n > 1").select("h", "g1", "g2"), ["h", "g1", "g2"], F.struct("t1", "s"))
        parts.append(again.select("doc_id", "t1", "t2", F.col("s").alias("start"), (F.col("s") + F.octet_length("str")).alias("end")))
        edges = groups.select("e.doc_id", "e.t1", "e.t2", "e.s", "h", "g1", "g2", (F.col("n") == 1).alias("own"), "e.str")
    else:
        parts.append(sort_runs(edges, per_task))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedup(docs: DataFrame, with_text: bool = False, split_bytes: int = 4 << 20, bucket_bytes: int = 32 << 20, most_runs: int = 5000, runs_per_task: int = 4_000) -> DataFrame:
    """(doc_id, text) -> doc_id, t1, t2, n_bytes, n_removed, n_spans, kept_sha256, kept (with_text), spans (start, end, start, ...)."""
    text = F.coalesce("text", F.lit(""))
    small_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    splits, buckets = max(1, size // split_bytes), max(1, size // bucket_bytes)
    t1, t2 = hash128(text)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), text.alias("text"))
    d = d.withColumn("split", F.pmod(F.xxhash64("t1", "doc_id"), F.lit(splits)))
    replies = shared_hashes(d, buckets, lambda data, offsets: np.concatenate(runs(data, offsets)[2:]), 64)
    known = materialise(resolve(d, replies, with_text), "suffixes")
    key = ["doc_id", "t1", "t2"]
    edges = known.where(F.size("edges") > 0).select(*key, F.explode("edges").alias("e")).select(*key, "e.*")
    edges = edges.where("own").unionByName(edges.where("not own").dropDuplicates(["h", "g1", "g2"]))
    parts = sort_all(edges, most_runs, runs_per_task).groupBy(*(F.col(c).alias(f"p_{c}") for c in key)).agg(F.flatten(F.collect_list(F.array("start", "end"))).alias("parts"))
    open_ = known.where("text is not null").select(*key, "text", "spans")
    open_ = open_.join(parts, F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("t1") == F.col("p_t1")) & (F.col("t2") == F.col("p_t2")), "left")

    @lean
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for *ids, text, spans, parts in zip(*b.columns, strict=True):
                both = np.array([*(spans.as_py() or []), *(parts.as_py() or [])], np.int64).reshape(-1, 2)
                rows.append({k: i.as_py() for k, i in zip(key, ids, strict=True)} | finished(np.frombuffer(text.as_buffer(), np.uint8), both, with_text))
                size += rows[-1]["n_bytes"]
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=OUT)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=OUT)

    closed = open_.select(*key, "text", "spans", "parts").mapInArrow(close, OUT_SQL)
    return known.where("text is null").select(*OUT.names).unionByName(closed)
