"""Which hashes of a corpus occur more than once: an exchange of packed hashes between splits and hash ranges.

Every split of documents sends its distinct hashes, packed and pre-counted, to buckets of the hash
range; a bucket adds the counts and answers each split with those that occur twice or more. A frequent
hash costs one entry per split, never a row per document, and no list of all hashes exists anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .blocks import flat, lean


def planes(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as compressed byte planes of their differences."""
    d = np.diff(x, prepend=x.dtype.type(0)) if len(x) else x
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unplanes(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).reshape(-1).view("<u8"), dtype=np.uint64)


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def text_batches(texts: pa.ChunkedArray, most: int = 1 << 20, rows: int = 2000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about `most` bytes."""
    at = 0
    for chunk in texts.chunks:
        data, offsets = flat(chunk)
        i = 0
        while i < len(chunk):
            j = min(i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
            yield at + i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        at += len(chunk)


def shared_hashes(docs: DataFrame, buckets: int, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int) -> DataFrame:
    """(split, text) -> split, h, n: packed hashes (below 2**bits) of the split with a count of two or more, and the counts.

    hashes(data, offsets) gives the hashes of a run of texts, repeated as often as they count.
    """
    width = (1 << bits) // buckets + 1

    @lean
    def post(key: tuple, table: pa.Table) -> pa.Table:
        found = [hashes(d, o) for _, d, o in text_batches(table["text"])]
        h = np.concatenate(found) if found else np.zeros(0, np.uint64)
        del found
        h.sort()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(h)))
        h = h[first]
        cut = np.searchsorted(h, np.array([min(i * width, (1 << 64) - 1) for i in range(buckets)], np.uint64))
        cut = np.append(cut, len(h))
        some = np.flatnonzero(np.diff(cut))
        parts = [(i, planes(h[cut[i] : cut[i + 1]]), pack(n[cut[i] : cut[i + 1]].astype("<u4"))) for i in some]
        s = key[0].as_py()
        return pa.table({"split": pa.array([s] * len(parts), pa.int64()), "bucket": pa.array([p[0] for p in parts], pa.int64()), "h": pa.array([p[1] for p in parts], pa.binary()), "n": pa.array([p[2] for p in parts], pa.binary())})

    @lean
    def count(key: tuple, table: pa.Table) -> pa.Table:
        splits = table["split"].to_pylist()
        hs = [unplanes(x.as_py()) for x in table["h"]]
        ns = [unpack(x.as_py(), "<u4") for x in table["n"]]
        owner = np.repeat(np.arange(len(splits), dtype=np.int32), [len(x) for x in hs])
        h, n = np.concatenate(hs), np.concatenate(ns)
        del hs, ns
        order = np.argsort(h)
        h, n, owner = h[order], n[order], owner[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.add.reduceat(n, first, dtype=np.int64)
        sizes = np.diff(np.append(first, len(h)))
        keep = np.repeat(total >= 2, sizes)
        h, owner, many = h[keep], owner[keep], np.repeat(total[total >= 2], sizes[total >= 2])
        del n, first, keep
        order = np.lexsort((h, owner))
        h, many, owner = h[order], many[order], owner[order]
        del order
        cut = np.searchsorted(owner, np.arange(len(splits) + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"split": pa.array([splits[i] for i in some], pa.int64()), "h": pa.array([planes(h[cut[i] : cut[i + 1]]) for i in some], pa.binary()), "n": pa.array([pack(many[cut[i] : cut[i + 1]].astype("<u8")) for i in some], pa.binary())})

    posted = docs.groupBy("split").applyInArrow(post, "split long, bucket long, h binary, n binary")
    return posted.groupBy("bucket").applyInArrow(count, "split long, h binary, n binary")
