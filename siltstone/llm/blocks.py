"""Text columns as flat byte arrays, for numpy work in Arrow batches."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def hand_back() -> None:
    """Memory that this worker has freed goes back to the system: a worker that waits for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(f: Callable) -> Callable:
    """f, of an iterator of batches or of two tables (key and group, or two groups), that hands memory back at its end."""
    if len(inspect.signature(f).parameters) == 1:

        def batches(given):
            try:
                yield from f(given)
            finally:
                hand_back()

        return batches

    def pair(a, b):
        try:
            return f(a, b)
        finally:
            hand_back()

    return pair


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty. offsets has one entry more than the array."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def chunks(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes; a longer text is a slice of its own."""
    lengths = flat_lengths(batch.column(column))
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield batch.slice(at)


def flat_lengths(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def grams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A `bits`-bit hash of the n bytes (n <= 8) from every position that has n bytes left in data."""
    count = len(data) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint32)
    h = data[:count].astype(np.uint64)
    for i in range(1, n):
        h |= data[i : i + count].astype(np.uint64) << np.uint64(8 * i)
    h += np.uint64(n)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.uint32)
