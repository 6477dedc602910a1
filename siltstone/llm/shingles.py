"""Hashed word shingles of text batches, in numpy."""

from __future__ import annotations

import numpy as np

HASH_BITS = 52
_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: A second table, drawn after the others: sums over it with the same powers are a second, independent hash.
_BYTE2 = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int, p: np.uint64, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = np.full(max(n, 1 << 16), p, np.uint64)
        base[0] = 1
        have = _powers[name] = np.cumprod(base, dtype=np.uint64)
    return have[:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all words: runs of ASCII letters, digits and bytes over 127."""
    n = len(data)
    is_word = _WORD[data]
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = is_word[inner]
    end = np.zeros(n + 1, bool)
    end[1:n] = is_word[:-1] & ~is_word[1:]
    end[inner] |= is_word[inner - 1]
    end[n] = n > 0 and is_word[-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(n, _P, "p"), out=total[1:])
    h = (total[e] - total[s]) * _power(n + 1, _P_INV, "inverse")[s]
    return mix(h + (e - s).astype(np.uint64)), np.searchsorted(offsets, s, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, n_words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash of HASH_BITS bits, count) of the distinct shingles, sorted by text and hash.

    A text with fewer words has one shingle of all its words; one without words has none.
    At most 4096 texts.
    """
    h, doc = words(data, offsets)
    n = len(offsets) - 1
    per = np.searchsorted(doc, np.arange(n + 1))
    count = len(h) - n_words + 1
    if count > 0:
        value = np.zeros(count, np.uint64)
        for i in range(n_words):
            value += h[i : i + count] * _PLACE[i]
        ok = doc[:count] == doc[n_words - 1 :]
        value, where = mix(value[ok]), doc[:count][ok]
    else:
        value, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.diff(per)
    short = np.flatnonzero((sizes > 0) & (sizes < n_words))
    if len(short):
        extra = np.array([(h[per[i] : per[i + 1]] * _PLACE[: sizes[i]]).sum(dtype=np.uint64) + np.uint64(sizes[i]) for i in short], np.uint64)
        value, where = np.concatenate([value, mix(extra)]), np.concatenate([where, short])
    key = (where.astype(np.uint64) << np.uint64(HASH_BITS)) | (value >> np.uint64(64 - HASH_BITS))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), counts
