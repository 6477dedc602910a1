"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The model file's pieces and log scores are read with its library and never trained. Blanks become the
whitespace marker and a text gets one marker in front. The best segmentation maximises the sum of
scores; of equal ones the longest last piece wins, from the end backwards. A character without a piece
of its own costs the lowest score minus 10 and is written as byte pieces. A literal marker in the text is
always written as bytes, so decoding gives exactly the text back.

No piece has a marker after another character (checked on load), so a text falls apart before every
run of blanks and each distinct unit is encoded once per batch: short units all together, position by
position, in numpy; long ones by a scalar loop in linear time.

Defined cases: null and empty texts have no ids and decode to the empty text; rows may repeat; units
of any length are processed whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, lean
from .common import small_batches

MARK = "▁"
UNIT = re.compile(r" *[^ ]+| +")
LONG = 48


@dataclass
class Trie:
    """Double array: the child of node s by byte c is base[s] + c if check of that is s; value is the piece there or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(pieces: dict[bytes, int]) -> Trie:
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for piece, i in pieces.items():
        node = 0
        for c in piece:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = i
    size = 4 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0], check[0] = False, 0
    place, first, last = {0: 0}, 1, 1
    queue = [0]
    for node in queue:
        at = place[node]
        value[at] = ends[node]
        kids = np.array(sorted(children[node]), np.int64)
        if not len(kids):
            continue
        while not free[first]:
            first += 1
        if last + 1024 > len(free):
            free = np.concatenate([free, np.ones(len(free), bool)])
            base, check, value = np.concatenate([base, np.zeros_like(base)]), np.concatenate([check, np.full_like(check, -1)]), np.concatenate([value, np.full_like(value, -1)])
        # a gap near the first or the last slots in use that holds all children, or else the end
        near, far = first + np.flatnonzero(free[first : min(first + 4096, last + 1)])[:64], max(1, last - 1024)
        gaps = np.concatenate([near, far + np.flatnonzero(free[far : last + 1])]) - kids[0]
        gaps = np.append(gaps[gaps > 0], max(last + 1, 257))
        b = int(gaps[np.argmax(free[gaps[:, None] + kids[None]].all(axis=1))])
        base[at] = b
        for c in kids:
            free[b + c] = False
            check[b + c] = at
            place[children[node][int(c)]] = b + int(c)
            queue.append(children[node][int(c)])
        last = max(last, b + int(kids[-1]))
    last += 257
    return Trie(base[:last], check[:last], value[:last])


@dataclass
class Model:
    trie: Trie
    scores: np.ndarray
    unknown: float
    byte_ids: np.ndarray  # byte -> id
    text: list[bytes]  # id -> bytes it stands for, blanks restored
    longest: int


def load(path: str) -> Model:
    """A model from a SentencePiece file, by its own library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces, text, byte_ids = {}, [b""] * n, np.full(256, sp.unk_id(), np.int32)
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            text[i] = bytes([int(p[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            if MARK in p.lstrip(MARK):
                raise ValueError(f"piece {p!r} has a marker inside")
            pieces[p.encode()] = i
            text[i] = p.replace(MARK, " ").encode()
    return make(pieces, np.array([sp.get_score(i) for i in range(n)]), byte_ids, text)


def make(pieces: dict[bytes, int], scores: np.ndarray, byte_ids: np.ndarray, text: list[bytes]) -> Model:
    low = min(scores[i] for i in pieces.values())
    return Model(build_trie(pieces), scores.astype(np.float64), float(low) - 10.0, byte_ids, text, max(map(len, pieces)))


def _escape(unit: str) -> tuple[bytes, set[int]]:
    """Bytes with markers for blanks, and the places of literal markers."""
    if MARK not in unit:
        return unit.replace(" ", MARK).encode(), set()
    out, literal = bytearray(), set()
    for c in unit:
        if c == MARK:
            literal.add(len(out))
        out += (MARK if c == " " else c).encode()
    return bytes(out), literal


def viterbi_long(unit: str, m: Model) -> array:
    """Ids of one unit by a scalar loop, in 20 bytes of memory for each byte of the unit."""
    s, literal = _escape(unit)
    n = len(s)
    base, check, value = m.trie.base, m.trie.check, m.trie.value
    best, start, piece = array("d", [-np.inf]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
    best[0] = 0.0
    for at in range(n):
        if s[at] & 0xC0 == 0x80:
            continue
        width = 1 if s[at] < 0x80 else 2 if s[at] < 0xE0 else 3 if s[at] < 0xF0 else 4
        single = False
        node = 0
        here = best[at]
        for end in range(at, n):
            if end in literal:
                break
            child = int(base[node]) + s[end]
            if check[child] != node or child == 0:
                break
            node = child
            i = int(value[node])
            if i >= 0:
                if end + 1 == at + width:
                    single = True
                if here + m.scores[i] > best[end + 1]:
                    best[end + 1], start[end + 1], piece[end + 1] = here + m.scores[i], at, i
        if not single and here + m.unknown > best[at + width]:
            best[at + width], start[at + width], piece[at + width] = here + m.unknown, at, -1
    out = array("i")
    while n:
        at, i = start[n], piece[n]
        out.extend([i] if i >= 0 else [int(m.byte_ids[c]) for c in reversed(s[at:n])])
        n = at
    out.reverse()
    return out


def viterbi_short(units: list[str], m: Model) -> list[np.ndarray]:
    """Ids of many units of at most LONG bytes, without literal markers: all together, position by position."""
    raw = [u.replace(" ", MARK).encode() for u in units]
    lengths = np.array([len(r) for r in raw])
    n, width = len(raw), int(lengths.max(initial=0))
    s = np.zeros((n, width + 4), np.uint8)
    s[np.arange(width + 4)[None] < lengths[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    base, check, value = m.trie.base, m.trie.check, m.trie.value
    best = np.full((n, width + 5), -np.inf)
    best[:, 0] = 0
    start, piece = np.zeros((n, width + 5), np.int16), np.full((n, width + 5), -1, np.int32)
    for at in range(width):
        c = s[:, at]
        rows = np.flatnonzero((at < lengths) & (c & 0xC0 != 0x80))
        c = c[rows]
        wide = np.where(c < 0x80, 1, np.where(c < 0xE0, 2, np.where(c < 0xF0, 3, 4)))
        single = np.zeros(len(rows), bool)
        live, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for end in range(at, min(width, at + m.longest)):
            live_rows = rows[live]
            child = base[node] + s[live_rows, end].astype(np.int64)
            go = (check[child] == node) & (child != 0) & (end < lengths[live_rows])
            live, node = live[go], child[go]
            if not len(live):
                break
            i = value[node]
            got = np.flatnonzero(i >= 0)
            if len(got):
                g, r = live[got], rows[live[got]]
                single[g[end + 1 == at + wide[g]]] = True
                new = best[r, at] + m.scores[i[got]]
                up = new > best[r, end + 1]
                best[r[up], end + 1], start[r[up], end + 1], piece[r[up], end + 1] = new[up], at, i[got][up]
        lone = np.flatnonzero(~single)
        if len(lone):
            r, e = rows[lone], at + wide[lone]
            new = best[r, at] + m.unknown
            up = new > best[r, e]
            best[r[up], e[up]], start[r[up], e[up]], piece[r[up], e[up]] = new[up], at, -1
    out = []
    for r in range(n):
        ids, end = [], int(lengths[r])
        row_start, row_piece = start[r], piece[r]
        while end:
            at, i = int(row_start[end]), int(row_piece[end])
            ids += [i] if i >= 0 else [int(m.byte_ids[c]) for c in reversed(raw[r][at:end])]
            end = at
        out.append(np.array(ids[::-1], np.int32))
    return out


class Encoder:
    """Texts to ids, with a bounded cache of units."""

    def __init__(self, m: Model, most_units: int = 600_000):
        self.m, self.most = m, most_units
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.starts = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def learn(self, units: set[str]) -> None:
        new = sorted(units)
        short = [u for u in new if MARK not in u and len(u.encode()) + 2 * u.count(" ") <= LONG]
        known = set(short)
        got = [ids for at in range(0, len(short), 20_000) for ids in viterbi_short(short[at : at + 20_000], self.m)]
        rest = [u for u in new if u not in known]
        got += [np.array(viterbi_long(u, self.m), np.int32) for u in rest]
        n = len(self.codes)
        ends = self.starts[n] + np.cumsum([len(x) for x in got])
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), int(ends[-1])), np.int32)])
        if n + len(got) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(got)), np.int64)])
        self.flat[self.starts[n] : ends[-1]] = np.concatenate(got)
        self.starts[n + 1 : n + 1 + len(got)] = ends
        self.codes.update(zip(short + rest, range(n, n + len(got)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        if len(self.codes) > self.most:
            self.clear()
        new: set[str] = set()
        for u in units:
            new.update(itertools.filterfalse(self.codes.__contains__, u))
        if new:
            self.learn(new)
        out = []
        for u in units:
            c = np.fromiter(map(self.codes.__getitem__, u), np.int64, len(u))
            n = self.starts[c + 1] - self.starts[c]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.starts[c] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)])
        return out


def encode(docs: DataFrame, m: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, ids array<int>, n_tokens long, ids_crc32 long (of little-endian 32-bit ids)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            for part in chunks(b, 1, 4 << 20):
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                n = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.record_batch({"doc_id": part.column(0), "ids": lists, "n_tokens": n, "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long")


def decode_ids(ids: np.ndarray, data: np.ndarray, starts: np.ndarray) -> str:
    n = starts[ids + 1] - starts[ids]
    ends = np.cumsum(n)
    raw = data[np.repeat(starts[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
    return raw[1:].decode("utf-8", "replace")


def decode(encoded: DataFrame, m: Model) -> DataFrame:
    """Rows with column ids: ids replaced by text."""
    kept = [c for c in encoded.columns if c != "ids"]
    shared = encoded.sparkSession.sparkContext.broadcast(m.text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = shared.value
        data = np.frombuffer(b"".join(text), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
        for b in batches:
            at = 0
            sizes = np.cumsum([len(x) for x in b.column(0)])
            while at < b.num_rows:  # about 8 MB of ids at a time
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (2 << 20))))
                out = [decode_ids(x.values.to_numpy(), data, starts) for x in b.column(0).slice(at, end - at)]
                yield pa.record_batch([*(c.slice(at, end - at) for c in b.columns[1:]), pa.array(out, pa.string())], names=[*kept, "text"])
                at = end

    return encoded.select("ids", *kept).mapInArrow(run, encoded.select(*kept).schema.add("text", "string"))
