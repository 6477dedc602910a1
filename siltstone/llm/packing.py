"""Packing: bounded-space online packing of token sequences into windows of fixed size.

Every partition keeps at most `open_windows` open windows. A document's ids fill whole windows first;
its remainder goes, best fit, to the open window with the least room that still holds it. When none
fits and all windows are open, the fullest is emitted, topped up with the head of the waiting piece,
so it leaves without padding. At the end of a partition the leftover windows are merged, emptiest into
fullest; the last one is cut at powers of two, lengths that need no padding.

Nothing is shuffled: memory is bounded by the open windows and one document, and a partition that runs
again on another executor gives the same pieces, as sequence ids are (partition, counter).

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; documents
longer than a window are cut; strings of the file's added tokens become those tokens; texts and runs of blanks
of any length are encoded whole; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .blocks import lean
from .common import small_batches

SEQUENCE_BITS = 40
#: The rank-based encoder backtracks over a run of blanks and gives up on a million; texts with such runs go to the file's own library.
LONG_BLANK = 100_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def byte_level_encoder(path: str):
    """text -> uint32 ids of the byte-level BPE file at path; the strings of its added tokens become these, as in its own library.

    The file's vocabulary is in merge order, so its ids serve as merge ranks, and the rank-based encoder
    gives the same ids as the file's own library, several times faster.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(open(path, encoding="utf-8").read())
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    blanks = re.compile(rf"\s{{{LONG_BLANK}}}")

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_BLANK and blanks.search(text):
            return np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, np.uint32)
        return encoding.encode_to_numpy(text, allowed_special="all")

    return encode


class Packer:
    """Pieces of documents in windows of `size` ids; finished pieces are returned as they leave."""

    def __init__(self, size: int, open_windows: int, first_sequence: int):
        self.size, self.most, self.next = size, open_windows, first_sequence
        self.open: list[list] = []  # [room, [pieces]]; a piece: (doc, start, ids, doc_tokens)

    def _emit(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, self.next, at
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, at = len(ids), 0
        while total - at >= self.size:
            yield from self._emit([(doc, at, ids[at : at + self.size], total)])
            at += self.size
        while at < total:
            need = total - at
            best = min((w for w in self.open if w[0] >= need), key=lambda w: w[0], default=None)
            if best is None and len(self.open) >= self.most:
                best = min(self.open, key=lambda w: w[0])
                need = best[0]
            elif best is None:
                best = [self.size, []]
                self.open.append(best)
            best[1].append((doc, at, ids[at : at + need].copy(), total))
            best[0] -= need
            at += need
            if not best[0]:
                self.open = [w for w in self.open if w is not best]
                yield from self._emit(best[1])

    def finish(self) -> Iterator[tuple]:
        left = sorted(self.open, key=lambda w: w[0])
        self.open = []
        while left:
            full = left.pop(0)
            while full[0] and left:
                doc, start, ids, total = left[-1][1].pop()
                take = min(full[0], len(ids))
                full[1].append((doc, start, ids[:take], total))
                full[0] -= take
                left[-1][0] += take
                if take < len(ids):
                    left[-1][1].append((doc, start + take, ids[take:], total))
                if not left[-1][1]:
                    left.pop()
            if not full[0]:
                yield from self._emit(full[1])
                continue
            rest = full[1]
            while rest:
                length = 1 << (sum(len(p[2]) for p in rest).bit_length() - 1)
                part: list = []
                while length:
                    doc, start, ids, total = rest.pop(0)
                    take = min(length, len(ids))
                    part.append((doc, start, ids[:take], total))
                    length -= take
                    if take < len(ids):
                        rest.insert(0, (doc, start + take, ids[take:], total))
                yield from self._emit(part)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, open_windows: int = 64, end_id: int = 0) -> DataFrame:
    """One row per piece of every document (doc_id, text): place, digest and window."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kind = pa.schema([(n, pa.int64()) for n in names])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(tokenizer)
        packer = Packer(size, open_windows, TaskContext.get().partitionId() << SEQUENCE_BITS)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=kind)
            rows.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                rows.extend(packer.add(doc.as_py(), ids))
                if len(rows) > 20_000:
                    yield flush()
        rows.extend(packer.finish())
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
