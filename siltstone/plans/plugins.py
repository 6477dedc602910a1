"""Model boundaries: protocols for what needs a model, and deterministic offline stand-ins.

An implementation gives Column expressions (or vectorised UDFs); nothing else of the engine knows which one runs.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import fusion


class Embedder(Protocol):
    model: str
    dim: int
    passage_prefix: str
    query_prefix: str

    def embed(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, question: Column, text: Column) -> Column: ...


class Judge(Protocol):
    def reply(self, question: Column, answer: Column, reference: Column) -> Column: ...


class Generator(Protocol):
    def answer(self, prompt: Column, question: Column, contexts: Column) -> Column: ...


def summed_slots(tokens: Column, dim: int) -> Column:
    """Tokens -> unit vector of signed counts by slot, in Arrow batches; each distinct token of a batch is hashed once."""

    @F.arrow_udf("array<float>")
    def embed(batch: pa.Array) -> pa.Array:
        words = batch.flatten().dictionary_encode()
        digests = [hashlib.md5(w.encode()).hexdigest() for w in words.dictionary.to_pylist()]
        slot = np.array([int(h[:8], 16) % dim for h in digests], np.int64)
        sign = np.array([1 if h[8] < "8" else -1 for h in digests], np.int64)
        which = words.indices.to_numpy()
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy()
        row = np.repeat(np.arange(len(batch)), sizes)
        v = np.bincount(row * dim + slot[which], sign[which], len(batch) * dim).reshape(-1, dim) if len(which) else np.zeros((len(batch), dim))
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(0, v.size + 1, dim, dtype=np.int32), pa.array(v.ravel()))

    return embed(tokens)


class HashingEmbedder:
    """Signed feature hashing of tokens by their MD5, scaled to length one: the same on every machine."""

    passage_prefix, query_prefix = "passage: ", "query: "

    def __init__(self, dim: int = 64):
        self.dim, self.model = dim, f"hashing-md5-{dim}"

    def embed(self, text: Column) -> Column:
        """Slot: the first eight hexadecimal digits modulo dim; sign: plus if the ninth is below 8."""
        return summed_slots(T.sparse_tokens(text), self.dim)


    def token_vectors(self, tokens: Column) -> Column:
        """Unit vectors of single tokens, for matching token by token: one slot with its sign each."""
        dim = self.dim

        @F.arrow_udf("array<array<float>>")
        def embed(batch: pa.Array) -> pa.Array:
            words = batch.flatten().dictionary_encode()
            digests = [hashlib.md5(w.encode()).hexdigest() for w in words.dictionary.to_pylist()]
            v = np.zeros((len(digests), dim), np.float32)
            for i, h in enumerate(digests):
                v[i, int(h[:8], 16) % dim] = 1 if h[8] < "8" else -1
            which = words.indices.to_numpy()
            inner = pa.ListArray.from_arrays(np.arange(0, len(which) * dim + 1, dim, dtype=np.int32), pa.array(v[which].ravel()))
            return pa.ListArray.from_arrays(np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy())).astype(np.int32), inner)

        return embed(tokens)


class OverlapReranker:
    def score(self, question: Column, text: Column) -> Column:
        return fusion.token_overlap(question, text, T.metric_tokens)


class OverlapJudge:
    """Accepts an answer that has half of the reference's tokens; replies as a model would, in fenced JSON."""

    def reply(self, question: Column, answer: Column, reference: Column) -> Column:
        s = F.bround(fusion.token_overlap(reference, answer, T.metric_tokens), 4)
        verdict = F.when(s >= 0.5, "acceptable").otherwise("incorrect")
        return F.concat(F.lit("```json\n"), F.to_json(F.struct(s.alias("score"), verdict.alias("verdict"), F.lit("token overlap").alias("reason"))), F.lit("\n```"))


class SemanticJudge(Protocol):
    def faithfulness(self, question: Column, answer: Column, contexts: Column) -> Column: ...

    def context_precision(self, question: Column, reference: Column, contexts: Column) -> Column: ...


class Similarity(Protocol):
    """A batch scorer of answers against references, as BERTScore is: F1 from 0 to 1."""

    def f1(self, answer: Column, reference: Column) -> Column: ...


class OverlapSemanticJudge:
    """Token shares: of the answer in all contexts, and of contexts that have a token of the reference."""

    def faithfulness(self, question: Column, answer: Column, contexts: Column) -> Column:
        return fusion.token_overlap(answer, F.array_join(contexts, " "), T.metric_tokens)

    def context_precision(self, question: Column, reference: Column, contexts: Column) -> Column:
        hit = F.filter(contexts, lambda c: F.arrays_overlap(T.metric_tokens(c), T.metric_tokens(reference)))
        return F.when(F.size(contexts) > 0, F.size(hit) / F.size(contexts)).otherwise(F.lit(0.0))


class EmbeddingSimilarity:
    """Cosine of hashing embeddings, cut at 0."""

    def __init__(self, embedder: Embedder):
        self.embedder = embedder

    def f1(self, answer: Column, reference: Column) -> Column:
        a, b = self.embedder.embed(answer), self.embedder.embed(reference)
        product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), product)), 4)


def with_retries(call: Callable, tries: int = 5, wait: float = 10.0, sleep: Callable = time.sleep):
    """call() once it succeeds; after the n-th failure it waits n times `wait` seconds, and the last failure is raised."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if n == tries:
                raise
            sleep(n * wait)


class ExtractiveGenerator:
    """The first sentence of every context with its source number."""

    def answer(self, prompt: Column, question: Column, contexts: Column) -> Column:
        cited = F.transform(contexts, lambda x, i: F.concat(F.regexp_extract(x, r"(?s)^(.*?[.!?\n]|.+)", 1), F.lit(" [Source "), (i + 1).cast("string"), F.lit("]")))
        return F.array_join(cited, " ")
