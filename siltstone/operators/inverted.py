"""A stored inverted index: postings in blocks with bounds, looked up by term, and top-k that skips blocks which cannot matter.

Documents are numbered into ranges of RANGE rows as they are read. A block is what one term has in one range: its documents, their counts, the largest
count and the smallest length. A stored row has all blocks of a range whose terms fall into one bucket, as arrays (`ends`: where the documents of each
term end in `docs` and `tfs`; `docs`: places in `ids` and `dls`), and is written where the rows are read: nothing is shuffled to build an index, and a
term costs its text and four numbers a range, not a row. Buckets are folders, so few questions open the folders of their terms only; a
term that is everywhere spreads over as many rows as there are ranges, and no list of a term's documents exists. `postings` shows a row for each block.
With one bucket a row is a whole range; what searches such an index for many questions at once scores rows where they are read and shuffles k rows a question and task only.
`stats` has the number of documents and their mean length; it is written last, so an index without it is unfinished and is built again.

A block bounds the score of its documents for any k1 and b, as BM25 grows with the count and falls with the length. `top_k` deals ranges to
tasks, which score PROBE ranges at a time and leave out those whose sum of bounds does not reach a question's k-th score so far.
What it skips has a smaller score for certain, so the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions.stem_fr import stem
from siltstone.operators.lexical import B, K1, stems
from siltstone.sources.files import batches_of, exists, materialise

#: Rows that Python reads at a time: documents, and stored rows.
DOCS_AT_ONCE, ROWS_AT_ONCE = 1_000, 256
#: Distinct asked terms up to which they go to where the index is read.
MOST_ASKED = 100_000
#: Weights of terms of questions up to which they go to where an index of one bucket is read, and rows of whole ranges that Python reads at a time.
MOST_WEIGHTS, RANGES_AT_ONCE = 200_000, 64
#: Bits of a row number within its range: a block has at most this many documents.
RANGE_BITS = 7
RANGE = 1 << RANGE_BITS
#: Ranges that a task scores at a time.
PROBE = 4
#: Bucket of the heads of ranges, and of terms if not told otherwise.
HEADS, BUCKETS = -1, 8
#: Distinct tokens whose stems a task remembers.
MOST_KNOWN = 1_000_000
#: Bounds and scores are sums in any order; so much is left between them.
SLACK = 1e-6


@dataclass
class Inverted:
    """An index that is opened: its blocks, and what holds for all documents."""

    stored: DataFrame
    n_docs: int
    avgdl: float
    buckets: int
    stemmed: bool

    @property
    def postings(self) -> DataFrame:
        """The blocks of terms; what is stored has a head of each range, too."""
        return _blocks(self.stored.where(F.col("bucket") > HEADS))


def _schema(kind: str) -> str:
    return f"range long, terms array<string>, ends array<int>, max_tfs array<int>, min_dls array<int>, cfs array<long>, docs array<tinyint>, tfs array<int>, ids array<{kind}>, dls array<int>, bucket int"


def _blocks(rows: DataFrame) -> DataFrame:
    """(term, range, n, max_tf, min_dl, cf, keys, tfs, dls) and `_metadata` of the file: a row for each block of stored rows."""
    each = rows.select("*", "_metadata", F.posexplode("terms").alias("i", "term"))
    at = lambda c: F.get(c, F.col("i"))
    start = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(0)
    n = at("ends") - start
    docs = F.slice("docs", start + 1, n)
    of_docs = lambda c: F.transform(docs, lambda d: F.get(c, d.cast("int")))
    return each.select(
        "term", "range", n.alias("n"), at("max_tfs").alias("max_tf"), at("min_dls").alias("min_dl"), at("cfs").alias("cf"),
        of_docs("ids").alias("keys"), F.slice("tfs", start + 1, n).alias("tfs"), of_docs("dls").alias("dls"), "_metadata",
    )


def _packed(blocks: DataFrame) -> DataFrame:
    """Blocks as stored rows of one term each."""
    one = lambda c: F.array(c)
    docs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda d: d.cast("tinyint"))
    return blocks.select("range", one("term").alias("terms"), one("n").alias("ends"), one("max_tf").alias("max_tfs"), one("min_dl").alias("min_dls"), docs.alias("docs"), "tfs", F.col("keys").alias("ids"), "dls")


def _bucket(buckets: int) -> Column:
    """By the bytes of a term and the last of them, so that a task finds it for all its terms at once, too."""
    last = F.conv(F.hex(F.substring(F.encode("term", "UTF-8"), -1, 1)), 16, 10).cast("int")
    return F.pmod(5 * F.octet_length("term") + F.coalesce(last, F.lit(0)), F.lit(buckets)).cast("int")


def _buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """`_bucket` of each word."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    size, text = np.diff(at), np.frombuffer(words.buffers()[2] or b"", np.uint8)
    last = np.zeros(len(words), np.int64)
    last[size > 0] = text[at[1:][size > 0] - 1]
    return (5 * size + last) % buckets


def _cut(key_type: pa.DataType, stemmed: bool, buckets: int):
    """Batches of (key, tokens) -> stored rows, one range after the other; the head of a range has no term, and the number of its rows and of their tokens as `ends` and `cfs`."""
    names = ["range", "terms", "ends", "max_tfs", "min_dls", "cfs", "docs", "tfs", "ids", "dls", "bucket"]
    known: dict[str, str] = {}

    def stem_of(w: str) -> str:
        if w not in known:
            if len(known) == MOST_KNOWN:
                known.clear()
            known[w] = stem(w)
        return known[w]

    def rows(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        key, tokens = t["key"].combine_chunks().cast(key_type), t["tokens"].combine_chunks()
        length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = tokens.flatten().dictionary_encode()
        words, code = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(length)), length)
        if stemmed:
            cut = pa.array([stem_of(w) for w in words.to_pylist()], pa.string()).dictionary_encode()
            words, code = cut.dictionary, cut.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
            some = np.array([w != "" for w in words.to_pylist()], bool)[code] if len(code) else np.zeros(0, bool)
            code, doc = code[some], doc[some]
        words = words.cast(pa.string())
        bucket = _buckets(words, buckets)
        by = np.argsort(bucket, kind="stable")
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        words, bucket, code = words.take(pa.array(by)), bucket[by], place[code]
        pair, tf = np.unique((code << RANGE_BITS) | doc, return_counts=True)
        code, doc = pair >> RANGE_BITS, pair & (RANGE - 1)
        dl = length[doc]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        term = code[first]
        have, cut = np.unique(bucket[term], return_index=True)  # terms of a bucket stand together
        cut = np.append(cut, len(term))
        start = np.append(first, len(pair))[cut]
        n = np.diff(np.append(first, len(pair)))
        ends = np.append(first, len(pair))[1:] - np.repeat(start[:-1], np.diff(cut)) if len(term) else n
        over = lambda f, x: f.reduceat(x, first) if len(first) else x
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
        # The last row is the head: it has one number in `ends` and `cfs`, and nothing else.
        of_term = lambda x, kind, head=(): lists(np.append(cut, cut[-1] + len(head)), pa.array(np.append(x, np.array(head, np.int64)), kind))
        of_pair = lambda x, kind: lists(np.append(start, start[-1]), pa.array(x, kind))
        of_doc = lambda x: lists(np.append(np.arange(len(have) + 1) * len(length), len(have) * len(length)), pa.concat_arrays([x] * max(1, len(have))))
        columns = [
            pa.array(np.full(len(have) + 1, number), pa.int64()), lists(np.append(cut, cut[-1]), words.take(pa.array(term))), of_term(ends, pa.int32(), [len(length)]), of_term(over(np.maximum, tf), pa.int32()),
            of_term(over(np.minimum, dl), pa.int32()), of_term(over(np.add, tf), pa.int64(), [length.sum()]), of_pair(doc, pa.int8()), of_pair(tf, pa.int32()), of_doc(key), of_doc(pa.array(length, pa.int32())), pa.array(np.append(have, HEADS), pa.int32()),
        ]
        return pa.record_batch(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << (33 - RANGE_BITS), [], 0
        for b in batches:
            at = 0
            while at < len(b):
                held.append(b.slice(at, RANGE - n))
                at, n = at + len(held[-1]), n + len(held[-1])
                if n == RANGE:
                    yield rows(held, number)
                    number, held, n = number + 1, [], 0
        if held:
            yield rows(held, number)

    return run


def build(docs: DataFrame, key: str, tokens: Column, path: str, stemmed: bool = False, buckets: int = BUCKETS) -> None:
    """Write the index of docs under path. `stemmed`: terms are stems of tokens; lengths count tokens. Every task writes what it has read, so nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), tokens.alias("tokens"))
    stored = rows.mapInArrow(_cut(to_arrow_type(docs.schema[key].dataType), stemmed, buckets), _schema(kind))
    with batches_of(docs.sparkSession, DOCS_AT_ONCE):
        stored.sortWithinPartitions("bucket", "range").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    heads = docs.sparkSession.read.schema(_schema(kind)).parquet(f"{path}/postings").where(F.col("bucket") == HEADS).select(F.get("ends", F.lit(0)).alias("n"), F.get("cfs", F.lit(0)).alias("cf"))
    n_docs = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    stats = heads.agg(n_docs.alias("n_docs"), F.coalesce(F.sum("cf") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("avgdl"))
    stats.select("*", F.lit(buckets).alias("buckets"), F.lit(stemmed).alias("stemmed"), F.lit(kind).alias("key_type")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def built(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/stats/_SUCCESS")


def open_or_build(spark: SparkSession, path: str, docs: DataFrame | None, key: str, tokens: Column, stemmed: bool = False, force: bool = False, buckets: int = BUCKETS) -> Inverted:
    """The index under path; a missing or unfinished one, or one that is to be rebuilt, is built from docs first."""
    if force or not built(spark, path):
        if docs is None:
            raise FileNotFoundError(f"no index at {path} and no documents to build it from")
        build(docs, key, tokens, path, stemmed, buckets)
    about = spark.read.parquet(f"{path}/stats").first()
    if about.stemmed != stemmed:
        raise ValueError(f"the index at {path} is {'' if about.stemmed else 'not '}over stems; rebuild it")
    return Inverted(spark.read.schema(_schema(about.key_type)).parquet(f"{path}/postings"), about.n_docs, about.avgdl, about.buckets, stemmed)


def asked(index: Inverted, terms: DataFrame, query_key: str) -> DataFrame:
    """(query_key, term, qtf) of query terms, with repeats; stems if the index has stems."""
    if index.stemmed:
        terms = terms.join(stems(terms), "term").select(query_key, F.col("stem").alias("term"))
    return terms.groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qtf"))


def rows_of_terms(index: Inverted, q: DataFrame) -> DataFrame:
    """Stored rows of the folders that the terms are in; at most `buckets` numbers reach the driver."""
    wanted = [r.b for r in q.select(_bucket(index.buckets).alias("b")).distinct().collect()]
    return index.stored.where(F.col("bucket").isin(wanted)) if wanted else index.stored.where("false")


def _hits(x: pa.Table, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of stored rows: which of all their terms are wanted; the row of each of these and its number of documents; and which places of `docs` are theirs."""
    size, ends = pc.list_value_length(x["terms"].combine_chunks()).to_numpy(), x["ends"].combine_chunks().flatten().to_numpy()
    some = pc.is_in(x["terms"].combine_chunks().flatten(), wanted).to_numpy(zero_copy_only=False)
    before = np.append(0, ends[:-1])[: len(ends)]
    before[(np.cumsum(size) - size)[size > 0]] = 0
    counts = ends - before
    return some, np.repeat(np.arange(len(size)), size)[some], counts[some], np.repeat(some, counts)


def _only_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored rows and the terms `wanted` of them -> the rows with these terms only; those without one are left out."""
    for b in batches:
        x = pa.Table.from_batches([b])
        some, of_row, counts, hit = _hits(x, pc.unique(x["wanted"].combine_chunks().flatten()))
        have, n = np.unique(of_row, return_counts=True)
        x = x.select([c for c in x.column_names if c != "wanted"])
        if not len(have):
            continue
        n_docs = np.bincount(of_row, counts, x.num_rows)[have].astype(np.int64)
        at = {True: np.append(0, np.cumsum(n)).astype(np.int32), False: np.append(0, np.cumsum(n_docs)).astype(np.int32)}
        out = {}
        for c in x.column_names:
            if c in ("range", "ids", "dls"):
                out[c] = x[c].take(pa.array(have)).combine_chunks()
            elif c == "ends":
                out[c] = pa.ListArray.from_arrays(at[True], pa.array(np.cumsum(counts) - np.repeat(at[False][:-1], n), pa.int32()))
            else:
                of_terms = c not in ("docs", "tfs")
                out[c] = pa.ListArray.from_arrays(at[of_terms], x[c].combine_chunks().flatten().filter(pa.array(some if of_terms else hit)))
        yield pa.RecordBatch.from_pydict(out)


def asked_rows(index: Inverted, q: DataFrame) -> DataFrame:
    """Stored rows of the folders that the terms are in, cut down to these terms where they are read, and written.

    With over MOST_ASKED distinct terms the rows stay whole; what searches them looks at asked terms only.
    """
    rows, terms = rows_of_terms(index, q), q.select("term").distinct()
    if terms.count() > MOST_ASKED:
        return rows
    words = terms.groupBy(_bucket(index.buckets).alias("bucket")).agg(F.collect_list("term").alias("wanted"))
    own = [c for c in rows.columns if c != "bucket"]
    with batches_of(q.sparkSession, ROWS_AT_ONCE):
        return materialise(rows.join(F.broadcast(words), "bucket").select(*own, "wanted").mapInArrow(_only_wanted, rows.select(*own).schema), "inverted-rows")


def of_terms(index: Inverted, q: DataFrame) -> DataFrame:
    """Blocks of the folders that the terms are in."""
    return _blocks(rows_of_terms(index, q))


def statistics(index: Inverted) -> DataFrame:
    """(term, df, cf) of every term, from the heads of its blocks."""
    return index.postings.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))


def _weight(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    return tf / (tf + k1 * (1 - b + b * dl / (avgdl or 1.0)))


def bounds(index: Inverted, weighted: DataFrame, blocks: DataFrame, query_key: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query_key, range, bound): no document of the range scores more for the query; ranges without any of its terms are left out."""
    heads = blocks.select("term", "range", "max_tf", "min_dl")
    most = F.sum(F.col("w") * _weight(F.col("max_tf"), F.col("min_dl"), index.avgdl, k1, b))
    return heads.join(weighted, "term").groupBy(query_key, "range").agg(most.alias("bound"))


def scored(index: Inverted, pairs: DataFrame, weighted: DataFrame, blocks: DataFrame, query_key: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query_key, key, score) of all documents in the given ranges (query_key, range) that have a term of the query."""
    wanted = pairs.select(query_key, "range").join(weighted, query_key)
    hit = wanted.join(blocks.select("term", "range", "keys", "tfs", "dls"), ["term", "range"])
    hit = hit.select(query_key, "w", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p"))
    part = F.col("w") * _weight(F.col("p.tfs"), F.col("p.dls"), index.avgdl, k1, b)
    return hit.groupBy(query_key, F.col("p.keys").alias("key")).agg(F.bround(F.sum(part), 9).alias("score"))


def _scorer(avgdl: float, k: int, k1: float, b: float, at_once: int):
    """Stored rows and weights (q, asked, w) -> query, key, score: the k best documents and those that round to the k-th of each query."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        key_type = x.schema.field("ids").type.value_type
        if not x.num_rows or not y.num_rows:
            return pa.table({"query": y["q"].slice(0, 0), "key": pa.array([], key_type), "score": pa.array([], pa.float64())})
        x = x.take(pa.array(np.argsort(x["range"].to_numpy(), kind="stable")))
        flat = lambda c: x[c].combine_chunks().flatten()
        asked_for, of_row, counts, hit = _hits(x, pc.unique(y["asked"]))
        words = flat("terms").filter(pa.array(asked_for))
        terms = pc.unique(words)
        term, place = pc.index_in(words, terms).to_numpy(), x["range"].to_numpy()[of_row]
        y = y.filter(pc.is_in(y["asked"], terms))
        of_y = pc.index_in(y["asked"], terms).to_numpy()
        asked = y["q"].combine_chunks().dictionary_encode()
        by = np.argsort(asked.indices.to_numpy(), kind="stable")
        cut = np.searchsorted(asked.indices.to_numpy()[by], np.arange(len(asked.dictionary) + 1))
        rows_of = [(of_y[by[i:j]], y["w"].to_numpy()[by[i:j]]) for i, j in zip(cut, cut[1:], strict=False)]
        n_ids = pc.list_value_length(x["ids"].combine_chunks()).to_numpy()
        at = (np.cumsum(n_ids) - n_ids)[np.repeat(of_row, counts)] + flat("docs").to_numpy()[hit]
        ends = np.append(0, np.cumsum(counts))
        keys = flat("ids").dictionary_encode()
        code = keys.indices.to_numpy()[at]
        part = _weight(flat("tfs").to_numpy()[hit].astype(float), flat("dls").to_numpy()[at], avgdl, k1, b)
        most = _weight(flat("max_tfs").to_numpy()[asked_for].astype(float), flat("min_dls").to_numpy()[asked_for], avgdl, k1, b)
        starts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
        have = [(np.zeros(0, np.int64), np.zeros(0)) for _ in rows_of]
        least = np.full(len(rows_of), -np.inf)
        for r in range(0, len(starts) - 1, at_once):
            i, j = starts[r], starts[min(r + at_once, len(starts) - 1)]
            docs, column = np.unique(code[ends[i] : ends[j]], return_inverse=True)
            score, bound = np.zeros((len(terms), len(docs))), np.zeros(len(terms))
            score[np.repeat(term[i:j], np.diff(ends[i : j + 1])), column] = part[ends[i] : ends[j]]
            np.maximum.at(bound, term[i:j], most[i:j])
            for n, (row, w) in enumerate(rows_of):
                if w @ bound[row] < least[n] - SLACK:
                    continue
                s = w @ score[row]
                some = np.flatnonzero((s > 0) & (s >= least[n] - SLACK))
                if not len(some):
                    continue
                c, s = np.append(have[n][0], docs[some]), np.append(have[n][1], s[some])
                if len(s) > k:
                    least[n] = np.partition(s, len(s) - k)[len(s) - k]
                    stay = s >= least[n] - 2e-9  # all that may round to the k-th score
                    c, s = c[stay], s[stay]
                have[n] = c, s
        n = np.repeat(np.arange(len(have)), [len(c) for c, _ in have])
        c = np.concatenate([c for c, _ in have]) if have else np.zeros(0, np.int64)
        s = np.concatenate([s for _, s in have]) if have else np.zeros(0)
        return pa.table({"query": asked.dictionary.take(pa.array(n)), "key": keys.dictionary.take(pa.array(c)), "score": pa.array(s)})

    return run


def best(index: Inverted, weighted: DataFrame, blocks: DataFrame, query_key: str, k: int, k1: float = K1, b: float = B, at_once: int = PROBE, group_docs: int = 8_192, query_rows: int = 4_096) -> DataFrame:
    """(query_key, key, score): the k best documents and those that round to the k-th of each query in each group of ranges. `blocks`: stored rows or blocks.

    All rows of a range go to one task, which has the weights of up to query_rows queries and scores `at_once` ranges at a time; a query
    leaves out those whose bounds cannot reach its k-th score so far. So a row is shuffled once for query_rows queries,
    the pairs of documents and queries never, and k rows of each query and group go on.
    """
    groups = max(1, -(-index.n_docs // group_docs))
    n_q = weighted.select(query_key).distinct().count()
    q_blocks = max(1, -(-n_q // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks if "terms" in blocks.columns else _packed(blocks)
    left = left.select("range", "terms", "ends", "max_tfs", "min_dls", "docs", "tfs", "ids", "dls", F.pmod(F.xxhash64("range"), F.lit(groups)).cast("int").alias("g"), every(q_blocks).alias("qb"))
    right = weighted.select(F.col(query_key).alias("q"), F.col("term").alias("asked"), "w", F.pmod(F.xxhash64(query_key), F.lit(q_blocks)).cast("int").alias("qb2")).select("*", every(groups).alias("g2"))
    run = _scorer(index.avgdl, k, k1, b, at_once)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = left.groupBy("g", "qb").cogroup(right.groupBy("g2", "qb2")).applyInArrow(run, f"query {kind(weighted, query_key)}, key {left.schema['ids'].dataType.elementType.simpleString()}, score double")
    return found.select(F.col("query").alias(query_key), "key", F.bround("score", 9).alias("score"))


def _frequencies(rows: DataFrame, wanted: pa.Array) -> DataFrame:
    """(term, df) of the wanted terms, from the heads of their blocks; documents are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted), np.int64)
        for b in batches:
            x = pa.Table.from_batches([b])
            size, ends = pc.list_value_length(x["terms"].combine_chunks()).to_numpy(), x["ends"].combine_chunks().flatten().to_numpy()
            before = np.append(0, ends[:-1])[: len(ends)]
            before[(np.cumsum(size) - size)[size > 0]] = 0
            at = pc.index_in(x["terms"].combine_chunks().flatten(), wanted)
            some = at.is_valid().to_numpy(zero_copy_only=False)
            np.add.at(n, at.drop_null().to_numpy(), (ends - before)[some])
        yield pa.record_batch([wanted.filter(pa.array(n > 0)), pa.array(n[n > 0])], ["term", "n"])

    return rows.select("terms", "ends").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _best_where_read(index: Inverted, rows: DataFrame, weights: pa.Table, query_kind: str, k: int, k1: float, b: float, at_once: int) -> DataFrame:
    """As `best`, of rows that are whole ranges: each task scores a batch of what it reads at a time."""
    score = _scorer(index.avgdl, k, k1, b, at_once)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from score(pa.Table.from_batches([batch]), weights).to_batches()
            pa.default_memory_pool().release_unused()

    kind = rows.schema["ids"].dataType.elementType.simpleString()
    own = rows.select("range", "terms", "ends", "max_tfs", "min_dls", "docs", "tfs", "ids", "dls")
    return own.mapInArrow(run, f"query {query_kind}, key {kind}, score double").select("query", "key", F.bround("score", 9).alias("score"))


def top_k(index: Inverted, terms: DataFrame, query_key: str, k: int, k1: float = K1, b: float = B, probe: int = PROBE) -> DataFrame:
    """Query terms (query_key, term) -> query_key, key, score, rank: the k best documents of every query, ties to the smaller key."""
    q = materialise(asked(index, terms, query_key), "inverted-asked")
    order = Window.partitionBy(query_key).orderBy(F.col("score").desc(), "key")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    idf = F.log(1 + (F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if index.buckets == 1 and q.count() <= MOST_WEIGHTS:
        stored = index.stored.where(F.col("bucket") > HEADS)
        wanted = q.select("term").distinct().toArrow()["term"].combine_chunks().cast(pa.string())
        with batches_of(q.sparkSession, RANGES_AT_ONCE, True):
            weights = q.join(_frequencies(stored, wanted), "term").select(F.col(query_key).alias("q"), F.col("term").alias("asked"), (F.col("qtf") * idf).alias("w")).toArrow()
            found = _best_where_read(index, stored, weights, q.schema[query_key].dataType.simpleString(), k, k1, b, probe)
            return materialise(ranked(found.withColumnRenamed("query", query_key)), "inverted-top")
    rows = asked_rows(index, q)
    df = _blocks(rows).select("term", "n").join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weighted = materialise(q.join(df, "term").select(query_key, "term", (F.col("qtf") * idf).alias("w")), "inverted-weights")
    return ranked(best(index, weighted, rows, query_key, k, k1, b, probe))
