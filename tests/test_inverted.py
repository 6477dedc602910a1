"""The stored inverted index: equal to a full scan, reads only what a question needs, skips blocks that cannot matter."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import inverted


def brute(docs, queries, k, k1=1.5, b=0.75):
    cut = lambda t: re.findall(r"\b\w\w+\b", (t or "").lower())
    tf = {i: Counter(cut(t)) for i, t in docs}
    dl = {i: len(cut(t)) for i, t in docs}
    avg, out = sum(dl.values()) / len(docs), []
    df = Counter(w for c in tf.values() for w in c)
    for q, text in queries:
        scores = []
        for i, c in tf.items():
            s = sum(n * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + k1 * (1 - b + b * dl[i] / avg)) for w, n in Counter(cut(text)).items() if c[w])
            if s:
                scores.append((-round(s, 9), i))
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i:03d}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum()))) for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (n + 2, "zz only here"), (n + 3, docs[5][1]), (n + 4, "long " * 5000)]


def opened(spark, docs, path, **more):
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    return inverted.open_or_build(spark, f"file://{path}", df, "id", T.sparse_tokens(F.col("text")), **more)


def asked(spark, queries):
    return spark.createDataFrame(queries, "qid long, text string").select("qid", F.explode(T.sparse_tokens(F.col("text"))).alias("term"))


QUERIES = [(1, "w000 w001 w002"), (2, "w390 w000"), (3, "zz w399 w399"), (4, "nowhere"), (5, ""), (6, "long w000")]


@pytest.mark.parametrize("k,probe,k1", [(5, 4, 1.5), (1, 1, 1.2), (2000, 2, 1.5)])
def test_equals_a_full_scan(spark, tmp_path, k, probe, k1):
    docs = corpus()
    index = opened(spark, docs, tmp_path)
    got = inverted.top_k(index, asked(spark, QUERIES), "qid", k, k1, probe=probe).collect()
    assert sorted((r.qid, r.key, r["rank"]) for r in got) == brute(docs, QUERIES, k, k1)


def test_a_question_opens_the_folders_of_its_terms(spark, tmp_path):
    index = opened(spark, corpus(), tmp_path, buckets=64)
    blocks = inverted.of_terms(index, asked(spark, [(1, "w007 w350")]))
    folders = {re.search(r"bucket=(\d+)", p)[1] for p in (r.p for r in blocks.select(F.col("_metadata.file_path").alias("p")).distinct().collect())}
    assert 1 <= len(folders) <= 2
    scan = blocks.select("term", "range", "max_tf")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in scan and "keys" not in scan.split("ReadSchema")[1]


def test_skips_ranges_that_cannot_reach_the_kth_score(spark, tmp_path):
    rare = [(i, "common filler text") for i in range(4000)]
    for i in (100, 101, 102, 2100, 3900):
        rare[i] = (i, "common needle")
    rare += [(i, "common " + "filler " * 40) for i in range(4000, 12_000)]
    df = spark.createDataFrame(rare, "id long, text string").coalesce(1)
    index = inverted.open_or_build(spark, f"file://{tmp_path}", df, "id", T.sparse_tokens(F.col("text")))
    q = asked(spark, [(1, "needle common")])
    weighted = inverted.asked(index, q, "qid").withColumn("w", F.when(F.col("term") == "needle", 7.0).otherwise(1e-4))
    limit = inverted.bounds(index, weighted, inverted.of_terms(index, q), "qid").collect()
    assert len(limit) == 94 and sum(r.bound > 1 for r in limit) == 3
    assert [(r.key, r["rank"]) for r in inverted.top_k(index, q, "qid", 5).orderBy("rank").collect()] == [(100, 1), (101, 2), (102, 3), (2100, 4), (3900, 5)]


def test_bounds_hold(spark, tmp_path):
    docs = corpus(1200, 3)
    index = opened(spark, docs, tmp_path)
    q = asked(spark, QUERIES)
    weighted = inverted.asked(index, q, "qid").withColumn("w", F.lit(1.0))
    blocks = inverted.of_terms(index, q)
    limit = inverted.bounds(index, weighted, blocks, "qid")
    place = index.postings.select("range", F.explode("keys").alias("key")).distinct()
    every = inverted.scored(index, limit, weighted, blocks, "qid").join(place, "key").join(limit, ["qid", "range"])
    assert every.count() > 1000 and every.where("score > bound + 1e-9").count() == 0


def test_blocks_are_small_and_unrelated_documents_add_none(spark, tmp_path):
    docs = corpus()
    a = opened(spark, docs, tmp_path / "a")
    b = opened(spark, docs + [(10_000 + i, f"other{i % 50} words{i % 7}") for i in range(3000)], tmp_path / "b")
    assert a.postings.agg(F.max("n")).first()[0] <= inverted.RANGE
    size = lambda i: inverted.of_terms(i, asked(spark, QUERIES)).where("term like 'w%' and term not like 'words%'").agg(F.sum("n")).first()[0]
    assert size(a) == size(b)
    assert {(r.term, r.df, r.cf) for r in inverted.statistics(a).collect()} >= {("zz", 1, 1), ("long", 1, 5000)}


def test_stored_and_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        inverted.open_or_build(spark, f"file://{tmp_path}/none", None, "id", F.lit(None))
    built = opened(spark, [(1, "alpha beta"), (2, "beta")], tmp_path / "x")
    again = inverted.open_or_build(spark, f"file://{tmp_path}/x", None, "id", F.lit(None))
    assert (again.n_docs, again.avgdl) == (built.n_docs, built.avgdl) == (2, 1.5)
    assert opened(spark, [(1, "alpha")], tmp_path / "x", force=True).n_docs == 1
    with pytest.raises(ValueError, match="stems"):
        inverted.open_or_build(spark, f"file://{tmp_path}/x", None, "id", F.lit(None), stemmed=True)
    for i, docs in enumerate(([], [(1, None)])):
        empty = opened(spark, docs, tmp_path / f"empty{i}")
        assert inverted.top_k(empty, asked(spark, QUERIES), "qid", 3).count() == 0


def test_stems(spark, tmp_path):
    index = opened(spark, [(1, "le licenciement économique"), (2, "les licenciements"), (3, "un préavis")], tmp_path, stemmed=True)
    got = inverted.top_k(index, asked(spark, [(1, "licencier")]), "qid", 5).collect()
    assert {r.key for r in got} == {1, 2}


def test_neither_tokens_nor_pairs_are_shuffled(spark, tmp_path):
    """What is dealt out are blocks, and k rows of each question and group of ranges; not a row for each document that has a question's word."""
    docs = [(i, f"common words of all w{i % 7}") for i in range(4000)]
    index = opened(spark, docs, tmp_path)
    weighted = inverted.asked(index, asked(spark, [(j, "common words of all") for j in range(20)]), "qid").withColumn("w", F.lit(1.0))
    found = inverted.best(index, weighted, index.postings, "qid", 5, group_docs=1000, query_rows=8)
    assert 20 * 5 <= found.count() <= 20 * 4000 and found.groupBy("qid").agg(F.min("score").alias("s")).select("s").distinct().count() == 1
    few = inverted.best(index, weighted.withColumn("w", F.when(F.col("term") == "all", 1.0 + F.col("qid")).otherwise(1e-3)), index.postings.where("term <> 'w1'"), "qid", 5)
    assert {r.qid for r in few.collect()} == set(range(20))
    got = inverted.top_k(index, asked(spark, [(j, f"common w{j}") for j in range(7)]), "qid", 3).collect()
    assert sorted((r.qid, r.key, r["rank"]) for r in got) == [(j, j + 7 * i, i + 1) for j in range(7) for i in range(3)]


def test_a_range_is_a_row_for_each_bucket_and_is_written_where_it_is_read(spark, tmp_path, monkeypatch):
    """A row for each term and range would be six times the texts, shuffled to be written; asked words cut the rows down before they are dealt out."""
    docs = corpus()
    df = spark.createDataFrame(docs, "id long, text string").coalesce(2)
    index = inverted.open_or_build(spark, f"file://{tmp_path}", df, "id", T.sparse_tokens(F.col("text")))
    ranges = index.stored.where("bucket = -1").count()
    assert ranges * 2 < index.stored.count() <= ranges * (inverted.BUCKETS + 1) < index.postings.count()
    assert len(list(tmp_path.glob("postings/bucket=0/*.parquet"))) <= 2
    q = inverted.asked(index, asked(spark, QUERIES), "qid")
    few = inverted.asked_rows(index, q)
    terms = lambda rows: {r.t for r in rows.select(F.explode("terms").alias("t")).distinct().collect()}
    assert terms(few) == {"w000", "w001", "w002", "w390", "w399", "zz", "long"} & terms(index.stored) and few.count() < index.stored.count()
    own = lambda b: sorted((r.term, r.range, r.n, r.max_tf, r.min_dl, r.cf, tuple(r["keys"]), tuple(r.tfs), tuple(r.dls)) for r in b.collect())
    assert own(inverted._blocks(few)) == own(index.postings.join(q.select("term").distinct(), "term", "left_semi"))
    monkeypatch.setattr(inverted, "MOST_ASKED", 1)
    got = inverted.top_k(index, asked(spark, QUERIES), "qid", 5).collect()
    assert sorted((r.qid, r.key, r["rank"]) for r in got) == brute(docs, QUERIES, 5)


@pytest.mark.parametrize("k,probe,k1", [(5, 4, 1.5), (2000, 2, 1.2)])
def test_whole_ranges_are_scored_where_they_are_read(spark, tmp_path, monkeypatch, k, probe, k1):
    """With one bucket no stored row is written again or shuffled: what goes on are k rows of each question."""
    docs = corpus()
    index = opened(spark, docs, tmp_path, buckets=1)
    want = brute(docs, QUERIES, k, k1)
    rows = lambda: sorted((r.qid, r.key, r["rank"]) for r in inverted.top_k(index, asked(spark, QUERIES), "qid", k, k1, probe=probe).collect())
    with monkeypatch.context() as m:
        m.setattr(inverted, "asked_rows", None)
        m.setattr(inverted, "RANGES_AT_ONCE", 3)
        assert rows() == want
    monkeypatch.setattr(inverted, "MOST_WEIGHTS", 0)
    assert rows() == want
    monkeypatch.undo()
    empty = opened(spark, [], tmp_path / "empty", buckets=1)
    assert inverted.top_k(empty, asked(spark, QUERIES), "qid", 3).count() == 0 == inverted.top_k(index, asked(spark, [(1, "")]), "qid", 3).count()
