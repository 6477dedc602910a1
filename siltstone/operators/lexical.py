"""Postings, statistics and BM25 of tables that have no stored index (see `inverted` for one), as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.stem_fr import stem_all
from siltstone.sources.files import materialise


K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str, tokens: Column, terms: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, dl): term counts of every document with its length; with `terms` only of these terms."""
    t = docs.select(key, tokens.alias("__t")).withColumn("dl", F.size("__t"))
    t = t.select(key, "dl", F.explode("__t").alias("term"))
    if terms is not None:
        t = t.join(terms.select("term").distinct(), "term", "left_semi")
    return t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def term_statistics(posted: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of every term."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def stems(terms: DataFrame) -> DataFrame:
    """(term) -> (term, stem): every distinct term is stemmed once, whatever the number of its occurrences."""
    t = terms.select("term").distinct().withColumn("__a", stem_all(F.array("term")))
    return t.select("term", F.get("__a", 0).alias("stem")).where("stem <> ''")


def tokenised(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, dl, tokens) as a written table: texts are read and cut into tokens once, and dl is read without the tokens."""
    t = docs.select(key, tokens.alias("tokens"))
    return materialise(t.select(key, F.size("tokens").alias("dl"), "tokens"), "tokens")


def bm25(docs: DataFrame, key: str, queries: DataFrame, query_key: str, tokens, text: str = "text", k1: float = K1, b: float = B, stemmed: bool = False) -> DataFrame:
    """(query_key, key, score): sums over query terms, repeats of a query term counted; stemmed: terms are the stems of tokens."""
    return bm25_tokens(tokenised(docs, key, tokens(F.col(text))), key, queries.select(query_key, F.explode(tokens(F.col(text))).alias("term")), query_key, k1, b, stemmed)


def bm25_tokens(corpus: DataFrame, key: str, q: DataFrame, query_key: str, k1: float = K1, b: float = B, stemmed: bool = False) -> DataFrame:
    """The same over a stored index (key, dl, tokens) and query terms (query_key, term).

    Only terms that some query has are counted; their postings are written once, for document frequencies and for weights. A term
    meets the queries with its weights in a join that adaptive execution splits where the term is hot.
    """
    words = corpus.select(key, "dl", F.explode("tokens").alias("term"))
    if stemmed:
        q = q.join(stems(q), "term").select(query_key, F.col("stem").alias("term"))
    q = q.groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = q.select("term").distinct()
    if stemmed:
        known = stems(words).join(asked.withColumnRenamed("term", "stem"), "stem", "left_semi")
        words = words.join(known, "term").select(key, "dl", F.col("stem").alias("term"))
    else:
        words = words.join(asked, "term", "left_semi")
    posted = materialise(words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")), "postings")
    s = corpus.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    idf = term_statistics(posted).crossJoin(F.broadcast(s)).select("term", "avgdl", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighted = posted.join(idf, "term").select(key, "term", weight.alias("w"))
    return q.join(weighted, "term").groupBy(query_key, key).agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))


def top_k(scored: DataFrame, query_key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of every query with their rank; the limit is applied before the shuffle, too."""
    w = Window.partitionBy(query_key).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
