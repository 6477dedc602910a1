"""Per-question metrics: keyword recall, word F1, citation faithfulness, context coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.stem_fr import keyword_token, stem_all
from siltstone.operators.lexical import stems
from siltstone.operators.prompt import trimmed_contexts


def canonical_tokens(c: Column, stemmed: bool = True) -> Column:
    """Metric tokens without accents, stemmed, without keyword suffixes; empty ones dropped."""
    plain = F.transform(T.metric_tokens(c), T.fold_accents)
    done = F.transform(stem_all(plain), keyword_token) if stemmed else plain
    return F.filter(done, lambda x: x != "")


def tokens_match(a: Column, b: Column) -> Column:
    """Equal, or the shorter of five letters or more is a prefix of the longer."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 5) & (a.startswith(b) | b.startswith(a)))


def keyword_recall(prediction: Column, keywords: Column) -> Column:
    """Share of keywords (arrays of canonical tokens) whose tokens all match some token of the prediction; 1 without keywords.

    A keyword that occurs as a sequence has all its tokens, so this one test decides both forms of a hit.
    """
    hit = lambda k: F.forall(k, lambda t: F.exists(prediction, lambda p: tokens_match(p, t)))
    return F.when(F.size(keywords) <= 0, F.lit(1.0)).otherwise(F.size(F.filter(keywords, hit)) / F.size(keywords))


def canonical_rows(rows: DataFrame, stemmed: bool = True) -> DataFrame:
    """Rows with a token t -> the same with its canonical form, without those that have none; each distinct token is stemmed once."""
    plain = rows.withColumn("t", T.fold_accents(F.col("t")))
    if stemmed:
        known = stems(plain.select(F.col("t").alias("term"))).select(F.col("term").alias("t"), keyword_token(F.col("stem")).alias("__s"))
        plain = plain.join(known, "t").drop("t").withColumnRenamed("__s", "t")
    return plain.where("t <> ''")


def token_rows(df: DataFrame, key: str, text: str, stemmed: bool = True) -> DataFrame:
    """(key, t): the distinct canonical tokens of a text column."""
    return canonical_rows(df.select(key, F.explode(F.array_distinct(T.metric_tokens(F.col(text)))).alias("t")), stemmed).distinct()


def keyword_recalls(rows: DataFrame, key: str, keywords: DataFrame, found: DataFrame) -> DataFrame:
    """rows (key) with recall: the share of keywords (key, keyword, t: a row a canonical token) whose tokens all match one of found (key, t); 1 without keywords.

    Tokens that match have the same first five letters, or are equal and shorter; they meet by these, so a long text costs its tokens and
    not their product with those of the keywords.
    """
    start = lambda c: F.substring(c, 1, 5)
    have = found.select(F.col(key).alias("__k"), F.col("t").alias("__t"), start("t").alias("__p"))
    met = keywords.join(have, (F.col(key) == F.col("__k")) & (start("t") == F.col("__p")) & tokens_match(F.col("__t"), F.col("t")), "left")
    tokens = met.groupBy(key, "keyword", "t").agg(F.max(F.col("__t").isNotNull()).alias("__hit"))
    whole = tokens.groupBy(key, "keyword").agg(F.min("__hit").alias("__hit"))
    share = whole.groupBy(key).agg((F.count_if("__hit") / F.count(F.lit(1))).alias("recall"))
    return rows.join(share, key, "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))


def word_f1(df: DataFrame, key: str, prediction: str, reference: str) -> DataFrame:
    """(key, word_f1): multiset overlap of metric tokens; 0 if a side is empty.

    Counts meet by (key, token), so long texts cost their tokens, not products of these.
    """
    side = lambda c, n: df.select(key, F.explode(T.metric_tokens(F.col(c))).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias(n))
    common = side(prediction, "p").join(side(reference, "r"), [key, "t"]).groupBy(key).agg(F.sum(F.least("p", "r")).alias("c"))
    n = df.select(key, F.size(T.metric_tokens(F.col(prediction))).alias("np"), F.size(T.metric_tokens(F.col(reference))).alias("nr"))
    p, r = F.col("c") / F.col("np"), F.col("c") / F.col("nr")
    return n.join(common, key, "left").select(key, F.coalesce(2 * p * r / (p + r), F.lit(0.0)).alias("word_f1"))


def citation_faithfulness(answer: Column, n_sources: Column) -> Column:
    """Share of [Source n] marks with an existing number; 0 without marks."""
    c = T.citations(answer)
    return F.when(F.size(c) == 0, F.lit(0.0)).otherwise(F.bround(F.size(F.filter(c, lambda x: (x >= 1) & (x <= n_sources))) / F.size(c), 4))


def context_coverage(df: DataFrame, key: str, answer: str, context: str) -> DataFrame:
    """(key, context_coverage): share of the answer's tokens over three letters, repeats counted, that the context has; 1 without such tokens.

    Counted words meet the context's distinct words by (key, word): long texts cost their words, not products of these.
    """
    words = df.select(key, F.explode(T.metric_tokens(F.col(answer))).alias("t")).where(F.length("t") > 3).groupBy(key, "t").agg(F.count(F.lit(1)).alias("n"))
    have = df.select(F.col(key).alias("__k"), F.explode(F.array_distinct(T.metric_tokens(F.col(context)))).alias("__t"))
    found = words.join(have, (F.col(key) == F.col("__k")) & (F.col("t") == F.col("__t")), "left")
    share = found.groupBy(key).agg((F.sum(F.when(F.col("__t").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("__s"))
    return df.select(key).join(share, key, "left").select(key, F.bround(F.coalesce("__s", F.lit(1.0)), 4).alias("context_coverage"))


def token_weights(texts: DataFrame, text: str, tokens) -> DataFrame:
    """(t, w): inverse document frequencies of the tokens of reference texts, ln((n + 1) / (df + 1))."""
    each = texts.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    return each.crossJoin(F.broadcast(n)).select("t", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("w"))


#: Rows of an Arrow batch of token vectors.
MOST_ROWS = 1000


def token_similarity(df: DataFrame, key: str, prediction: str, reference: str, vectors, weights: DataFrame | None = None, tokens=T.metric_tokens) -> DataFrame:
    """(key, precision, recall, f1) by greedy matching of token vectors, every token to the one of the other side with the largest cosine.

    vectors: a column of tokens -> a column of their unit vectors, such as an encoder gives. weights (t, w) weigh the tokens, those not listed by the
    largest weight, as no reference has them; without weights all count the same. Cosines are matrix products row by row, in blocks; a side without tokens gives 0, as do
    weights that are all 0.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"  # a token is `dim` numbers, so ten thousand texts are a gigabyte
    if not 0 < int(df.sparkSession.conf.get(batch)) <= MOST_ROWS:
        df.sparkSession.conf.set(batch, MOST_ROWS)
    sides = {"p": prediction, "r": reference}
    d = df.select(key, *(tokens(F.coalesce(F.col(c), F.lit(""))).alias(n) for n, c in sides.items()))
    d = d.select("*", *(vectors(F.col(n)).alias(f"{n}v") for n in sides))
    if weights is not None:
        most = weights.agg(F.coalesce(F.max("w"), F.lit(1.0)).alias("__most"))
        for n in sides:
            w = d.select(key, F.posexplode(n).alias("i", "t")).join(weights, "t", "left").crossJoin(F.broadcast(most))
            w = w.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("w", "__most").alias("w")))).alias("x"))
            d = d.join(w.select(key, F.transform("x", lambda x: x.w).alias(f"{n}w")), key, "left")
    else:
        d = d.select("*", *(F.transform(n, lambda x: F.lit(1.0)).alias(f"{n}w") for n in sides))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [matched(*(_matrix(b.column(i)[j]) for i in (1, 2)), *(np.array(b.column(i)[j].as_py() or [], float) for i in (3, 4))) for j in range(len(b))]
            yield pa.record_batch([b.column(0), *(pa.array([r[i] for r in rows], pa.float64()) for i in range(3))], [key, "precision", "recall", "f1"])

    return d.select(key, "pv", "rv", "pw", "rw").mapInArrow(run, f"`{key}` {kind}, precision double, recall double, f1 double")


def _matrix(vectors: pa.Scalar) -> np.ndarray:
    inner = vectors.values
    if inner is None or not len(inner):
        return np.zeros((0, 0))
    return inner.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(inner), -1)


def matched(p: np.ndarray, r: np.ndarray, pw: np.ndarray, rw: np.ndarray, block: int = 1024) -> tuple[float, float, float]:
    """Precision, recall and F1 of token vectors p against r; a block of p against all of r at a time."""
    if not len(p) or not len(r):
        return 0.0, 0.0, 0.0
    of_p, of_r = np.empty(len(p)), np.full(len(r), -np.inf)
    for at in range(0, len(p), block):
        cos = p[at : at + block] @ r.T
        of_p[at : at + block] = cos.max(1)
        of_r = np.maximum(of_r, cos.max(0))
    share = lambda best, w: float(best @ w / w.sum()) if w.sum() > 0 else 0.0
    precision, recall = share(of_p, pw), share(of_r, rw)
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0


# Lengths of what a semantic judge reads, and what it says of missing inputs.
MOST_ANSWER = 1800
MISSING = ("missing_question", "missing_answer", "missing_reference_answer", "missing_retrieved_contexts")


def collapsed(c: Column) -> Column:
    return T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def judged_answer(answer: Column) -> Column:
    """The answer without source marks, white space collapsed, cut to what the judge reads."""
    return T.strip(F.left(collapsed(F.regexp_replace(answer, T.CITATION, "")), F.lit(MOST_ANSWER)))


def semantic_scores(question: Column, answer: Column, reference: Column, contexts: Column, judge) -> Column:
    """faithfulness, context_precision and error of a semantic judge; missing inputs are errors without a score, NaN is no score."""
    clean_answer, used = judged_answer(answer), trimmed_contexts(F.transform(contexts, collapsed))
    blank = [T.strip(F.coalesce(question, F.lit(""))) == "", clean_answer == "", T.strip(F.coalesce(reference, F.lit(""))) == "", F.size(used) == 0]
    error = F.lit(None).cast("string")
    for name, test in reversed(list(zip(MISSING, blank, strict=True))):
        error = F.when(test, F.lit(name)).otherwise(error)
    score = lambda c: F.when(error.isNull() & ~F.isnan(c), F.bround(c, 4))
    return F.struct(score(judge.faithfulness(question, clean_answer, used)).alias("faithfulness"), score(judge.context_precision(question, reference, used)).alias("context_precision"), error.alias("error"))


def hallucination_risk(coverage: Column) -> Column:
    return F.bround(1 - coverage, 4)
