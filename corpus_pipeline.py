"""The corpus pipeline: language ID, line dedup, near dedup, suffix-array dedup and packing, in this order.

Each stage reads what its predecessor kept, as rows with the columns of `documents`, and its decisions
take effect: rejected documents go, texts lose their removed parts (n_chars follows). The last stage
returns the pieces of the packed sequences.

Defined cases: null texts are rejected by the first stage; texts that lose all their lines stay as
empty documents until near dedup keeps one of them; rows with equal id and text are one document from near dedup on;
an empty table passes through; columns other than those of documents are dropped.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import langid, linededup, neardup, packing, suffixes
from siltstone.llm.common import collecting, crc32_mod, discard, hash128, materialise, reads, table, within_run

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has a mean probability below this is undecided and goes: LEAST_SCORE for one of
#: LONG bytes or more (of 10,000 labelled documents of sf0.1 none is below it); a shorter one tells less.
LEAST_SCORE, LEAST_SCORE_SHORT, LONG = 0.5, 0.35, 64
#: A document whose bytes follow each other no better than this in any language is in none of the languages
#: and goes. Labelled documents have -4.8 or more, texts in other scripts and random letters -5.5 or less.
LEAST_FIT = -5.2
#: Working tables of the last stage over a folder of tables. A stage's result is written and read again as the next one's
#: docs, so the next stage over the same folder deletes them. `run` keeps its own list and touches no other's tables.
_left: dict[str, list[str]] = {}


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def _stage(f):
    """A stage that leaves its working tables to the next one over the same folder to delete, as its result is lazy."""

    @wraps(f)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if within_run():
            return f(spark, docs, sf_dir)
        before = _left.pop(sf_dir, [])
        used = reads(docs, before)  # a result that was handed on unwritten
        if not used:
            discard(spark, before)
        with collecting() as made:
            out = f(spark, docs, sf_dir)
        _left[sf_dir] = made + before * used
        return out

    return staged


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without a clear language or in none of the languages go."""
    model = langid.train(docs.where(crc32_mod(F.col("doc_id"), 3) != 1))
    scored = langid.predict(docs.select("doc_id", "text", F.col("text").alias("kept"), "lang", "source"), model, fit=True)
    least = F.when(F.octet_length("kept") >= LONG, LEAST_SCORE).otherwise(LEAST_SCORE_SHORT)
    kept = scored.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least) & (F.col("fit") >= LEAST_FIT))
    return _documents(kept.withColumnRenamed("kept", "text"))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay at their first occurrence only."""
    return _documents(linededup.remove_boilerplate(docs.select(COLUMNS)))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays."""
    classes = neardup.near_duplicates(docs.select("doc_id", "text"))
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("class_id").alias("k")).agg(F.min(F.struct("t1", "t2")).alias("t"))
    t1, t2 = hash128(F.coalesce("text", F.lit("")))
    d = docs.select(COLUMNS).withColumns({"t1": t1, "t2": t2})
    kept = d.join(first, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("t1") == F.col("t.t1")) & (F.col("t2") == F.col("t.t2")), "left_semi")
    return _documents(kept.dropDuplicates(["doc_id", "t1", "t2"]))


@_stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur elsewhere go."""
    t1, t2 = hash128(F.coalesce("text", F.lit("")))
    kept = suffixes.dedup(docs, with_text=True).select(F.col("doc_id").alias("k"), F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.col("kept")).dropDuplicates(["k", "k1", "k2"])
    d = docs.select("doc_id", "lang", "source", t1.alias("t1"), t2.alias("t2"))
    d = d.join(kept, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")))
    return _documents(d.withColumnRenamed("kept", "text"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: Language ID, near dedup, suffix dedup and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with collecting() as made:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, before + made[:-1])  # all but the written result of this stage
        before = made[-1:]
    with collecting():
        return STAGES[-1][1](spark, docs, sf_dir)
