"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, ballkmeans, conversations, crosspolytope, fingerprint, langid, linededup, neardup, packing, sentencepiece, suffixes, toxicity, warc
from .common import crc32_mod, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.columns(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.search(vectors, vectors.where("id % 50 = 0"), k=5)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_removed_").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece.load(public_tokenizers.path("piece_bpe_32k.model"))
    out = sentencepiece.decode(sentencepiece.encode(table(spark, sf_dir, "documents"), model), model)
    return out.select("doc_id", "n_tokens", "ids_crc32", F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"), held_out).where("not held_out")
    scored = toxicity.score(docs, toxicity.train(docs.where("not held_out"), labels), "held_out")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.columns(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ballkmeans.cluster(vectors).withColumnRenamed("id", "vec_id")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    out = crosspolytope.near_duplicates(vectors).withColumnRenamed("id", "vec_id")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language_id": op2_language_id,
    "op3_warc": op3_warc,
    "op4_nearest": op4_nearest,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_centroids": op11_centroids,
    "op12_conversations": op12_conversations,
    "op13_near_vectors": op13_near_vectors,
}


def oracle() -> dict[str, str]:
    return {
        "op1_fingerprints": fingerprint.sql(),
        "op3_warc": warc.sql(),
        "op6_line_dedup": linededup.sql(),
        "op11_centroids": ballkmeans.sql(),
        "op12_conversations": conversations.sql(),
        "op13_near_vectors": crosspolytope.sql(),
    }
