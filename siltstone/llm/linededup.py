"""Line dedup by distinct-site spread.

A line (between line ends, spaces trimmed off; blank lines are left alone) is boilerplate if it occurs
on at least `min_sites` distinct sites. One HyperLogLog sketch of sites per line hash is built where
the lines are and merged by aggregation. Lines whose estimate lies within `band` of the threshold get
an exact distinct count; the others are decided by the estimate. A boilerplate line is removed from
every document but stays at its first occurrence (smallest id, then position), so content that was
only ever copied as a whole is not lost.

The first shuffle has one sketch a line and task, so a line that fills the corpus is a sketch from each task. Only occurrences of
lines that may be boilerplate by their estimate go on, as hashes, ids and positions, in one written table; they meet the estimates and the decisions in
salted joins.

Defined cases: a null text has no lines and stays null; an empty text has one blank line; a null site
is no site; rows with the same id and text are treated alike; a null id counts as the smallest; an
empty table gives no rows; other columns pass through, also ones with odd names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, hash128, materialise

LG_K = 12


def _lines(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    t = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(site).cast("string").alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    line = F.trim("line")
    return t.where(line != "").select("k", "t", "pos", "site", *(h.alias(n) for h, n in zip(hash128(line), ("h1", "h2"), strict=True)))


def spread(lines: DataFrame) -> DataFrame:
    """(h1, h2, n): the estimated number of sites of every line, by sketches that are built where the lines are and merged."""
    each = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"))
    return each.select("h1", "h2", F.hll_sketch_estimate("s").alias("n"))


def occurrences(lines: DataFrame, min_sites: int, band: float) -> DataFrame:
    """All occurrences of the lines that may be boilerplate by their estimate, with it: what is left of the lines for all that follows."""
    able = spread(lines).where(F.col("n") >= min_sites * (1 - band))
    return materialise(attach(lines, able, ["h1", "h2"], F.struct("k", "t")), "linededup-occurrences")


def near_counts(hits: DataFrame, min_sites: int, band: float) -> DataFrame:
    """(h1, h2, n): the exact numbers of sites of the lines whose estimate lies in the band around the threshold."""
    near = hits.where(F.col("n") <= min_sites * (1 + band)).select("h1", "h2", "site").distinct()
    return near.groupBy("h1", "h2").agg(F.count("site").alias("n"))


def boilerplate(hits: DataFrame, min_sites: int, band: float) -> DataFrame:
    """(h1, h2, first): the hashes of lines on at least min_sites sites, and where each occurs first."""
    first = hits.groupBy("h1", "h2").agg(F.min(F.struct("k", "pos", "t")).alias("first"), F.first("n").alias("n"))
    sure = first.where(F.col("n") > min_sites * (1 + band)).select("h1", "h2", "first")
    exact = near_counts(hits, min_sites, band).where(F.col("n") >= min_sites).select("h1", "h2")
    return sure.unionByName(first.select("h1", "h2", "first").join(exact, ["h1", "h2"], "left_semi"))


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 10, band: float = 0.2) -> DataFrame:
    """docs with the text replaced by its kept lines, plus n_lines_ and n_removed_ (long; columns of these names are replaced)."""
    hits = occurrences(_lines(docs, key, text, site), min_sites, band)
    hit = attach(hits, boilerplate(hits, min_sites, band), ["h1", "h2"], F.struct("k", "t")).where(~F.struct("k", "pos", "t").eqNullSafe(F.col("first")))
    own = "__"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    k, t, gone, parts = (own + c for c in ("k", "t", "gone", "parts"))
    lost = hit.groupBy(F.col("k").alias(k), F.col("t").alias(t)).agg(F.collect_set("pos").alias(gone))
    joined = docs.join(lost, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(t)), "left")
    split = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    kept: Column = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(parts), i)), "\n"))
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")
    joined = joined.withColumns({"n_lines_": n, "n_removed_": F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"), parts: F.when(F.col(gone).isNotNull(), split)})
    return joined.withColumn(text, kept).drop(k, t, gone, parts)


def sql(min_sites: int = 10) -> str:
    """DuckDB SQL for the query over `documents`: exact distinct counts throughout."""
    return f"""
WITH l AS (SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
b AS (SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {min_sites}),
m AS (SELECT l.*, b.line IS NOT NULL AND row_number() OVER (PARTITION BY trim(l.line, ' ') ORDER BY doc_id NULLS FIRST, pos) > 1 AS gone FROM l LEFT JOIN b ON trim(l.line, ' ') = b.line)
SELECT d.doc_id, count(m.pos) AS n_lines, count(m.pos) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id"""
