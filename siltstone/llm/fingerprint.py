"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A text is a multiset of paragraphs (its non-empty lines). Every paragraph is hashed to one wide
vector, and a fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo a power of two:

* 8 identity lanes modulo 2**32: the words of the paragraph's SHA-256;
* one lane modulo 2**30 that counts the paragraph's clauses;
* 120 likeness lanes modulo 2**30: for every clause of the paragraph the 120 leading bits of its MD5.

So the order of paragraphs is irrelevant, `combine` adds or removes paragraphs without the text, and
the likeness lanes work like a random projection: with n clauses, 2 * lane - n has the clause counts'
inner product as its mean product, which gives a Dice similarity (`likeness`).

Two 30-bit lanes share one long, and one long addition sums both ("lane words").

Defined cases: a null or empty text has no paragraph, all lanes are 0; two such texts have likeness 1,
such a text and any other 0. Rows may repeat; ids may span all longs, lie far apart or be null; rows with one id follow
each other by the MD5 of their texts; extra columns pass through `with_lanes` untouched.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_LANES, WORDS, LANE = 8, 60, 30
LANES = 2 * WORDS
PAIR = 1 + (1 << LANE)
LOW = (1 << LANE) - 1
CLAUSE = r"[.,;:!?\n]+ *"


def _hex_long(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("long")


def _sum(arr: str, term: str) -> Column:
    return F.expr(f"aggregate({arr}, 0L, (a, x) -> a + ({term}))")


def with_lanes(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column `out`: array<long> of 8 identity lanes, the clause count and 60 lane words."""
    p, d, h1, h2, m = (f"__{out}_{x}" for x in ("par", "dig", "h1", "h2", "md5"))
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(p, F.filter(F.split(t, "\n"), lambda x: x != ""))
    df = df.withColumn(d, F.transform(F.col(p), lambda x: F.sha2(x, 256)))
    df = df.withColumn(m, F.transform(F.filter(F.split(t, CLAUSE), lambda x: x != ""), lambda x: F.md5(x.cast("binary"))))
    df = df.withColumn(h1, F.transform(F.col(m), lambda x: _hex_long(F.substring(x, 1, 15))))
    df = df.withColumn(h2, F.transform(F.col(m), lambda x: _hex_long(F.substring(x, 16, 15))))
    ids = [_sum(d, f"cast(conv(substr(x, {8 * i + 1}, 8), 16, 10) as bigint)").bitwiseAND(F.lit((1 << 32) - 1)) for i in range(ID_LANES)]
    n = F.size(m).cast("long").bitwiseAND(F.lit(LOW))
    words = [_sum(h, f"shiftright(x, {i}) & {PAIR}L") for h in (h1, h2) for i in range(LANE)]
    return df.withColumn(out, F.array(*ids, n, *words)).drop(p, d, m, h1, h2)


def to_hex(lanes: str) -> Column:
    """The fingerprint as text: fixed-width hexadecimal lanes."""
    v = F.col(lanes)
    return F.concat(
        F.array_join(F.transform(F.slice(v, 1, ID_LANES + 1), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""),
        F.array_join(F.transform(F.slice(v, ID_LANES + 2, WORDS), lambda x: F.lower(F.lpad(F.hex(x), 15, "0"))), ""),
    )


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the multiset union (sign 1), or of a without b's paragraphs (sign -1), from lanes alone."""

    def part(x, y, i):
        narrow = (x + sign * y).bitwiseAND(F.when(i < ID_LANES, F.lit((1 << 32) - 1)).otherwise(F.lit(LOW)))
        low = (x.bitwiseAND(F.lit(LOW)) + sign * y.bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW))
        high = (F.shiftright(x, LANE) + sign * F.shiftright(y, LANE)).bitwiseAND(F.lit(LOW))
        return F.when(i <= ID_LANES, narrow).otherwise(low + F.shiftleft(high, LANE))

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.transform(pairs, lambda p, i: part(p.x, p.y, i))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with column `out` (double, 0 to 1): Dice similarity of the clause multisets, read from lanes a and b."""
    sa, sb = f"__{out}_a", f"__{out}_b"
    for src, dst in ((a, sa), (b, sb)):
        df = df.withColumn(dst, F.expr(
            f"transform(concat(transform(slice({src}, {ID_LANES + 2}, {WORDS}), x -> x & {LOW}L),"
            f" transform(slice({src}, {ID_LANES + 2}, {WORDS}), x -> shiftright(x, {LANE}))), x -> 2 * x - {src}[{ID_LANES}])"
        ))
    dot = lambda x, y: F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> cast(p as double) * q), cast(0 as double), (s, x) -> s + x)")
    num, da, db = f"__{out}_n", f"__{out}_da", f"__{out}_db"
    df = df.withColumns({num: dot(sa, sb), da: dot(sa, sa), db: dot(sb, sb)})
    value = F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col(da) == 0) | (F.col(db) == 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.col(num) / (F.col(da) + F.col(db))))
    )
    return df.withColumn(out, value).drop(sa, sb, num, da, db)


def _cell(k: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts are at most k (0 for null), in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    m = math.isqrt(len(cuts) - 1) + 1
    rows = [cuts[i : i + m] for i in range(0, len(cuts), m)]
    grid = F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")
    row = F.size(F.filter(F.transform(grid, lambda r: r[0]), lambda x: x <= k))
    inside = F.size(F.filter(F.get(grid, row - 1), lambda x: x <= k))
    return F.when(k.isNull() | (row == 0), F.lit(0)).otherwise((row - 1) * m + inside)


def with_next(df: DataFrame, order: str, carry: list[str], derive: Callable[[DataFrame], DataFrame] = lambda d: d, derived: tuple[str, ...] = (), per_bucket: int = 2000, most_buckets: int = 65536) -> DataFrame:
    """df with next_<c> for every carried or derived column: the row that follows in descending `order`, the first after the last.

    `derive` adds the derived columns to rows that have the carried ones, once for each row.

    Rows are dealt once to ranges of `order` (numbers) that hold about `per_bucket` rows each, whatever the values, and the
    first row of the range below goes along as a sentinel, so that no task sees all rows. Only the ranges' first ids and text
    digests, `most_buckets` short rows at most, are looked at in one task and broadcast. Null `order` counts as the smallest;
    ties go by the MD5 of the first carried column.
    """
    n = df.count()
    cells = max(1, min(most_buckets, n // per_bucket))
    k = F.col(order).cast("double")
    cuts = df.select(k.alias("k")).approxQuantile("k", [i / cells for i in range(1, cells)], 0.25 / cells) if cells > 1 else []
    df = df.withColumns({"__k": F.col(order), "__tie": F.md5(F.coalesce(F.col(carry[0]).cast("binary"), F.lit("").cast("binary")))})
    df = df.withColumn("__b", _cell(F.col("__k").cast("double"), sorted(set(cuts))))
    heads = df.groupBy("__b").agg(F.max(F.struct("__k", "__tie")).alias("__head"))
    every = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the first row of range b closes the next higher range; the first row of all closes the lowest one
    above = heads.select("__head", F.coalesce(F.lead("__b").over(Window.orderBy("__b")), F.min("__b").over(every)).alias("__to"))
    closing = (
        df.select("__k", "__tie", *carry)
        .join(F.broadcast(above), F.col("__k").eqNullSafe(F.col("__head.__k")) & (F.col("__tie") == F.col("__head.__tie")))
        .groupBy("__to").agg(F.first(F.struct(*carry)).alias("__c"))
        .select(*[F.col(f"__c.{c}").alias(c) for c in carry], F.col("__to").alias("__b"), F.lit(True).alias("__end"))
    )
    both = derive(df.withColumn("__end", F.lit(False))).unionByName(derive(closing), allowMissingColumns=True)
    w = Window.partitionBy("__b").orderBy(F.col("__end"), F.col("__k").desc(), F.col("__tie").desc())
    both = both.withColumns({f"next_{c}": F.lead(c).over(w) for c in (*carry, *derived)})
    return both.where(~F.col("__end")).drop("__k", "__tie", "__b", "__end")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The digest rows of `documents`: own and edited fingerprint, and both likenesses."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(d, "doc_id", ["text"], lambda x: with_lanes(x, "text", "fp"), ("fp",))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    d = d.select("doc_id", "n_chars", "fp", "next_fp", "edited")
    d = with_lanes(d, "edited", "edited_fp").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    d = with_likeness(with_likeness(d, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    return d.select("doc_id", "n_chars", "edited_sha256", to_hex("fp").alias("fingerprint"), to_hex("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


def sql() -> str:
    """DuckDB SQL for fingerprint_edits over `documents`."""

    def lanes(col: str) -> str:
        ids = ", ".join(f"coalesce(list_sum(list_transform(list_filter(string_split({col}, chr(10)), lambda p: p <> ''), lambda p: ('0x' || substr(sha256(p), {8 * i + 1}, 8))::BIGINT))::BIGINT, 0) & 4294967295" for i in range(ID_LANES))
        hs = f"list_transform(list_filter(string_split_regex({col}, '[.,;:!?\\n]+ *'), lambda p: p <> ''), lambda p: ('0x' || substr(md5(p), $AT, 15))::BIGINT)"
        words = ", ".join(f"coalesce(list_sum(list_transform({hs.replace('$AT', at)}, lambda x: (x >> {i}) & {PAIR}))::BIGINT, 0)" for at in ("1", "16") for i in range(LANE))
        return f"[{ids}, len({hs.replace('$AT', '1')})::BIGINT, {words}]"

    def hexed(v: str) -> str:
        return f"array_to_string(list_transform({v}[1:9], lambda x: lpad(lower(to_hex(x)), 8, '0')), '') || array_to_string(list_transform({v}[10:69], lambda x: lpad(lower(to_hex(x)), 15, '0')), '')"

    def signed(v: str) -> str:
        return f"list_transform(list_concat(list_transform({v}[10:69], lambda x: x & {LOW}), list_transform({v}[10:69], lambda x: x >> {LANE})), lambda x: (2 * x - {v}[9])::DOUBLE)"

    def near(a: str, b: str) -> str:
        dot = lambda x, y: f"list_inner_product({x}, {y})"
        return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {dot(f's_{a}', f's_{a}')} = 0 OR {dot(f's_{b}', f's_{b}')} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, 2 * {dot(f's_{a}', f's_{b}')} / ({dot(f's_{a}', f's_{a}')} + {dot(f's_{b}', f's_{b}')}))) END"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC, md5(text) DESC), first_value(text) OVER (ORDER BY doc_id DESC, md5(text) DESC)) AS next_text FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n),
l AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {lanes('text')} AS fp, {lanes('edited')} AS efp, {lanes('next_text')} AS nfp FROM e),
s AS (SELECT *, {signed('fp')} AS s_fp, {signed('efp')} AS s_efp, {signed('nfp')} AS s_nfp FROM l)
SELECT doc_id, n_chars, edited_sha256, {hexed('fp')} AS fingerprint, {hexed('efp')} AS edited_fingerprint, {near('fp', 'efp')} AS near_edited, {near('fp', 'nfp')} AS near_next FROM s"""
