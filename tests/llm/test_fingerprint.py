import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import fingerprint as fp


def lanes(text):
    pars = [p for p in (text or "").split("\n") if p]
    ids = [sum(int(hashlib.sha256(p.encode()).hexdigest()[8 * i : 8 * i + 8], 16) for p in pars) % 2**32 for i in range(8)]
    md = [hashlib.md5(c.encode()).hexdigest() for c in re.split(r"[.,;:!?\n]+ *", text or "") if c]
    bits = [[int(h[a : a + 15], 16) for h in md] for a in (0, 15)]
    words = [sum((x >> i) & fp.PAIR for x in b) for b in bits for i in range(30)]
    return [*ids, len(md), *words]


def hexed(v):
    return "".join(f"{x:08x}" for x in v[:9]) + "".join(f"{x:015x}" for x in v[9:])


def near(a, b):
    if a == b:
        return 1.0
    signed = lambda v: [2 * x - v[8] for x in [w & fp.LOW for w in v[9:]] + [w >> 30 for w in v[9:]]]
    x, y = signed(a), signed(b)
    dot = lambda p, q: sum(i * j for i, j in zip(p, q, strict=True))
    if not dot(x, x) or not dot(y, y):
        return 0.0
    return min(1.0, max(0.0, 2 * dot(x, y) / (dot(x, x) + dot(y, y))))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()), reverse=True)
    out = []
    for i, (k, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = lanes(t), lanes(edited), lanes(n)
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(near(a, b), 12), round(near(a, c), 12)))
    return sorted(out, key=str)


ROWS = [(i * 7, f"Par {i}. It is, so; yes!\nSecond é {i % 3}. Common clause.\n\nlast" * (i % 4)) for i in range(40)] + [(3, None), (5, ""), (9, "x"), (14, "Par 2. twin"), (14, "Par 2. twin"), (None, "no id"), (500, "one\ntwo\n" * 3000)]


@pytest.mark.parametrize("per_bucket", [2000, 3])
def test_equals_brute_force(spark, monkeypatch, per_bucket):
    plain = fp.with_next
    monkeypatch.setattr(fp, "with_next", lambda *a: plain(*a, per_bucket=per_bucket))
    df = spark.createDataFrame([(*r, "a", 1) for r in ROWS], "doc_id long, text string, fp string, next_text int")
    got = fp.fingerprint_edits(df).collect()
    assert sorted((tuple(r)[:5] + (round(r.near_edited, 12), round(r.near_next, 12)) for r in got), key=str) == brute(ROWS)


def test_ids_over_all_longs(spark, monkeypatch):
    plain = fp.with_next
    monkeypatch.setattr(fp, "with_next", lambda *a: plain(*a, per_bucket=2))
    ids = [-(2**63), 2**63 - 1, 0, 2**62, 2**62 + 1, -5, None, None, *range(10)]
    rows = [(k, f"text {i}, of {k}") for i, k in enumerate(ids)]
    got = fp.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted((b[:3] for b in brute(rows)), key=str)


def test_ranges_hold_equal_numbers_of_rows(spark):
    df = spark.range(4000).select(F.when(F.col("id") == 7, F.lit(2**60)).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    cuts = [i * 100.0 for i in range(1, 40)]
    n = df.groupBy(fp._cell(F.col("doc_id").cast("double"), cuts).alias("b")).count().collect()
    assert {r.b for r in n} == set(range(40)) and max(r["count"] for r in n) == 101


def test_multiset_algebra(spark):
    df = spark.createDataFrame([("a b.\nc, d\ne", "e\na b.", "c, d", "e\nc, d\na b.")], "whole string, two string, one string, shuffled string")
    for c in df.columns:
        df = fp.with_lanes(df, c, f"l_{c}")
    r = df.select("*", fp.combine(F.col("l_two"), F.col("l_one")).alias("plus"), fp.combine(F.col("l_whole"), F.col("l_one"), -1).alias("minus")).first()
    assert r.l_whole == r.l_shuffled == r.plus and r.minus == r.l_two != r.l_one


def test_empty(spark):
    assert fp.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
