import math
import re
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import neardup
from siltstone.llm.components import components


def brute(rows, threshold=0.8):
    """Classes by comparing all pairs of distinct texts."""
    def grams(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    df = Counter(g for _, t in rows for g in grams(t))
    n = len(rows)
    idf = {g: 2 + math.log(n / c) / math.log(max(n, 2)) for g, c in df.items()}
    texts = sorted({t or "" for _, t in rows})
    sets = [{g: c * idf[g] for g, c in grams(t).items()} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            m = sum(min(a[g], sets[j][g]) for g in a.keys() & sets[j].keys())
            if m and m / (sum(a.values()) + sum(sets[j].values()) - m) >= threshold:
                root[find(i)] = find(j)
    group = {t: find(i) for i, t in enumerate(texts)}
    low = {}
    for k, t in rows:
        if k is not None:
            low[group[t or ""]] = min(low.get(group[t or ""], k), k)
    return sorted(((k, low.get(group[t or ""])) for k, t in rows), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    passage = " ".join(rng.choice(vocab, 40))
    for g in range(12):
        base = list(rng.choice(vocab, int(rng.integers(30, 400))))
        for _ in range(6):
            w = base.copy()
            for i in rng.choice(len(w), int(len(w) * rng.choice([0, 0.01, 0.03, 0.08])), replace=False):
                w[i] = f"x{rng.integers(1000)}"
            out.append(" ".join(w) + (f" {passage}" if g % 3 == 0 else ""))
    chain = list(rng.choice(vocab, 200))
    for i in range(8):
        chain = chain[4:] + list(rng.choice(vocab, 4))
        out.append(" ".join(chain))
    out += [None, "", "one two", "One, TWO!", "...", "...", "?!", out[0], out[0], "é à ü ß ñ", "long " * 20_000]
    return list(enumerate(out)) + [(5, out[7]), (None, out[12])]


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, w int")
    got = neardup.near_duplicates(df, split_chars=4000, bucket_chars=9000).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute(rows)


def test_large_regions_equal_brute_force(spark, rows):
    """Blocks of five texts: components meet by their heads, then by pairs of blocks."""
    import pyspark.sql.functions as F

    rows = [r for r in rows if r[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = neardup.linked
    try:
        neardup.linked = lambda banded, texts, threshold: whole(banded.withColumn("band", F.lit(1)), texts, threshold, block=5)
        got = neardup.near_duplicates(df).collect()
    finally:
        neardup.linked = whole
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute(rows)


def test_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    s = neardup.Sampler()
    x = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    wx, wy = rng.random(900) + 0.5, rng.random(900) + 0.5
    got = s.samples(np.concatenate([x[:800], x[100:]]), np.concatenate([wx[:800], np.where(np.arange(100, 900) < 700, wx[100:], wy[100:])]), np.array([0, 800]))
    a, b = np.zeros(900), np.zeros(900)
    a[:800], b[100:] = wx[:800], np.where(np.arange(100, 900) < 700, wx[100:], wy[100:])
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((got[:, 0] == got[:, 1]).mean() - want) < 0.2


def test_overlaps_equal_sums_of_minima():
    rng = np.random.default_rng(8)
    x = [np.sort(rng.choice(60, 30, replace=False)).astype(np.uint64) for _ in range(9)]
    v = [rng.integers(1, 4, 30).astype("f4") * 1.25 for _ in x]
    sets = [dict(zip(a.tolist(), b.tolist(), strict=True)) for a, b in zip(x, v, strict=True)]
    got = neardup.overlaps(x, v, np.arange(3), np.arange(3, 9), width=7)
    want = [[sum(min(a[k], b[k]) for k in a.keys() & b.keys()) for b in sets[3:]] for a in sets[:3]]
    assert np.allclose(got, want)


def test_matrix_components_and_joins():
    rng = np.random.default_rng(6)
    near = rng.random((40, 40)) < 0.03
    near = near | near.T | np.eye(40, dtype=bool)
    number = neardup.reached(near)
    assert all(number[i] == number[j] for i, j in zip(*np.nonzero(near), strict=True)) and number[number].tolist() == number.tolist()
    parts = rng.random((30, 20)) < 0.1
    left, right = rng.integers(0, 8, 30), rng.integers(5, 12, 20)
    found = neardup.joins(parts, left, right)
    assert all(parts[a, b] for a, b in found)

    def classes(links):
        root = {int(r): int(r) for r in (*left, *right)}
        for a, b in links:
            old, new = root[int(left[a])], root[int(right[b])]
            root = {k: new if v == old else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    assert classes(found) == classes(list(zip(*np.nonzero(parts), strict=True))) and len(found) <= 12


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(60)] + [(int(a) + 100, int(b) + 100) for a, b in rng.integers(0, 150, (90, 2))] + [(1, 1), (2, 1)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
