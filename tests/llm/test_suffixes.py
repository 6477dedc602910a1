import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import suffixes as sx


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (k, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((k, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdé fg\n"), n))
    passage, short = text(400), text(190)
    out = [text(int(n)) for n in rng.integers(0, 900, 30)]
    out += [text(150) + passage[int(a) : int(b)] + text(100) for a, b in zip(rng.integers(0, 150, 25), rng.integers(250, 400, 25), strict=True)]
    out += [text(60) + short + text(60) for _ in range(4)]
    out += [out[3], out[3], out[31], None, "", "a" * 199, "a" * 200, "b" * 201, "ab" * 700, "c" * 5000, text(300) * 4, passage + passage]
    return list(enumerate(out)) + [(3, out[3]), (None, out[35])]


@pytest.mark.parametrize("most_runs", [5000, 3])
def test_equals_brute_force(spark, rows, most_runs):
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, s int")
    got = sx.dedup(df, split_bytes=3000, bucket_bytes=5000, most_runs=most_runs, runs_per_task=20).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows)


def test_kept_text(spark):
    base = "é" * 150 + "x" * 30
    df = spark.createDataFrame([(1, base + "tail"), (2, "head" + base), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.spans) for r in sx.dedup(df, with_text=True).collect()}
    assert got[2][0] == "head" and got[3] == ("", []) and got[1][0] == "tail" and got[1][1] == [0, 330]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=30, max_size=400).map(lambda b: bytes(x % 2 + 97 for x in b)), st.integers(9, 28), st.sampled_from([8, 16]))
def test_deep_shallow_sorts(data, length, shallow):
    d = np.frombuffer(data, np.uint8)
    pos = np.arange(len(d) - length + 1)
    order, same = sx.deep_shallow(d, pos, length, shallow)
    cut = [data[i : i + length] for i in order]
    assert sorted(order) == list(pos) and cut == sorted(cut)
    n = Counter(cut)
    assert sx.repeated(d, pos, length).tolist() == [n[data[i : i + length]] > 1 for i in pos]
    assert [s for s in same[1:]] == [a == b for a, b in zip(cut, cut[1:], strict=False)] or all(a == b for s, a, b in zip(same[1:], cut, cut[1:], strict=False) if s)


def test_runs_across_blocks(monkeypatch):
    monkeypatch.setattr(sx, "BLOCK", 256)
    rng = np.random.default_rng(1)
    d = rng.integers(97, 100, 3000).astype(np.uint8)
    o = np.array([0, 100, 900, 1099, 3000])
    s, n, _, _, _ = sx.runs(d, o)
    covered = np.concatenate([np.arange(a, a + b) for a, b in zip(s, n, strict=True)])
    want = np.concatenate([np.arange(a, b - 199) for a, b in zip(o, o[1:], strict=False) if b - a >= 200])
    assert sorted(covered.tolist()) == want.tolist()


def test_empty(spark):
    assert sx.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_gram_with_thousands_of_strings_is_sorted_in_parts(spark, monkeypatch):
    """Passages of 120 to 500 bytes in thousands of contexts, whole and in parts; no task gets more strings of a gram than the limit."""
    rng = np.random.default_rng(12)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passages = [text(n) for n in (120, 199, 230, 500)]
    rows = [(i, text(int(rng.integers(30, 120))) + passages[i % 4][int(rng.integers(0, 20)) :] + text(int(rng.integers(30, 120)))) for i in range(2400)]
    rows += [(2400 + i, rows[i % 40][1] + text(i % 3)) for i in range(300)]
    most, seen = 150, []
    of_sort = sx.sort_runs
    monkeypatch.setattr(sx, "sort_runs", lambda e, n: (seen.append(e.groupBy("h").count().agg({"count": "max"}).first()[0] or 0), of_sort(e, n))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sx.dedup(df, most_runs=most).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows)
    assert 2 <= len(seen) <= 5 and max(seen) <= most


def test_windows_of_any_gram_are_the_same():
    rng = np.random.default_rng(1)
    d, o = rng.integers(97, 100, 1500).astype(np.uint8), np.array([0, 100, 700, 1500])
    want = sorted(np.concatenate([np.arange(a, b - 199) for a, b in zip(o, o[1:], strict=False) if b - a >= 200]).tolist())
    for gram in (sx.GRAM, *sx.LONGER):
        s, n, _, _, _ = sx.runs(d, o, gram)
        assert sorted(np.concatenate([np.arange(a, a + b) for a, b in zip(s, n, strict=True)]).tolist()) == want and n.max() <= 200 - gram + 1


def test_any_copy_may_stand_for_a_string(spark, monkeypatch):
    """A string's row is that of whichever copy a shuffle brings first, so it may differ from one read of the plan to the next; no string is lost by that."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passages = [text(300) for _ in range(40)]
    rows = [(i, passages[i % 40]) for i in range(80)] + [(80 + i, text(30) + passages[i][10:] + text(30)) for i in range(40)]
    of_sort, other = sx.sort_all, F.udf(lambda: __import__("random").SystemRandom().getrandbits(40), "long").asNondeterministic()
    any_copy = lambda e, *a: of_sort(e.withColumn("s", F.when(F.col("own"), F.col("s")).otherwise(other())), *a)
    monkeypatch.setattr(sx, "sort_all", any_copy)
    got = sx.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows)
