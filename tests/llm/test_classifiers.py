"""Held-out accuracy and defined cases of language identification and toxicity."""

import zlib

import numpy as np
import pytest

from siltstone.llm import langid, queries, toxicity

LETTERS = {"aa": "abcde ", "bb": "fghij ", "cc": "kléèà "}


def texts(n, seed, alphabet):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(alphabet), rng.integers(5, 700))) + alphabet[0] for _ in range(n)]


def test_language_held_out(spark):
    rows = [(i * 10 + j, t, g, "clash") for j, (g, a) in enumerate(LETTERS.items()) for i, t in enumerate(texts(60, j, a))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(df.where("doc_id < 400"))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 ... !", "x"), (None, "abcde abc", "x"), (5, "abcde" * 100_000, "x"), (5, "abcde" * 100_000, "x")], "doc_id long, text string, lang string")
    got = langid.predict(df.where("doc_id >= 400").select("doc_id", "text", "lang"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97 and all(0 <= r.score <= 1 for r in got)
    other = [(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()]
    assert sorted(other, key=str) == [(1, "und"), (2, "und"), (3, "und"), (5, "aa"), (5, "aa"), (None, "aa")]


def test_language_windows_cover_text():
    for n in (0, 1, 255, 256, 257, 1000):
        w, share = langid.windows_of(np.arange(n, dtype=np.uint32).astype(np.uint8))
        assert share.sum() == max(n, 1) and w.shape[1] == 256


def test_language_lookup_equals_convolution():
    rng = np.random.default_rng(3)
    m = langid.Model(["a", "b"], [rng.normal(size=(w, 256, 4)).astype("f4") for w in langid.WIDTHS], rng.normal(size=12).astype("f4"), rng.normal(size=(12, 2)).astype("f4"), np.zeros(2, "f4"))
    x = rng.integers(0, 256, (3, langid.SIZE)).astype(np.uint8)
    pooled = []
    for w, k in zip(langid.WIDTHS, m.filters, strict=True):
        pooled.append([[max(sum(k[j][row[p + j]][f] for j in range(w)) for p in range(langid.SIZE - w + 1)) for f in range(4)] for row in x])
    z = np.maximum(np.hstack(pooled) + m.bias, 0) @ m.dense
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(m.probabilities(x, m.tables()), p, atol=1e-4)


def test_language_without_training(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.train(df) is None
    assert [(r.lang_pred, r.score) for r in langid.predict(df.select("doc_id", "text"), None).collect()] == [("und", 0.0)]
    assert langid.predict(df.limit(0).select("doc_id", "text"), None).count() == 0


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(5)
    words = ["alpha", "bravo", "carol", "delta", "eagle", "frost"]
    rows = []
    for i in range(600):
        w = list(rng.choice(words, rng.integers(3, 120)))
        if i % 8 == 0:
            w[len(w) // 2] = "VILEWORD"
        rows.append((i, " ".join(w), int(i % 8 == 0)))
    return rows


def test_toxicity_held_out(spark, labelled):
    df = spark.createDataFrame(labelled, "doc_id long, text string, y int")
    model = toxicity.train(df.where("doc_id < 400").select("doc_id", "text"), df.select("doc_id", "y"))
    odd = [(1000, None), (1001, ""), (None, "the vileword"), (1002, "alpha " * 200_000 + "vileword"), (1002, "alpha")]
    test = spark.createDataFrame([r[:2] for r in labelled if r[0] >= 400] + odd, "doc_id long, text string").selectExpr("doc_id", "text", "true as held_out", "1 as score")
    got = toxicity.score(test, model, "held_out").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 8 == 0) for r in got if r.doc_id is not None and r.doc_id < 1000)
    assert sorted(((r.doc_id, r.score >= 0.5) for r in got if r.doc_id is None or r.doc_id >= 1000), key=str) == [(1000, False), (1001, False), (1002, False), (1002, True), (None, True)]


def test_toxicity_keeps_the_words_of_a_rare_language(spark):
    rng = np.random.default_rng(6)
    make = lambda letters, n: ["".join(rng.choice(list(letters), 24)) for _ in range(n)]
    common, rare, plain = make("abcdef", 12), make("ghijkl", 1), make("mnopqr", 300)
    rows = []
    for i in range(1500):
        w = list(rng.choice(plain, 20))
        if i % 5 == 0:
            w += rare if i % 50 == 0 else common
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.train(df.where("doc_id < 1000").select("doc_id", "text"), df.select("doc_id", "y"))
    got = {r.doc_id: r.score for r in toxicity.score(df.where("doc_id >= 1000").selectExpr("doc_id", "text", "true as h"), model, "h").collect()}
    assert all((p >= 0.5) == (i % 5 == 0) for i, p in got.items()) and len(model.weights) > 400


def test_toxicity_regression_is_at_its_optimum():
    rng = np.random.default_rng(7)
    x, scale = rng.random((200, 40)) < 0.2, rng.normal(size=40)
    x[3] = x[:, 5] = False
    y = (rng.random(200) < 0.3).astype(float)
    starts, feature = np.append(0, np.cumsum(x.sum(1))), np.nonzero(x)[1].astype(np.int32)
    w, bias = toxicity.newton(starts, feature, scale, y, 2.0)
    p = 1 / (1 + np.exp(-(x * scale @ w + bias)))
    assert np.abs((x * scale).T @ (y - p) - 2.0 * w).max() < 1e-2 and abs((y - p).sum()) < 1e-2


def test_toxicity_hits_equal_brute_force(labelled):
    import pyarrow as pa

    from siltstone.llm.blocks import flat, grams

    batch = ["", "ab", "héllo wörld", "x" * 50, "hello"]
    table = np.arange(1, (1 << toxicity.BITS) + 1, dtype=np.int32)
    doc, feature = toxicity.hits(*flat(pa.array(batch)), table, block=7)
    want = {(i, int(h)) for i, t in enumerate(batch) for n in toxicity.ORDERS for h in grams(np.frombuffer(t.encode(), np.uint8), n, toxicity.BITS)}
    assert set(zip(doc.tolist(), feature.tolist(), strict=True)) == want and len(doc) == len(want)


def test_toxicity_ignores_other_labels(spark, labelled):
    df = spark.createDataFrame(labelled, "doc_id long, text string, y int")
    odd = spark.createDataFrame([(i, y) for i, y in zip(range(0, 40), [2, -1, None, 7] * 10, strict=True)], "doc_id long, y int")
    a = toxicity.train(df.select("doc_id", "text"), df.where("doc_id >= 40").select("doc_id", "y"))
    b = toxicity.train(df.select("doc_id", "text"), df.where("doc_id >= 40").select("doc_id", "y").union(odd))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_toxicity_one_class(spark):
    df = spark.createDataFrame([(1, "a b c", 0), (2, "d", None)], "doc_id long, text string, y int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "y"))
    assert [r.score < 0.5 for r in toxicity.score(df.selectExpr("doc_id", "text", "false as h"), model, "h").collect()] == [True, True]
    assert toxicity.train(df.limit(0).select("doc_id", "text"), df.limit(0).select("doc_id", "y")).bias <= 0


def test_language_training_rows_are_bounded_and_lose_no_language(spark):
    rare = [(i, f"fghij {i}", "bb") for i in range(150)]
    blank = [(i, None if i % 2 else "12", "bb") for i in range(1000, 61_000)]
    one_id = [(7, f"abcde {'abcde'[i % 5]} {i}", "aa") for i in range(30_000)]
    copies = [(9, "kléèà", "cc")] * 20_000 + [(i, f"kléèà {i}", "cc") for i in range(100)]
    df = spark.createDataFrame(rare + blank + one_id + copies, "doc_id long, text string, lang string").repartition(8)
    got = langid.training_rows(df, per_language=120).toPandas()
    assert got.groupby("lang").size().to_dict() == {"aa": 120, "bb": 120, "cc": 101} or got.groupby("lang").size().to_dict() == {"aa": 120, "bb": 120, "cc": 100}
    assert len(got.drop_duplicates()) == len(got) and got.text.str.contains("[a-z]").all()
    assert {r.lang for r in langid.training_rows(df, 120, most_languages=2).select("lang").distinct().collect()} == {"aa", "bb"}
    assert langid.train(df, per_language=60).languages == ["aa", "bb", "cc"]


def test_language_ties(spark):
    m = langid.Model(["a", "b"], [np.zeros((w, 256, 4), "f4") for w in langid.WIDTHS], np.zeros(12, "f4"), np.zeros((12, 2), "f4"), np.zeros(2, "f4"))
    df = spark.createDataFrame([(1, "same")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.predict(df, m).collect()] == [("a", 0.5)]


def test_toxicity_training_rows_are_bounded(spark):
    docs = [(5, f"text {i}") for i in range(30_000)] + [(6, "one text")] * 500 + [(i, f"other {i}") for i in range(100, 140)] + [(None, "x"), (7, None)]
    labels = [(5, 1), (6, 0), (6, 1), (7, 0), (None, 1)] + [(i, 0) for i in range(100, 140)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int")
    got = toxicity.training_rows(docs, labels, 50).toPandas()
    assert len(got) == 50 and len(got.drop_duplicates()) == 50
    got = toxicity.training_rows(docs, labels, 100_000).toPandas()
    assert len(got) == 30_000 + 1 + 40 + 1 and got[got.text == "one text"].y.tolist() == [1] and got[got.text == ""].y.tolist() == [0]


def test_folds_and_ties_of_the_queries(spark, tmp_path):
    rows = [(i, t, "aa" if i % 2 else "bb", "s", 1) for i, t in enumerate(texts(60, 1, "abcde "))]
    rows += [(70, rows[3][1], "aa", "s", 1), (71, rows[3][1], None, "t", 1), (None, "abc", "aa", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(70)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    fold = lambda i, m: 0 if i is None else zlib.crc32(str(i).encode()) % m
    for query, m, remainder in ((queries.op2_language_id, 3, 1), (queries.op9_toxicity, 5, 0)):
        got = query(spark, str(tmp_path)).collect()
        assert sorted((r.doc_id, r.held_out) for r in got if r.doc_id is not None) == sorted((r[0], fold(r[0], m) == remainder) for r in rows if r[0] is not None) and len(got) == len(rows)
        assert len({r.score for r in got if r.doc_id in (3, 70, 71)}) == 1  # equal texts, equal scores
