"""Operators whose memory is bounded: exact search in tiles, quantiles from sketches, contexts, reference parts, token matching, merges by bucket, streamed tails."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import graph, metrics, prompt, reports, vectors
from siltstone.plans import plugins
from siltstone.sources import files
from siltstone.streaming import streams


def test_best_ranks_by_rounded_scores():
    rng = np.random.default_rng(1)
    score = np.round(rng.normal(size=(300, 500)), 1) + rng.uniform(-4e-10, 4e-10, (300, 500))
    score[5, :490] = -np.inf
    for k in (1, 7, 499, 500, 900):
        want = [[j for j in np.lexsort((np.arange(500), -np.round(row, 9))) if np.isfinite(row[j])][:k] for row in score]
        assert [c.tolist() for c in vectors.best(score, k)] == want


@pytest.mark.parametrize("most", [20, 10_000])
def test_exact_quantiles(spark, most):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 5.0], [1500, 7]), "c": np.array([3.0]), "d": np.exp(3 * rng.normal(size=2500)), None: rng.integers(0, 9, 700).astype(float)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r.g, r.share): r.quantile for r in reports.exact_quantiles(df, "g", "x", shares, most).collect()}
    assert got == pytest.approx({(g, s): float(np.quantile(v, s)) for g, v in groups.items() for s in shares})
    assert reports.exact_quantiles(df.limit(0), "g", "x", shares, most).count() == 0


def test_a_topic_named_overall_stays(spark):
    d = spark.createDataFrame([("OVERALL", 1.0), ("x", 0.0)], "topic string, m double")
    r = reports.rollup(d, "topic", ["m"], mark=True)
    assert sorted((x.topic, x.m) for x in reports.without_overall(r, "topic").collect()) == [("OVERALL", 1.0), ("x", 0.0)] and r.count() == 3
    assert reports.without_overall(reports.rollup(d.where("topic = 'x'"), "topic", ["m"]), "topic").count() == 1


def test_what_is_gathered_of_a_conversation_is_what_its_context_uses(spark):
    rng = np.random.default_rng(3)
    rows = [(c, t, "".join(rng.choice(list("ab  \n"), rng.integers(0, 40)))) for c in range(20) for t in range(60)] + [(99, t, "x " * 30 + " " * 300) for t in range(500)] + [(98, 1, None)]
    df = spark.createDataFrame(rows, "c int, t int, x string")
    for each, total in ((12, 60), (900, 3600)):
        cut = lambda d: d.groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", F.coalesce("x", F.lit("")).alias("x")))), lambda s: s.x).alias("x")).select("c", prompt.trimmed_contexts(F.col("x"), each, total).alias("y")).where(F.size("y") > 0)  # noqa: B023, E731
        used = prompt.within_total(df, "c", "t", "x", each, total)
        assert {(r.c, tuple(r.y)) for r in cut(used).collect()} == {(r.c, tuple(r.y)) for r in cut(df).collect()}
        assert used.groupBy("c").count().agg(F.max("count")).first()[0] <= total + each


def test_references_meet_long_titles(spark):
    digits = "".join(str(i % 10) for i in range(10_000))
    decisions = spark.createDataFrame([("d", "vu la loi n° 1.234-5 et la loi n° 90123"), ("e", "rien")], "doc_id string, body string")
    laws = spark.createDataFrame([("long", digits), ("l", "Loi n° 1.234-56"), ("m", "Loi n° 11.234"), ("n", None)], "doc_id string, titre string")
    assert sorted(tuple(r) for r in graph.cite_edges(decisions, laws).collect()) == [("d", "l"), ("d", "long")]


def test_token_similarity_equals_brute_force(spark):
    e = plugins.HashingEmbedder(8)
    rows = [(1, "alpha beta gamma", "beta delta"), (2, "alpha alpha", "alpha"), (3, "", "x"), (4, None, None), (5, "one two three four five six", "six five four eight")]
    df = spark.createDataFrame(rows, "id int, p string, r string")
    import hashlib
    import re

    def vec(w):
        h = hashlib.md5(w.encode()).hexdigest()
        v = np.zeros(8)
        v[int(h[:8], 16) % 8] = 1 if h[8] < "8" else -1
        return v

    words = {i: [re.findall("[a-z]+", x or "") for x in (p, r)] for i, p, r in rows}
    for weighted in (False, True):
        df_ = {t: sum(t in r for _, r in words.values()) for _, r in words.values() for t in r}
        w = {t: np.log((len(rows) + 1) / (n + 1)) for t, n in df_.items()} if weighted else {}
        weight = lambda t: w.get(t, max(w.values())) if weighted else 1.0  # noqa: B023, E731
        got = {r.id: (r.precision, r.recall, r.f1) for r in metrics.token_similarity(df, "id", "p", "r", e.token_vectors, metrics.token_weights(df, "r", lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), 0)) if weighted else None).collect()}
        for i, (p, r) in words.items():
            want = [0.0, 0.0, 0.0]
            if p and r:
                side = lambda a, b: sum(weight(x) * max(vec(x) @ vec(y) for y in b) for x in a) / sum(map(weight, a))  # noqa: B023, E731
                want[:2] = side(p, r), side(r, p)
                want[2] = 2 * want[0] * want[1] / (want[0] + want[1]) if want[0] + want[1] > 0 else 0.0
            assert got[i] == pytest.approx(tuple(want))
    big = np.random.default_rng(4).normal(size=(3000, 16))
    assert metrics.matched(big, big[:700], np.ones(3000), np.ones(700), 256)[1] == pytest.approx((big @ big[:700].T).max(0).mean())


def test_merges_touch_only_buckets_of_changed_keys(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    listing = lambda: {os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_path}/t/rows") for f in fs if f.endswith(".parquet")}
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    assert files.merge_stored(path, frame([(i, "a") for i in range(200)]), ["k"], "1", buckets=16)
    first = listing()
    assert files.merge_stored(path, frame([(3, "b"), (1000, "b")]), ["k"], "2", buckets=16)
    assert 13 <= len(first & listing()) <= 15
    now = listing()
    assert not files.merge_stored(path, frame([(3, "c")]), ["k"], "2", buckets=16) and listing() == now
    got = {r.k: r.v for r in files.read_stored(spark, path).collect()}
    assert got == {i: "a" for i in range(200)} | {3: "b", 1000: "b"}
    assert files.merge_stored(path, frame([(3, "z"), (2000, "z")]), ["k"], "3", files.insert_missing, 16)
    assert {r.k: r.v for r in files.read_stored(spark, path).collect()} == got | {2000: "z"}
    assert files.merge_stored(path, frame([]), ["k"], "4", buckets=16) and files.read_stored(spark, path).count() == 202
    with pytest.raises(ValueError, match="several"):
        files.merge_stored(path, frame([(1, "a"), (1, "b")]), ["k"], "5", buckets=16)


def test_streamed_tail_equals_the_batch_tail_after_every_batch(spark, tmp_path):
    src, seen = tmp_path / "src", {}
    src.mkdir()

    def put(batch, number):
        for r in batch.collect():
            seen.setdefault((number, r.key), []).append(json.loads(r.row))

    stream = spark.readStream.schema("log string, exp_id int, note string").option("maxFilesPerTrigger", 1).json(f"file://{src}")
    q = None
    batches = [[("a", i, f"n{i}") for i in range(40)], [("a", 12, "late"), ("b", 1, "x")], [("a", 33, "late but in"), ("b", 2, None)], [("a", 100 + i, "new") for i in range(3)] * 2]
    state, every = {}, []
    for n, rows in enumerate(batches):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"log": a, "exp_id": i, "note": x}) for a, i, x in rows))
        q = streams.tail(stream, "log", "exp_id", 15).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        every += rows
        for (_, key), tail in sorted(seen.items()):
            state[key] = [(r["exp_id"], r["note"]) for r in tail]
        for key in {r[0] for r in every}:
            want = sorted({(i, x) for a, i, x in every if a == key}, key=lambda r: (r[0], json.dumps(r[1])))[-15:]
            assert sorted(state[key], key=str) == sorted(want, key=str)
    log = spark.createDataFrame([r for r in set(every) if r[0] == "a"], "log string, exp_id int, note string")
    assert [r.exp_id for r in files.log_tail(log).collect()] == sorted(i for i, _ in state["a"])


def test_means_at_a_threshold_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Users whose mean is the gate itself: sums of doubles fall on either side of it, in DuckDB too, so the SQL is asked for exact means."""
    import duckdb

    from siltstone.plans.catalog import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id + k * 100000 AS event_id, ts, user_id + k * 1500 AS user_id, event_type, value, props FROM '/root/testdata/sf0.01/events.parquet', range(40) t(k)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    sql = ORACLE["error_taxonomy"]
    for name in ("raw", "rer"):
        sql = sql.replace(f"avg(kw) AS {name}", f"sum(kw::DECIMAL(18, 4))::DOUBLE / count(kw) AS {name}")
    assert sorted(map(tuple, QUERIES["error_taxonomy"](spark, str(tmp_path)).collect())) == sorted(con.execute(sql).fetchall())


def test_citations_are_distinct_without_a_shuffle_of_pairs(spark):
    """A decision and a law that share several keys are one edge; no pair is dealt out again to be made distinct."""
    body = " ".join(["vu la loi n° 100", "la loi n° 1001", "la loi n° 12", "le code du travail"])
    decisions = spark.createDataFrame([(f"d{i}", body if i % 2 else "la loi n° 12 et la loi n° 100") for i in range(6)], "doc_id string, body string")
    laws = spark.createDataFrame([("a", "Loi n° 1001"), ("b", "Loi n° 12-100 du code du travail"), ("c", "Code du travail"), ("d", "Loi n° 77")], "doc_id string, titre string")
    edges = graph.cite_edges(decisions, laws)
    want = [(f"d{i}", x) for i in range(6) for x in ("abc" if i % 2 else "ab")]
    assert sorted(map(tuple, edges.collect())) == want
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Aggregate" not in plan[: plan.index("Join Inner")]


def _cited(spark):
    body = lambda i: f"la loi n° {100 + i % 3} et la loi n° {7001 + i % 2}" + (" et le code du travail" if i % 6 == 0 else "")
    decisions = spark.createDataFrame([(f"d{i}", body(i) if i % 5 else "rien") for i in range(300)], "doc_id string, body string")
    laws = spark.createDataFrame([(f"l{i}", f"Loi n° {i}{100 + i % 4}" + (" modifiant la loi n° 7002 et le code du travail" if i % 3 == 0 else "")) for i in range(70)], "doc_id string, titre string")
    keys = lambda i: [str(100 + i % 3), str(7001 + i % 2)] + ["code du travail"] * (i % 6 == 0)
    titles = {r.doc_id: r.titre.lower() for r in laws.collect()}
    return decisions, laws, sorted((f"d{i}", x) for i in range(300) if i % 5 for x, t in titles.items() if any(k in t for k in keys(i)))


def test_citations_unfold_from_blocks_of_decisions(spark, monkeypatch):
    """The join that lists pairs has laws beside blocks of decisions: its rows are far fewer than the pairs, whose keys are not tested there; small blocks and cells give the same."""
    decisions, laws, want = _cited(spark)
    for block, cell in ((graph.BLOCK, graph.CELL), (7, 20), (1, 1)):
        monkeypatch.setattr(graph, "BLOCK", block)
        monkeypatch.setattr(graph, "CELL", cell)
        edges = graph.cite_edges(decisions, laws)
        assert sorted(map(tuple, edges.collect())) == want
        plan = edges._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(all" in plan[: plan.index("Join Inner")] and "array_contains" not in plan.split("Join Inner")[1].split("\n")[0]


def test_citations_are_counted_without_pairs(spark):
    """A row for each class of decisions and law, and numbers that add up to the pairs."""
    decisions, laws, want = _cited(spark)
    sizes = graph.cite_sizes(decisions, laws)
    assert sizes.count() * 20 < len(want)
    assert [tuple(r) for r in graph.counts(cites=sizes, none=sizes.limit(0)).collect()] == [("cites", len(want)), ("none", 0)]


def test_batches_of_token_vectors_are_small(spark, monkeypatch):
    import pyarrow as pa

    from siltstone.operators import metrics

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")

    @F.arrow_udf("array<array<float>>")
    def vectors(batch: pa.Array) -> pa.Array:
        assert len(batch) <= 1000, len(batch)
        return pa.array([[[1.0, 0.0]] * len(x) for x in batch.to_pylist()], pa.list_(pa.list_(pa.float32())))

    try:
        df = spark.range(5000).coalesce(1).select("id", F.lit("un deux").alias("a"), F.lit("un").alias("b"))
        assert metrics.token_similarity(df, "id", "a", "b", vectors).where("f1 = 1").count() == 5000
    finally:
        spark.conf.set(name, before)


def test_blocks_of_vectors_are_shuffled_as_they_are(spark):
    from siltstone.operators import vectors

    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(100)], "id long, v array<float>")
    found = vectors.exact(v, v.where("id % 50 = 0"), 3)
    assert "array<double>" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 6


def test_few_queries_go_to_where_vectors_are_read(spark, monkeypatch):
    """No vector is shuffled for them; the result is that of blocks that meet."""
    from siltstone.operators import vectors

    v = spark.range(500).select("id", F.array(F.sin("id").cast("float"), F.cos(F.col("id") * 3).cast("float"), (F.col("id") % 5).cast("float")).alias("v")).repartition(4)
    q = v.where("id % 50 = 0")
    for metric in ("ip", "l2"):
        rows = lambda: sorted((r.query_id, r["rank"], r.id, r.score) for r in vectors.exact(v, q, 7, metric, block_rows=60).collect())  # noqa: B023, E731
        here = rows()
        plan = vectors.exact(v.coalesce(2), q, 7, metric)._jdf.queryExecution().optimizedPlan().toString()
        assert len(here) == 70 and "MapInArrow" in plan and "CoGroup" not in plan
        with monkeypatch.context() as m:
            m.setattr(vectors, "FEW", 1)
            assert rows() == here
    assert vectors.exact(v, q.where("false"), 3).count() == 0


def test_an_index_without_texts_finds_the_same(spark, tmp_path):
    """Texts are not stored again; those of found chunks are cut from their documents."""
    from siltstone.operators import corpus
    from siltstone.plans import plugins, retriever

    docs = spark.createDataFrame([(i, f"Le texte mot{i}x de la loi sur le travail. " * (20 + 30 * (i % 4))) for i in range(20)], "doc_id long, text string")
    cut = lambda d: corpus.chunks(d).select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "text")
    texts = lambda ids: cut(docs.join(ids.select(F.col("doc_id").cast("long")), "doc_id", "left_semi"))
    edges = {"cites": spark.createDataFrame([(str(i), str(i + 1)) for i in range(19)], "src string, dst string")}
    e, q = plugins.HashingEmbedder(32), spark.createDataFrame([(1, "mot7x travail"), (2, "loi mot3x")], "query_id long, text string")
    whole = retriever.open_or_build(spark, f"file://{tmp_path}/a", cut(docs), e, edges)
    ids = retriever.open_or_build(spark, f"file://{tmp_path}/b", cut(docs), e, edges, sparse=("stems",), texts=texts)
    assert not (tmp_path / "b" / "chunks").exists() and ids.chunks.columns == ["chunk_id", "doc_id"] and ids.chunks.count() == whole.chunks.count()
    rows = lambda i, *a, **b: sorted(map(tuple, retriever.Retriever(i, *a).retrieve(q, **b).select("query_id", "rank", "chunk_id", "doc_id", "text", "score").collect()))
    for strategy in ("graph", "hybrid"):
        assert rows(ids, strategy=strategy) == rows(whole, strategy=strategy)
    assert rows(ids, plugins.OverlapReranker(), k=3) == rows(whole, plugins.OverlapReranker(), k=3)
    assert "text" not in retriever.Retriever(ids).retrieve(q, "dense", 3, with_texts=False).columns
    with pytest.raises(retriever.MissingDependency):
        retriever.open_or_build(spark, f"file://{tmp_path}/b", None, e)


def test_edges_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch):
    """Found documents go to where the edges are read; with many of them both are sorted. Edges take few bytes on disk, so Spark would send all of them."""
    import re

    from siltstone.plans import plugins, retriever

    chunks = spark.createDataFrame([(f"{i}-{j}", str(i), f"mot{i % 7} loi{j} travail") for i in range(60) for j in range(2)], "chunk_id string, doc_id string, text string")
    to = lambda n, name, a="": spark.createDataFrame([(str(i), f"{a}{i + n}") for i in range(60)], f"src string, {name} string")
    edges = {"cites": to(1, "dst"), "amends": to(2, "dst"), "cites_article": to(3, "mid", "a"), "sees_article": to(4, "mid", "a")}
    edges["article_of"] = to(0, "dst").select(F.concat(F.lit("a"), "src").alias("mid"), "dst")
    index = retriever.open_or_build(spark, f"file://{tmp_path}/i", chunks, plugins.HashingEmbedder(16), edges, sparse=("stems",))
    q = spark.createDataFrame([(1, "mot3 travail"), (2, "loi1 mot5")], "query_id long, text string")
    plans = []
    for name in ("out_neighbours", "two_hop_neighbours"):
        hop = getattr(graph, name)

        def seen(*a, hop=hop):
            out = hop(*a)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            return out

        monkeypatch.setattr(graph, name, seen)
    rows = lambda s: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in retriever.Retriever(index).retrieve(q, s, 40).collect())
    few = {s: rows(s) for s in ("graph", "hybrid_graph")}
    joins = [x for p in plans for x in re.findall(r"BroadcastHashJoin [^\n]*", p)]
    assert len(plans) == 10 and len(joins) >= 10 and all("BuildLeft" in x for x in joins)
    plans.clear()
    monkeypatch.setattr(retriever, "MOST_FOUND", 1)
    assert {s: rows(s) for s in few} == few
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
