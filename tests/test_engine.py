"""Sources, metadata, graph, fusion, metrics, prompts and the retriever on small inline data."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import corpus, fusion, graph, lexical, metrics, prompt, reports, vectors
from siltstone.plans import plugins, retriever, search
from siltstone.sources import files
from siltstone.sources import paged
from siltstone.streaming import streams


@pytest.fixture
def raw(tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    doc = lambda i, text, **m: {"id": i, "titre": f"T{i}", "text": text, "date": "2020", "source": f"u/{i}", "type": "legislation", "metadata": m}
    a.write_text("\n".join(json.dumps(x) for x in [doc("1", "first " * 60, numero="7", nature=""), doc("2", "two " * 40), doc("", "no id " * 30)]))
    b.write_text("\n".join(json.dumps(x) for x in [doc("1", "second " * 60), doc("3", "tiny"), doc("", "no id " * 30)]))
    return [str(a), str(tmp_path / "missing.jsonl"), str(b)]


def test_process_dedupes_in_file_order(spark, raw):
    got = corpus.process(files.read_documents(spark, [f"file://{p}" for p in raw]), "2026-01-01T00:00:00+00:00").collect()
    one = next(r for r in got if r.doc_id == "1")
    assert one.text.startswith("first") and one.chunk_id == "1-0" and one.total_chunks == 1
    assert sorted(r.doc_id for r in got) == ["", "", "1", "2"]
    assert one.metadata["document_number"] == "7" and one.metadata["numero"] == "7" and "document_nature" not in one.metadata and one.metadata["source_url"] == "u/1"
    assert one.ingestion.source_file == "a.jsonl" and one.ingestion.chunk_size == 1800


def test_no_files(spark):
    assert files.read_documents(spark, ["file:///nowhere/x.jsonl"]).count() == 0


def test_results_of_all_generations(spark, tmp_path):
    for run, name, row in (("r1", "eval_1", {"question_id": "q1", "word_f1": 0.5}), ("r1", "eval_2", {"question_id": "q1", "word_f1": 0.7, "judge_score": 1.0}), ("r2", "eval_1", {"question_id": "q2"})):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / f"{name}.jsonl").write_text(json.dumps(row))
    got = files.read_latest_runs(spark, f"file://{tmp_path}").collect()
    assert sorted((r.question_id, r.word_f1, r.judge_score) for r in got if r.word_f1) == [("q1", 0.7, 1.0)] and len(got) == 2


def test_experiment_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for i in (1, 2):
        files.append_log(spark.createDataFrame([(i, "t")], "exp_id int, timestamp string").select("exp_id", "timestamp", *[F.lit(None).cast("string").alias(f"c{j}") for j in range(18)]), path)
    log = files.read_log(spark, path)
    assert files.next_experiment(log) == 3 and [r.exp_id for r in files.log_tail(log, 1).collect()] == [2]


def test_benchmark_file(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"benchmarks": [{"name": "x", "fullname": "tests/t.py::A::test_x", "stats": {"mean": 0.5, "stddev": 0.1, "rounds": 3}}]}, indent=1))
    assert tuple(files.read_benchmarks(spark, f"file://{tmp_path}/b.json").first()) == ("test_x", 0.5, 0.1, 3)


def test_questions_have_defaults(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "a"}], indent=1))
    q = files.read_questions(spark, f"file://{tmp_path}/q.json").first()
    assert q.topic == "general" and q.reference_keywords == []


def test_paged_source(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"id": str(i), "text": f"t{i}"}) for i in range(25)))
    paged.register(spark)
    df = spark.read.format("paged").option("path", f"{tmp_path}/p.jsonl").option("size", "10").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 25


def test_vectors_must_match_chunks(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0])], "chunk_id string, vector array<float>")
    c = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    assert files.join_vectors(v, c.where("chunk_id = 'a'"), 2).count() == 1
    for bad, dim in ((c, 2), (c.where("chunk_id = 'a'"), 3)):
        with pytest.raises(Exception, match="do not match"):
            files.join_vectors(v, bad, dim).collect()


def test_open_table_says_what_is_missing(spark):
    with pytest.raises(FileNotFoundError, match="build it first"):
        files.open_table(spark, "no_such_table")


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, files.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, files.insert_missing(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_themes(spark):
    rows = [(1, {"thematic": "  a "}), (2, {"thematic": '["x", "y", "x"]', "domaine": "y"}), (3, {"other": "z"}), (4, {"themes": ""})]
    d = spark.createDataFrame(rows, "id int, m map<string,string>").select("id", graph.themes(F.col("m")).alias("t"))
    assert {r.id: r.t for r in d.collect()} == {1: ["a"], 2: ["x", "y"], 3: [], 4: []}


def test_boost_is_once_per_relation(spark):
    seeds = spark.createDataFrame([("q", "s1"), ("q", "s2")], "q string, doc string")
    edges = spark.createDataFrame([("s1", "n"), ("s2", "n"), ("s1", "s2")], "src string, dst string")
    got = graph.boosts(seeds, {"cites": graph.out_neighbours(seeds, edges), "amends": graph.undirected_neighbours(seeds, edges)}).collect()
    assert [(r.doc, round(r.boost, 6)) for r in got] == [("n", 0.22)]


def test_expansion_invariants(spark):
    seeds = spark.createDataFrame([("q", "a", "a-0", 1.0), ("q", "b", "b-0", 0.62)], "q string, doc string, chunk_id string, score double")
    chunks = spark.createDataFrame([("a-0", "a"), ("b-0", "b"), ("n-0", "n"), ("n-1", "n")], "chunk_id string, doc string")
    got = graph.expand(seeds, spark.createDataFrame([("q", "n", 0.12)], "q string, doc string, boost double"), chunks, 4).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("a-0", 1.0), ("b-0", 0.62), ("n-0", 0.62), ("n-1", 0.62)]
    assert [r["rank"] for r in got] == [1, 2, 3, 4]


def test_fusion_formula(spark):
    d = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "q string, i string, rank int")
    s = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "q string, i string, rank int")
    got = {r.i: r for r in fusion.reciprocal_rank(d, s, "q", "i", 5).collect()}
    assert got["b"].score == round(0.3 / 62 + 0.7 / 61, 6) and got["a"].sparse_rrf == 0.0 and [got[x]["rank"] for x in "bca"] == [1, 2, 3]
    none = {r.i: r for r in fusion.reciprocal_rank(d, s, "q", "i", 5, 0.0, 1.0).collect()}
    assert none["a"].score == 0.0


def test_min_max_guard(spark):
    d = spark.createDataFrame([("q", 1.0), ("q", 1.0), ("r", 0.0), ("r", 2.0)], "q string, s double")
    assert sorted(r.s for r in fusion.min_max(d, "q", "s").collect()) == [0.5, 0.5, 0.5, 1.0]


def test_rerank_labels_and_fallback(spark):
    d = spark.createDataFrame([("q", "a", 1, 0.1), ("q", "b", 2, 0.9), ("p", "c", 1, 0.1)], "q string, chunk_id string, rank int, s double").withColumn("retrieval_method", F.lit("dense"))
    got = fusion.rerank(d, "q", 5, lambda x: F.col("s"), least=0.5).collect()
    assert sorted((r.q, r.chunk_id, r["rank"], r.retrieval_method) for r in got) == [("p", "c", 1, "dense+rerank"), ("q", "b", 1, "dense+rerank")]


def test_exact_search_and_dimension(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "id long, v array<float>")
    got = vectors.exact(v, v.where("id = 0"), 2, block_rows=2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 0.0), (2, 0.0)]
    with pytest.raises(Exception, match="dimension"):
        vectors.checked(v, "v", 5).collect()


def test_keyword_morphology(spark):
    d = spark.createDataFrame([("Les indemnités de licenciement",)], "a string").select(metrics.canonical_tokens(F.col("a")).alias("p"), F.array(metrics.canonical_tokens(F.lit("indemnite")), metrics.canonical_tokens(F.lit("licenciements"))).alias("k"))
    assert d.select(metrics.keyword_recall(F.col("p"), F.col("k")).alias("r")).first().r == 1.0


def test_metric_edges(spark):
    d = spark.createDataFrame([(1, "a b b", "b b c"), (2, "", "x"), (3, None, None)], "id int, p string, r string")
    assert {r.id: round(r.word_f1, 4) for r in metrics.word_f1(d, "id", "p", "r").collect()} == {1: round(2 / 3, 4), 2: 0.0, 3: 0.0}


def test_half_way_rounding(spark):
    assert spark.createDataFrame([(0.03125,)], "x double").select(reports.mean("x")).first().x == 0.0312


def test_worst_backfills_and_caps(spark):
    d = spark.createDataFrame([(i, i < 5, float(i)) for i in range(60)], "id long, e boolean, s double")
    got = [r.id for r in reports.worst(d, "id", F.col("e"), F.col("s"), 50, 30).orderBy("position").collect()]
    assert got == [4, 3, 2, 1, 0, *range(59, 34, -1)]
    assert reports.worst(d, "id", F.lit(True), F.col("s"), 50, 30).count() == 50


def test_budget_stops_at_first_overflow(spark):
    d = spark.createDataFrame([("q", 1, "a b"), ("q", 2, "a b c d e"), ("q", 3, "a")], "q string, rank int, entry string")
    assert [r.used for r in prompt.budgeted(d, "q", 4).orderBy("rank").collect()] == [True, False, False]


def test_trimmed_contexts(spark):
    d = spark.createDataFrame([(["  " + "a" * 1000, "", "b" * 900, "c"],)], "x array<string>")
    assert [len(x) for x in d.select(prompt.trimmed_contexts(F.col("x"), 900, 1000).alias("y")).first().y] == [900, 100]


def test_bm25_prefers_rare_terms(spark):
    d = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "common other")], "id long, text string")
    q = spark.createDataFrame([(9, "common rare")], "qid long, text string")
    assert lexical.bm25(d, "id", q, "qid", T.sparse_tokens).orderBy(F.col("score").desc()).first().id == 1


@pytest.fixture(scope="module")
def index(spark):
    rows = [(f"d{i}-0", f"d{i}", f"document {i} about {'salary pay wages' if i % 2 else 'holiday leave rest'} number{i}") for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")
    edges = spark.createDataFrame([("d1", "d2"), ("d3", "d2")], "src string, dst string")
    return retriever.build(chunks, plugins.HashingEmbedder(32), {"cites": edges})


@pytest.mark.parametrize("strategy", retriever.STRATEGIES)
def test_strategies(spark, index, strategy):
    q = spark.createDataFrame([(1, "salary wages number3"), (2, "holiday number4")], "query_id long, text string")
    got = retriever.Retriever(index).retrieve(q, strategy, 4).collect()
    for i in (1, 2):
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4] and len({r.chunk_id for r in mine}) == 4
        assert [r.score for r in mine] == sorted((r.score for r in mine), reverse=strategy != "vector") and {r.retrieval_method for r in mine} == {strategy}


def test_fallback_without_edges_and_rerank(spark, index):
    q = spark.createDataFrame([(1, "salary wages number3")], "query_id long, text string")
    bare = retriever.Index(index.chunks, index.vectors, index.stems, index.words, index.embedder)
    assert {r.retrieval_method for r in retriever.Retriever(bare).retrieve(q, "graph", 3).collect()} == {"graph_seed_only"}
    top = retriever.Retriever(index, plugins.OverlapReranker()).retrieve(q, "hybrid", 2).orderBy("rank").collect()
    assert top[0].doc_id == "d3" and top[0].retrieval_method == "hybrid+rerank" and top[0].base_retrieval_method == "hybrid"
    with pytest.raises(ValueError):
        retriever.Retriever(index).retrieve(q, "nonsense")
    with pytest.raises(retriever.MissingDependency):
        retriever.require(index=None)
    with pytest.raises(ValueError, match="rebuild"):
        retriever.check_compatible("other", 8, index.embedder)


def test_judge_and_generator(spark):
    d = spark.createDataFrame([("q", "alpha beta", "alpha gamma", ["First. Second.", "Third"])], "q string, a string, r string, c array<string>")
    j = d.select(T.judge_reply(plugins.OverlapJudge().reply(F.col("q"), F.col("a"), F.col("r"))).alias("j")).first().j
    assert (j.score, j.label, j.error) == (0.5, "acceptable", None)
    assert d.select(plugins.ExtractiveGenerator().answer(F.lit(""), F.col("q"), F.col("c")).alias("x")).first().x == "First. [Source 1] Third [Source 2]"


def test_search_validates_and_stops():
    assert search.RunConfig(k=5.0, dense_weight=0.5).k == 5
    for bad in ({"k": 99}, {"k": True}, {"retriever": "x"}, {"dense_weight": "a"}):
        with pytest.raises(ValueError):
            search.RunConfig(**bad)
    seen = []

    def evaluate(c):
        seen.append(c.k)
        if c.k == 4:
            raise RuntimeError("boom")
        good = c.k >= 6
        return {"keyword_recall": 0.7 if good else 0.5, "word_f1": 0.35 if good else 0.1, "citation_faithfulness": 1.0}

    log = search.search(search.grid(k=[3, 4, 5, 6, 7]), evaluate, 10)
    assert seen == [3, 4, 5, 6] and [r["status"] for r in log] == ["ok", "failed", "ok", "ok"] and search.best(log)["k"] == 6
    assert search.RunConfig(use_reranker=True).label() == "hybrid_k8_rerank_p3"


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    src, sink, cp = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp"
    for i in (1, 2):
        spark.createDataFrame([(i, f"q{i}")], "id long, q string").write.mode("append").parquet(src)
        streams.append_json(streams.read_stream(spark, src), sink, cp, files.compact_json(F.struct("id", "q"))).awaitTermination()
        assert spark.read.text(sink).count() == i


def test_grids():
    coarse = fusion.weight_grid()
    assert len(coarse) == 9 and all(abs(a + b - 1) < 1e-9 for a, b in coarse)
    assert [a for a, _ in fusion.fine_grid(0.3, {a for a, _ in coarse})] == [0.25, 0.35]


def test_stemmed_bm25_equals_brute_force(spark):
    import math
    import re
    from collections import Counter

    from siltstone.functions.stem_fr import stem

    docs = [(1, "Les licenciements et le licenciement économique"), (2, "indemnité, indemnités, préavis"), (3, "Un préavis de licenciement"), (4, None), (5, ""), (3000, "travail " * 500)]
    asked = [(10, "licencier indemnités indemnité"), (11, "préavis travailler"), (12, "")]
    cut = lambda t: [s for s in (stem(w) for w in re.findall(r"\b\w\w+\b", (t or "").lower())) if s]
    tf = {k: Counter(cut(t)) for k, t in docs}
    avg = sum(len(re.findall(r"\b\w\w+\b", t or "")) for _, t in docs) / len(docs)
    want = {}
    for q, text in asked:
        for k, _ in docs:
            s = 0.0
            for w, n in Counter(cut(text)).items():
                df = sum(w in c for c in tf.values())
                dl = sum(tf[k].values())
                s += n * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[k][w] / (tf[k][w] + 1.5 * (0.25 + 0.75 * dl / avg)) if df else 0
            if s:
                want[q, k] = round(s, 6)
    got = lexical.bm25(spark.createDataFrame(docs, "id long, text string"), "id", spark.createDataFrame(asked, "qid long, text string"), "qid", T.sparse_tokens, stemmed=True)
    assert {(r.qid, r.id): round(r.score, 6) for r in got.collect()} == want and (10, 3) in want


def test_stored_indexes_are_reused_and_rebuilt(spark, index, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(retriever.MissingDependency):
        retriever.open_or_build(spark, path, None, plugins.HashingEmbedder(32))
    first = retriever.open_or_build(spark, path, index.chunks, plugins.HashingEmbedder(32), index.edges)
    again = retriever.open_or_build(spark, path, None, plugins.HashingEmbedder(32))
    assert again.chunks.count() == first.chunks.count() == index.chunks.count() and set(again.edges) == {"cites"}
    with pytest.raises(ValueError):
        retriever.open_or_build(spark, path, None, plugins.HashingEmbedder(64))
    q = spark.createDataFrame([(1, "salary wages number3")], "query_id long, text string")
    rows = lambda i: [tuple(r) for r in retriever.Retriever(i).retrieve(q, "hybrid", 3).orderBy("rank").collect()]
    assert rows(again) == rows(index)


def test_weights_of_unified_strategies_are_free(spark, index):
    q = spark.createDataFrame([(1, "salary wages number3")], "query_id long, text string")
    score = lambda w: [r.score for r in retriever.Retriever(index).retrieve(q, "unified", 3, weights=w).orderBy("rank").collect()]
    assert score((0.9, 0.1))[0] > 2 * score((0.2, 0.1))[0]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", None), (2, "é,;", "x")], "id long, text string, note string")
    files.write_jsonl(df, f"file://{tmp_path}/j")
    lines = [json.loads(x) for p in (tmp_path / "j").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["id"]) == [{"id": 1, "text": "a\nb"}, {"id": 2, "text": "é,;", "note": "x"}]
    files.write_csv(df.where("id = 2"), f"file://{tmp_path}/c", ";")
    assert [tuple(r) for r in spark.read.option("header", "true").option("sep", ";").csv(f"file://{tmp_path}/c").collect()] == [("2", "é,;", "x")]


def test_saved_tables_join_without_a_shuffle(spark, tmp_path):
    name = f"t{abs(hash(str(tmp_path)))}"
    df = spark.range(100).selectExpr("cast(id as string) as chunk_id", "id as n")
    try:
        for n in ("a", "b"):
            files.save_table(df, f"{name}{n}", "chunk_id", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        both = files.open_table(spark, f"{name}a").join(files.open_table(spark, f"{name}b").withColumnRenamed("n", "m"), "chunk_id")
        assert both.count() == 100 and "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in ("a", "b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}{n}")


def test_citations_are_taken_out(spark):
    d = spark.createDataFrame([("Yes [Source 1]. No [source 2] [Source  3]",), (None,)], "a string")
    assert [r.x for r in d.select(T.without_citations(F.col("a")).alias("x")).collect()] in (["Yes. No [source 2]", None], ["Yes. No", None])


def test_counts_come_from_the_write(spark, tmp_path):
    text = "Un paragraphe assez long pour un morceau. " * 60
    rows = [(i, f"{text} {i}") for i in range(20)] + [(100 + i, f"{text} {i % 5}") for i in range(7)] + [(200, ""), (201, None), (202, "court")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts = corpus.write_chunks(df, f"file://{tmp_path}/c", "text", "doc_id")
    written = spark.read.parquet(f"file://{tmp_path}/c")
    assert counts == {"documents": 30, "duplicates": 7, "skipped": 23 - written.select("doc_id").distinct().count(), "chunks": written.count()} and counts["chunks"] > 20


def test_unified_table_holds_variants_and_joins_without_its_shuffle(spark, tmp_path):
    name = f"u{abs(hash(str(tmp_path)))}"
    chunks = spark.createDataFrame([(f"c{i}", f"d{i // 3}", f"text {i}", "s", "t", i, {"a": str(i)}) for i in range(50)], "chunk_id string, doc_id string, text string, source string, title string, chunk_index int, more map<string,string>")
    vectors_ = spark.createDataFrame([(f"c{i}", [float(i), 1.0]) for i in range(50)], "chunk_id string, vector array<float>")
    try:
        files.save_unified(chunks, vectors_, name, 2, 4)
        table = files.open_table(spark, name)
        assert dict(table.dtypes)["metadata"] == "variant"
        got = files.unpack_metadata(table, {"chunk_index": "int", "more.a": "string", "none": "string"}).select("chunk_id", "chunk_index", F.col("`more.a`").alias("a"), "none").collect()
        assert sorted((r.chunk_id, r.chunk_index, r.a, r.none) for r in got) == sorted((f"c{i}", i, str(i), None) for i in range(50))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ranked = spark.range(10).selectExpr("concat('c', id) as chunk_id", "id as rank")
        joined = ranked.join(table.select("chunk_id", "text"), "chunk_id")
        assert joined.count() == 10 and joined._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the ranked rows
        old = spark.createDataFrame([('{"a": 5}',), ("bad",), (None,)], "metadata_json string")
        assert [r.a for r in files.unpack_metadata(old, {"a": "long"}).collect()] == [5, None, None]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_results_are_rewritten_in_order_over_several_files(spark, tmp_path):
    schema = "question_id int, answer string"
    rows = [((i * 37) % 500, f"a{i}") for i in range(500)]
    for part in (rows[:200], rows[200:210], rows[210:]):  # as runs add them
        spark.createDataFrame(part, schema).write.mode("append").json(f"file://{tmp_path}/runs")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.rewrite_in_order(spark, f"file://{tmp_path}/runs", f"file://{tmp_path}/sorted", schema, "question_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "sorted").glob("*.json"))
    ids = [json.loads(x)["question_id"] for p in parts for x in p.read_text().splitlines()]
    assert len(parts) > 3 and ids == list(range(500))


def test_an_index_has_the_parts_that_are_searched(spark, tmp_path):
    """A dense search needs no inverted index; the first strategy that does builds the one it searches, from the stored chunks."""
    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", f"texte mot{i}x de la loi") for i in range(20)], "chunk_id string, doc_id string, text string")
    path, e = f"file://{tmp_path}/index", plugins.HashingEmbedder(32)
    q = spark.createDataFrame([(1, "mot7x")], "query_id long, text string")
    there = lambda: {n for n in ("stems", "words") if (tmp_path / "index" / n / "stats").exists()}
    dense = retriever.open_or_build(spark, path, chunks, e, sparse=retriever.needed("dense"))
    assert retriever.Retriever(dense).retrieve(q, "dense", 3).count() == 3 and there() == set()
    with pytest.raises(retriever.MissingDependency):
        retriever.Retriever(dense).retrieve(q, "hybrid", 3)
    found = retriever.Retriever(retriever.open_or_build(spark, path, None, e, sparse=retriever.needed("unified"))).retrieve(q, "unified", 3)
    assert found.orderBy("rank").first().chunk_id == "c7" and there() == {"words"}
    assert retriever.open_or_build(spark, path, None, e).stems.n_docs == 20 and there() == {"stems", "words"}


def test_texts_are_embedded_where_they_are_read(spark):
    """Texts of all chunks are not shuffled to be embedded; copies get the same vector, chunks without a text none."""
    chunks = spark.createDataFrame([("a", "loi du travail"), ("b", "loi du travail"), ("c", None), ("d", "autre")], "chunk_id string, text string")
    found = retriever.embedded(chunks, plugins.HashingEmbedder(32))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    v = {r.chunk_id: r.vector for r in found.collect()}
    assert set(v) == {"a", "b", "d"} and v["a"] == v["b"] != v["d"]
