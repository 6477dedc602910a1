"""An evaluation run, its models' stand-ins, reports and bookkeeping on small data."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import corpus, fusion, metrics, reports
from siltstone.plans import evaluate, plugins, retriever, search
from siltstone.sources import files


@pytest.fixture(scope="module")
def results(spark):
    chunks = spark.createDataFrame([(f"d{i}-0", f"d{i}", f"word{i} salary of the worker number{i}. Second sentence.") for i in range(12)], "chunk_id string, doc_id string, text string")
    index = retriever.build(chunks, plugins.HashingEmbedder(32))
    q = spark.createDataFrame([(1, "salary word3 number3", "word3 salary", ["word", "salary"], "a"), (2, "", "", [], None), (3, "number5 worker", "nothing alike", ["absent"], "b")], "query_id long, text string, reference string, keywords array<string>, topic string")
    models = evaluate.Models(plugins.ExtractiveGenerator(), plugins.OverlapJudge(), plugins.OverlapSemanticJudge(), plugins.EmbeddingSimilarity(plugins.HashingEmbedder(32)))
    return evaluate.run(q, retriever.Retriever(index), models, "hybrid", 3).cache(), q, index


def test_run_has_every_metric(results):
    rows = {r.query_id: r for r in results[0].collect()}
    assert set(rows) == {1, 2, 3} and rows[1].keyword_recall == 1.0 and rows[1].citation_faithfulness == 1.0
    assert rows[1].judge.label == "acceptable" and rows[3].judge.label == "incorrect" and rows[2].semantic.error == "missing_question"
    assert rows[1].context_coverage == 0.8 and rows[1].hallucination_risk == 0.2 and 0 <= rows[1].similarity_f1 <= 1 and rows[1].n_retrieved == 3
    report = {r.topic: r.n for r in evaluate.report(results[0]).collect()}
    assert report == {"a": 1, "b": 1, None: 1, "OVERALL": 3}
    assert {r.topic for r in reports.without_overall(evaluate.report(results[0]), "topic").collect()} == {"a", "b", None}


def test_run_without_models(results):
    _, q, index = results
    out = evaluate.run(q, retriever.Retriever(index), evaluate.Models(plugins.ExtractiveGenerator()), "dense", 2).collect()
    assert len(out) == 3 and all(r.judge is None and r.semantic is None and r.similarity_f1 is None for r in out)


def test_report_has_every_metric(results):
    """What a run computes of each question reaches its report, the risk among it; a run without models has no scores of theirs."""
    rows = results[0].collect()
    total = evaluate.report(results[0]).where("topic = 'OVERALL'").first()
    mean = lambda x: pytest.approx(sum(v for v in x if v is not None) / sum(v is not None for v in x), abs=1e-4)
    for name in ("keyword_recall", "word_f1", "context_coverage", "citation_faithfulness", "hallucination_risk", "similarity_f1"):
        assert total[name] == mean([r[name] for r in rows]), name
    assert total.judge_score == mean([r.judge.score for r in rows]) and total.faithfulness == mean([r.semantic.faithfulness for r in rows])
    assert total.context_precision == mean([r.semantic.context_precision for r in rows]) and 0 < total.hallucination_risk < 1
    _, q, index = results
    bare = evaluate.report(evaluate.run(q, retriever.Retriever(index), evaluate.Models(plugins.ExtractiveGenerator()), "dense", 2)).where("topic = 'OVERALL'").first()
    assert bare.judge_score is None and bare.faithfulness is None and bare.context_precision is None and bare.similarity_f1 is None and bare.hallucination_risk is not None


def test_semantic_scores(spark):
    d = spark.createDataFrame([("q", "word", "word", ["word x"]), ("q", "[Source 1]", "r", ["c"]), ("q", "a", None, ["c"]), ("q", "a", "r", [" ", None]), (None, "a", "r", ["c"])], "q string, a string, r string, c array<string>")
    s = [r.s for r in d.select(metrics.semantic_scores(F.col("q"), F.col("a"), F.col("r"), F.col("c"), plugins.OverlapSemanticJudge()).alias("s")).collect()]
    assert [x.error for x in s] == [None, "missing_answer", "missing_reference_answer", "missing_retrieved_contexts", "missing_question"]
    assert s[0].faithfulness == 1.0 and s[0].context_precision == 1.0 and s[1].faithfulness is None


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert plugins.with_retries(call, sleep=waits.append) == "ok" and waits == [10.0, 20.0]
    with pytest.raises(ZeroDivisionError):
        plugins.with_retries(lambda: 1 / 0, tries=2, sleep=waits.append)


def test_configuration():
    assert search.truthy(" Yes ") and not search.truthy("0", True) and search.truthy(None, True)
    assert search.backend() == search.BACKENDS[0] and search.backend(None, "CEREBRAS ") == "cerebras"
    with pytest.raises(ValueError):
        search.backend("other")


def test_outputs_that_are_missing(spark, tmp_path):
    (tmp_path / "out" / "b").mkdir(parents=True)
    (tmp_path / "out" / "a.json").write_text("{}")
    (tmp_path / "out" / "b" / "c.json").write_text("{}")
    want = spark.createDataFrame([("a.json",), ("b/c.json",), ("b/d.json",)], "path string")
    assert [r.path for r in files.missing_outputs(want, str(tmp_path / "out")).collect()] == ["b/d.json"]
    assert files.missing_outputs(want, str(tmp_path / "none")).count() == 3


def test_markdown_report(spark):
    d = spark.createDataFrame([("a|b", 0.5, None)], "topic string, score double, note string")
    assert reports.markdown(d, "Report") == "# Report\n\n| topic | score | note |\n|---|---|---|\n| a\\|b | 0.5 |  |\n"
    with pytest.raises(ValueError):
        reports.markdown(spark.range(5), "x", most=4)


def test_ablation(spark):
    d = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.5), (1, 3, 0.5), (2, 1, 0.3), (2, 2, 0.31), (2, 3, 0.3)], "q int, v int, s double")
    a = reports.ablation(d, "q", "v", "s")
    assert {r.q: (r.delta, r.best, r.diagnosis) for r in a.collect()} == {1: (0.3, 2, "prompt_sensitive"), 2: (0.01, 2, "metric_penalty")}
    assert reports.ablation_verdict(a).first().verdict == "mixed" and reports.ablation_verdict(a.where("q = 1")).first().verdict == "prompt_sensitive"


def test_records_and_pages(spark):
    raw = spark.createDataFrame([("legislation", "/a/b@2020", None, "t", ["x"]), ("other", "/z", "T", "t", None)], "type string, path string, title string, enBody string, thematic array<string>")
    (r,) = corpus.records(raw, "https://x").collect()
    assert (r.titre, r.source, r.type) == ("", "https://x/a/b", "legislation") and r.metadata["thematic"] == '["x"]' and r.metadata["liens"] == "[]"
    page = '<html lang="fr"><title>T</title><time datetime="2024-03-05T10:00">x</time> paru le 01/02/2023</html>'
    d = spark.createDataFrame([(page, "https://h/cat/1"), ("<p>le 01/02/2023 ou 45/13/2020</p>", "https://h/"), ("45/13/2020", "x")], "html string, url string")
    f = corpus.page_record(F.col("html"), F.col("url"))
    assert [tuple(x) for x in d.select(f["date"], f["category"]).collect()] == [("2024-03-05", "cat"), ("2023-02-01", ""), ("", "")]
    assert [x[0] for x in spark.createDataFrame([("Erreur 404", "x" * 60), ("ok", "short"), ("ok", "x" * 50)], "t string, b string").select(corpus.usable_page(F.col("t"), F.col("b"))).collect()] == [False, False, True]


def test_preferred_payload(spark):
    a, b = spark.createDataFrame([(1, "v", None), (2, "w", "x")], "id int, t string, u string"), spark.createDataFrame([(1, "f", "g"), (3, "h", "i")], "id int, t string, u string")
    assert sorted(tuple(r) for r in fusion.preferred(a, b, "id").collect()) == [(1, "v", "g"), (2, "w", "x"), (3, "h", "i")]


def test_accents_in_both_forms(spark):
    d = spark.createDataFrame([("é é ŝ Ž ǘ ß œ",)], "s string")
    assert d.select(T.fold_accents(F.col("s"))).first()[0] == "e e s z u ß œ"


def test_stemmed_keyword_recall(spark):
    rows = [(1, "Les licenciements sont possibles", ["licenciement"], 1.0), (2, "indemnités versées au salarié", ["indemnité", "préavis"], 0.5), (3, "", ["mot"], 0.0), (4, "travail", [], 1.0)]
    for _, answer, words, want in rows:
        d = spark.createDataFrame([(answer, " ".join(words))], "a string, w string").select(metrics.canonical_tokens(F.col("a")).alias("p"), F.transform(metrics.canonical_tokens(F.col("w")), lambda x: F.array(x)).alias("k"))
        assert d.select(metrics.keyword_recall(F.col("p"), F.col("k"))).first()[0] == want
