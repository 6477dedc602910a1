"""An evaluation run as one plan: retrieval, prompts, answers, all metrics of every question, and its reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import metrics, prompt, reports
from siltstone.plans import plugins
from siltstone.plans.retriever import Retriever


@dataclass
class Models:
    """What needs a model in a run; a judge or scorer that is absent leaves its columns null."""

    generator: plugins.Generator
    judge: plugins.Judge | None = None
    semantic: plugins.SemanticJudge | None = None
    similarity: plugins.Similarity | None = None


def run(questions: DataFrame, retriever: Retriever, models: Models, strategy: str = "hybrid", k: int = 8, budget: int = 3000, **options) -> DataFrame:
    """questions (query_id, text, reference, keywords array<string>, topic) -> one row of answer and metrics for each.

    A question without retrieved chunks has an empty context; coverage is of the context that the answer was given.
    """
    found = retriever.retrieve(questions.select("query_id", "text"), strategy, k, **options)
    entry = prompt.entry(F.col("rank"), F.col("doc_id"), F.lit("chunk"), F.lit(""), F.col("text"))
    ranked = prompt.budgeted(found.select("query_id", "rank", "doc_id", "text", entry.alias("entry")), "query_id", budget)
    each = F.sort_array(F.collect_list(F.when(F.col("used"), F.struct("rank", "text", "entry", "doc_id"))))
    g = questions.join(ranked.groupBy("query_id").agg(each.alias("c")), "query_id", "left")
    none = F.array().cast("array<struct<rank:int,text:string,entry:string,doc_id:string>>")
    g = g.withColumn("c", F.coalesce("c", none)).withColumns({"contexts": F.transform("c", lambda x: x.text), "n_retrieved": F.size("c").cast("long"), "sources": F.transform("c", lambda x: x.doc_id)})
    message = F.concat(F.array_join(F.transform("c", lambda x: x.entry), prompt.SEPARATOR), F.lit("\n\nQuestion : "), F.col("text"))
    g = g.withColumn("answer", models.generator.answer(message, F.col("text"), F.col("contexts"))).withColumn("context", F.array_join("contexts", " ")).drop("c")
    null = lambda kind: F.lit(None).cast(kind)
    words = F.transform("keywords", lambda w: metrics_tokens(w))
    g = g.withColumns({
        "keyword_recall": F.bround(metrics.keyword_recall(metrics.canonical_tokens(F.col("answer"), False), words), 4),
        "citation_faithfulness": metrics.citation_faithfulness(F.col("answer"), F.col("n_retrieved")),
        "judge": T.judge_reply(models.judge.reply(F.col("text"), F.col("answer"), F.col("reference"))) if models.judge else null("struct<score:double,label:string,reason:string,error:string>"),
        "semantic": metrics.semantic_scores(F.col("text"), F.col("answer"), F.col("reference"), F.col("contexts"), models.semantic) if models.semantic else null("struct<faithfulness:double,context_precision:double,error:string>"),
        "similarity_f1": models.similarity.f1(F.col("answer"), F.col("reference")) if models.similarity else null("double"),
    })
    f1 = metrics.word_f1(g, "query_id", "answer", "reference").withColumn("word_f1", F.bround("word_f1", 4))
    cov = metrics.context_coverage(g, "query_id", "answer", "context")
    out = g.join(f1, "query_id").join(cov, "query_id").withColumn("hallucination_risk", metrics.hallucination_risk(F.col("context_coverage")))
    return out.drop("contexts", "context", "keywords")


def metrics_tokens(word):
    return F.transform(T.metric_tokens(word), lambda x: T.fold_accents(x))


def report(results: DataFrame) -> DataFrame:
    """Means by topic and overall of every metric of a run; those of models that the run did not have are null."""
    scored = {"judge_score": F.col("judge.score"), "faithfulness": F.col("semantic.faithfulness"), "context_precision": F.col("semantic.context_precision")}
    always = ["keyword_recall", "word_f1", "context_coverage", "citation_faithfulness", "hallucination_risk"]
    return reports.rollup(results.withColumns(scored), "topic", always, optional=(*scored, "similarity_f1"))


def k_report(runs: DataFrame, k: str = "k", metrics: tuple[str, str, str] = ("kw", "f1", "cov"), latency: str = "latency") -> DataFrame:
    """One row for each k of a sweep: means, which k is best by what (the smaller of equals), whether the targets are met, which is recommended (best recall), and the
    gain of recall and the added latency for each k more. Latency is best when small."""
    from pyspark.sql import Window

    g = runs.groupBy(k).agg(*map(reports.mean, metrics), F.bround(F.avg(latency), 4).alias(latency))
    w = Window.orderBy(k)  # one row for each k
    first = lambda order: F.row_number().over(Window.orderBy(order, k)) == 1
    more = lambda c: F.bround((F.col(c) - F.lag(c).over(w)) / (F.col(k) - F.lag(k).over(w)), 6)
    best = {f"best_{m}": first(F.col(m).desc()) for m in metrics} | {f"best_{latency}": first(F.col(latency).asc())}
    kw, _, cov = metrics
    met = (F.col(kw) >= reports.KPI_KW) & (F.col(cov) >= reports.KPI_COV)
    return g.withColumns(best | {"meets_targets": met, "gain_per_k": more(kw), "latency_per_k": more(latency)}).withColumn("recommended", F.col(f"best_{kw}"))


def rerank_deltas(runs: DataFrame, reranked: str, metrics: tuple[str, ...] = ("kw", "f1", "cov", "latency")) -> DataFrame:
    """(metric, base, reranked, delta): means of runs without and with a reranker, in one pass."""
    mean = lambda m, r: F.bround(F.avg(F.when(F.col(reranked) == r, F.col(m))), 4)
    one = runs.agg(*[mean(m, r).alias(f"{m}_{int(r)}") for m in metrics for r in (False, True)])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_0").alias("base"), F.col(f"{m}_1").alias("reranked")) for m in metrics])).alias("r")
    return one.select(rows).select("r.*").withColumn("delta", F.bround(F.col("reranked") - F.col("base"), 4))


def k_sweep(ranking: DataFrame, query: str, hit: str, ks: list[int]) -> DataFrame:
    """(k, recall, step): mean share of hits among the first k rows for every k of one ranking, and the gain per added row."""
    from pyspark.sql import Window

    r = ranking.select(query, "rank", hit, F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k")
    each = r.groupBy("k", query).agg(F.avg(F.col(hit).cast("double")).alias("s")).groupBy("k").agg(F.avg("s").alias("recall"))
    w = Window.orderBy("k")  # one row for each k
    step = (F.col("recall") - F.lag("recall").over(w)) / (F.col("k") - F.lag("k").over(w))
    return each.select("k", F.bround("recall", 6).alias("recall"), F.bround(step, 6).alias("step"))
