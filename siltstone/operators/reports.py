"""Analyses of evaluation runs: roll-ups, sweeps, classes, comparisons, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.files import materialise

# Thresholds of the analyses.
KW_GATE, F1_GATE, COV_GATE, RANK_TOLERANCE = 0.60, 0.25, 0.55, 0.20
F1_LOW, BERT_HIGH, JUDGE_HIGH = 0.25, 0.75, 0.60
KPI_KW, KPI_COV = 0.55, 0.60
AMBIGUOUS = {"word_f1": (0.25, 0.15), "context_coverage": (0.80, 0.20), "citation_faithfulness": (0.95, 0.10)}


def mean(c: str) -> Column:
    """Null-skipping mean, 4 places, half to even; 0 without values."""
    return F.coalesce(F.bround(F.avg(c), 4), F.lit(0.0)).alias(c)


def rollup(df: DataFrame, topic: str, metrics: list[str], mark: bool = False, optional: tuple[str, ...] = ()) -> DataFrame:
    """Rows of every topic, the null one included, and one OVERALL row, in one aggregation; `mark` adds the column is_overall.

    Means of optional metrics are null without values, as a model that was not asked has no score of 0.
    """
    scored = [F.bround(F.avg(c), 4).alias(c) for c in optional]
    out = df.rollup(topic).agg(F.grouping(topic).alias("__g"), F.count(F.lit(1)).alias("n"), *map(mean, metrics), *scored)
    out = out.withColumn(topic, F.when(F.col("__g") == 1, F.lit("OVERALL")).otherwise(F.col(topic)))
    return (out.withColumn("is_overall", F.col("__g") == 1) if mark else out).drop("__g")


def without_overall(df: DataFrame, topic: str) -> DataFrame:
    """A report's rows without its OVERALL row; rows of no topic stay, and so does a topic of that name if the report marks its own row."""
    if "is_overall" in df.columns:
        return df.where("not is_overall").drop("is_overall")
    return df.where(~F.col(topic).eqNullSafe(F.lit("OVERALL")))


def reaching(df: DataFrame, kw: str = "kw", cov: str = "cov") -> DataFrame:
    """Configurations whose mean recall and coverage reach the published targets."""
    return df.where((F.col(kw) >= KPI_KW) & (F.col(cov) >= KPI_COV))


def z(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def is_error(kw: str, f1: str, cov: str, cit: str) -> Column:
    return (z(kw) < KW_GATE) | (z(f1) < F1_GATE) | (z(cov) < COV_GATE) | (z(cit) < 1.0)


def severity(kw: str, f1: str, cov: str, cit: str) -> Column:
    short = lambda gate, c: F.greatest(F.lit(0.0), gate - z(c))
    return 2.0 * short(KW_GATE, kw) + 3.0 * short(F1_GATE, f1) + short(COV_GATE, cov) + short(1.0, cit)


def taxonomy(raw_kw: str, rerank_kw: str) -> Column:
    a, b = z(raw_kw), z(rerank_kw)
    return F.when(a < KW_GATE, "retrieval_miss").when((b + RANK_TOLERANCE < a) | (b < KW_GATE), "rank_miss").otherwise("gen_bad")


def worst(df: DataFrame, key: str, error: Column, sev: Column, most: int = 50, least: int = 30) -> DataFrame:
    """Errors, most severe first, `most` at most; filled up to `least` with the most severe of the rest."""
    d = df.withColumns({"is_error": error, "severity": F.bround(sev, 9)})
    n = d.agg(F.least(F.lit(most), F.greatest(F.count_if("is_error"), F.lit(least))).alias("n"))
    top = d.orderBy(F.col("is_error").desc(), F.col("severity").desc(), F.col(key).desc()).limit(most)
    w = Window.orderBy(F.col("is_error").desc(), F.col("severity").desc(), F.col(key).desc())
    return top.withColumn("position", F.row_number().over(w)).join(F.broadcast(n), F.col("position") <= F.col("n")).drop("n")


def disagreement(f1: str, bert: str, judge: str, label: str) -> Column:
    low = F.col(f1) < F1_LOW
    bert_ok = F.coalesce(F.col(bert) >= BERT_HIGH, F.lit(False))
    judged = F.coalesce(F.col(judge) >= JUDGE_HIGH, F.lit(False)) | F.coalesce(F.col(label) == "acceptable", F.lit(False))
    return (
        F.when(F.col(f1).isNull(), "no_word_f1").when(low & bert_ok & judged, "metric_penalty").when(low & bert_ok, "retrieval_ok_gen_bad")
        .when(low & judged, "bert_word_disagree").when(low, "true_failure").otherwise("ok")
    )


def proximity(c: str, threshold: float, span: float) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.least(F.abs(F.col(c) - threshold) / span, F.lit(1.0))), F.lit(0.0))


# Weights of the gap between metrics, of three near thresholds and of a judge's doubt.
AMBIGUITY = (0.45, 0.20, 0.20, 0.10, 0.05)


def ambiguity(f1: str = "word_f1", bert: str = "bertscore_f1", cov: str = "context_coverage", cit: str = "citation_faithfulness", judge: str = "judge_score") -> Column:
    apart = F.col(bert) - F.col(f1)
    gap = F.when(apart.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), apart)))
    near = [proximity(c, *AMBIGUOUS[n]) for c, n in ((f1, "word_f1"), (cov, "context_coverage"), (cit, "citation_faithfulness"))]
    parts = [gap, *near, proximity(judge, 0.50, 0.25)]
    return F.bround(sum((w * p for w, p in zip(AMBIGUITY[1:], parts[1:], strict=True)), AMBIGUITY[0] * parts[0]), 4)


def ambiguity_signals(f1: str = "word_f1", bert: str = "bertscore_f1", cov: str = "context_coverage", cit: str = "citation_faithfulness", judge: str = "judge_score") -> Column:
    flags = {
        "semantic_metric_disagreement": F.col(bert) - F.col(f1) >= 0.45,
        "near_word_f1_threshold": proximity(f1, *AMBIGUOUS["word_f1"]) >= 0.7,
        "near_context_threshold": proximity(cov, *AMBIGUOUS["context_coverage"]) >= 0.7,
        "near_citation_threshold": proximity(cit, *AMBIGUOUS["citation_faithfulness"]) >= 0.7,
        "judge_borderline": F.col(judge).between(0.35, 0.65),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


# Words of a judge's reason and the signal that each set stands for; words of a question and its topic.
REASONS = [
    (("omet", "omise", "omises"), "omission"), (("se concentre", "limite"), "scope_too_narrow"), (("générale", "général"), "missed_general_rule"),
    (("indemnit",), "missing_indemnities"), (("condition",), "missing_conditions"), (("délai", "recours"), "missing_timeline_or_remedies"),
]
TOPICS = [
    (("retraite",), "retraite"), (("formation",), "formation"), (("cotisations",), "cotisations_sociales"), (("discrimination",), "discrimination"), (("temps partiel",), "temps_partiel"),
    (("représentation du personnel",), "representants_personnel"), (("prime", "rémunération"), "primes_remuneration"), (("fonctionnaires",), "fonction_publique"),
]


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def reason_signals(reason: Column) -> Column:
    low = F.lower(reason)
    flags = [F.when(_any(low, words), F.lit(name)) for words, name in REASONS]
    flags.insert(2, F.when(_any(reason, ("n’", "n'")) & low.contains("ne mentionne"), F.lit("missing_mentions")))
    flags.insert(4, F.when(low.contains("secteur") & low.contains("priv"), F.lit("public_private_confusion")))
    return F.array_compact(F.array(*flags))


def topic_of(question: Column) -> Column:
    out = F.lit("other")
    for words, name in reversed(TOPICS):
        out = F.when(_any(F.lower(question), words), name).otherwise(out)
    return out


def threshold_sweep(df: DataFrame, score: str, truth: Column, reference: Column, thresholds: list[float]) -> DataFrame:
    """(threshold, pass_rate, agreement, reference_agreement) of calling score >= threshold right."""
    t = F.explode(F.array(*map(F.lit, thresholds)))
    d = df.where(F.col(score).isNotNull()).select(score, truth.alias("__t"), reference.alias("__r"), t.alias("threshold")).withColumn("__p", F.col(score) >= F.col("threshold"))
    share = lambda c: F.bround(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return d.groupBy("threshold").agg(share(F.col("__p")).alias("pass_rate"), share(F.col("__p") == F.col("__t")).alias("agreement"), share(F.col("__p") == F.col("__r")).alias("reference_agreement"))


def pearson(x: str, y: str) -> Column:
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def shares(df: DataFrame, label: str, places: int = 1) -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.bround(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), places))


def relative_change(new: Column, old: Column, lower_is_better: bool = False) -> Column:
    d = (new - old) / F.nullif(old, F.lit(0.0)) * 100
    return -d if lower_is_better else d


def composite(kw: Column, f1: Column) -> Column:
    return F.when(f1.isNull(), kw).otherwise(0.5 * kw + 0.5 * f1)


def falsy(a: Column, b: Column) -> Column:
    """a unless it is null or zero, else b."""
    return F.coalesce(F.nullif(a, F.lit(0.0)), b)


def label(metadata: Column, chunk_id: Column) -> Column:
    """What a source card says of a chunk: nature, number, court, journal and chunk, those that are known."""
    get = lambda k: F.nullif(F.element_at(metadata, k), F.lit(""))
    named = lambda prefix, c: F.when(c.isNotNull(), F.concat(F.lit(prefix), c))
    return F.concat_ws(" · ", get("document_nature"), named("n° ", get("document_number")), get("jurisdiction"), named("Journal ", get("journal_number")), named("chunk ", F.nullif(chunk_id, F.lit(""))))


def most_common(df: DataFrame, item: str, n: int = 6) -> DataFrame:
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), item).limit(n)


def ablation(df: DataFrame, question: str, version: str, score: str, sensitive: float = 0.05) -> DataFrame:
    """(question, delta, best, diagnosis): spread of a question's scores over prompt versions, the best version (of equal ones the first)."""
    d = df.groupBy(question).agg(F.bround(F.max(score) - F.min(score), 4).alias("delta"), F.max_by(version, F.struct(score, -F.col(version))).alias("best"))
    return d.withColumn("diagnosis", F.when(F.col("delta") < sensitive, "metric_penalty").otherwise("prompt_sensitive"))


def ablation_verdict(df: DataFrame, share: float = 0.6) -> DataFrame:
    """One row over ablation: counts of both diagnoses, the mean delta and what over 60 % of the questions say."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("diagnosis") == "metric_penalty").alias("metric_penalty"), F.count_if(F.col("diagnosis") == "prompt_sensitive").alias("prompt_sensitive"), F.bround(F.coalesce(F.avg("delta"), F.lit(0.0)), 4).alias("mean_delta"))
    over = lambda c: F.col(c) > F.col("n") * share
    return a.withColumn("verdict", F.when(over("metric_penalty"), "metric_penalty").when(over("prompt_sensitive"), "prompt_sensitive").otherwise("mixed"))


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small report as a Markdown table; more than `most` rows are an error, as a report is read by people."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])


def audit_packet(questions: DataFrame, audit: DataFrame, chunks: DataFrame, results: DataFrame, top: DataFrame) -> DataFrame:
    """One row per audited question: its result, the chunks used in its prompt with their texts in rank order, and its ranked list.

    questions (question_id, question), audit (event_id, question, chunks array of (chunk_id, rank, used)), chunks (chunk_id, text), results
    (question_id, ...), top (question_id, rank, chunk_id). Audits of unknown questions go; unknown chunks have the empty text.
    """
    a = audit.join(questions, "question").join(results, "question_id")
    each = a.select("event_id", F.explode("chunks").alias("c")).where("c.used").select("event_id", "c.chunk_id", "c.rank").join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    used = each.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", F.coalesce("text", F.lit("")).alias("text")))).alias("used_chunks"))
    ranked = top.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("top_chunks"))
    return a.drop("chunks").join(used, "event_id", "left").join(ranked, "question_id", "left")


def best_by(df: DataFrame, key: str, high: list[str], low: list[str]) -> DataFrame:
    """(metric, key): the row that is best in each metric; of equal ones the smallest key."""
    best = [F.max_by(key, F.struct(c, -F.col(key))).alias(c) for c in high] + [F.min_by(key, F.struct(c, key)).alias(c) for c in low]
    names = [*high, *low]
    return df.agg(*best).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("metric", key))


#: A sketch is asked for its values at so many equal steps.
STEPS = 64


def exact_quantiles(df: DataFrame, group: str, value: str, shares: list[float], most: int = 10_000, k: int = 200) -> DataFrame:
    """(group, share, quantile): exact quantiles with linear interpolation between neighbours; nulls and NaN are no values.

    A mergeable sketch brackets the ranks that a quantile lies between; only values in the bracket go on, to the next sketch while they are
    more than `most`, then, with their counts, into one sorted row. So what is held of a group is a sketch or about `most` values, whatever its size.
    A bracket is only taken when counts show that it holds both ranks, and a sketch that narrows nothing ends the search.
    """
    rows = df.select(F.col(group).alias("__k"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    share = F.explode(F.array(*map(F.lit, shares))).alias("share")
    b = rows.groupBy("__k").agg(F.count(F.lit(1)).alias("m")).select("__k", "m", share)
    p = F.col("share") * (F.col("m") - 1)
    b = b.select("__k", "share", (p - F.floor(p)).alias("part"), F.floor(p).alias("i"), F.ceil(p).alias("j"), low.alias("lo"), high.alias("hi"), F.lit(0).cast("long").alias("below"), "m")
    slack, key, rest = 0.03, ["__k", "share"], ["part", "i", "j", "lo", "hi", "below", "m"]

    def inside(b: DataFrame) -> DataFrame:
        r = rows.withColumnRenamed("__k", "__g")
        return b.join(r, F.col("__k").eqNullSafe(F.col("__g"))).where("v >= lo and v <= hi").drop("__g")

    b = materialise(b.withColumn("open", F.col("m") > most), "quantile-brackets")
    while not (wide := b.where("open")).isEmpty():
        s = inside(wide).groupBy(*key, *rest).agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("s"))
        s = s.withColumn("grid", F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))).drop("s")
        step = lambda rank, d: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(rank) - F.col("below")) / F.col("m") + d)) * STEPS
        s = s.withColumns({"l": F.get("grid", F.floor(step("i", -slack)).cast("int")), "h": F.get("grid", F.ceil(step("j", slack)).cast("int"))})
        s = materialise(s.drop("grid"), "quantile-sketches")
        less, held = F.count_if(F.col("v") < F.col("l")).alias("less"), F.count_if((F.col("v") >= F.col("l")) & (F.col("v") <= F.col("h"))).alias("held")
        t = inside(s).groupBy(*key, *rest, "l", "h").agg(less, held)
        holds = (F.col("below") + F.col("less") <= F.col("i")) & (F.col("j") < F.col("below") + F.col("less") + F.col("held"))
        new = lambda a, c: F.when(holds, F.col(a)).otherwise(F.col(c)).alias(c)
        go_on = holds & (F.col("held") > most) & (F.col("held") < 0.9 * F.col("m"))  # a bracket that stays has few values, many times each
        t = t.withColumn("more", F.col("below") + F.col("less"))
        t = t.select(*key, "part", "i", "j", new("l", "lo"), new("h", "hi"), new("more", "below"), new("held", "m"), go_on.alias("open"))
        b = materialise(b.where("not open").unionByName(t), "quantile-brackets")
    each = inside(b).groupBy(*key, "part", "i", "j", "below", "v").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy(*key, "part", "i", "j", "below").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("x"))
    none = F.lit(None).cast("double")
    start = F.struct(F.col("below").alias("at"), none.alias("a"), none.alias("b"))
    pick = lambda old, c, s, x: F.when((s.at <= F.col(c)) & (F.col(c) < s.at + x.n), x.v).otherwise(old)
    found = F.aggregate("x", start, lambda s, x: F.struct((s.at + x.n).alias("at"), pick(s.a, "i", s, x).alias("a"), pick(s.b, "j", s, x).alias("b")))
    out = each.select(F.col("__k").alias(group), "share", "part", found.alias("f"))
    return out.select(group, "share", (F.col("f.a") + (F.col("f.b") - F.col("f.a")) * F.col("part")).alias("quantile"))
