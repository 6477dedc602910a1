"""Queries of run analyses. A run row is an event: its type is the topic, its value scaled to 0..1 a metric."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import reports as R
from siltstone.plans import evaluate
from siltstone.plans.base import Catalog

C = Catalog()

# Five metrics of every event, the same in both dialects: exact decimals of hashes of ids, some null.
_M = {"kw": (7919, 101), "f1": (104729, 97), "cov": (1299709, 89), "cit": (15485863, 7), "bert": (32452843, 83), "judge": (49979687, 79)}
_SQL_M = ", ".join(f"CASE WHEN event_id % {p} = 3 THEN NULL ELSE round_even((event_id * {a} % {p}) / {p - 1}.0::DOUBLE, 4) END AS {n}" for n, (a, p) in _M.items())
RUNS = f"runs AS (SELECT event_id AS id, event_type AS topic, user_id % 4 AS model, value AS latency, ts, {_SQL_M} FROM events)"


def _runs(t):
    m = {n: F.when(F.col("event_id") % p == 3, F.lit(None)).otherwise(F.bround((F.col("event_id") * a % p) / float(p - 1), 4)) for n, (a, p) in _M.items()}
    return t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("model"), F.col("value").alias("latency"), "ts", *(c.alias(n) for n, c in m.items()))


def _avg(*names):
    return ", ".join(f"coalesce(round_even(avg({n}), 4), 0.0) AS {n}" for n in names)


@C.add(f"WITH {RUNS} SELECT CASE WHEN grouping(topic) = 1 THEN 'OVERALL' ELSE topic END AS topic, count(*) AS n, {_avg('kw', 'f1', 'cov', 'cit')} FROM runs GROUP BY ROLLUP (topic)")
def report_overall_topic(t, spark):
    return R.rollup(_runs(t), "topic", ["kw", "f1", "cov", "cit"])


@C.add(f"WITH {RUNS} SELECT model, count(*) AS n, {_avg('kw', 'f1', 'bert')}, bool_or(judge IS NOT NULL) AS judged FROM runs GROUP BY model")
def model_comparison(t, spark):
    return _runs(t).groupBy("model").agg(F.count(F.lit(1)).alias("n"), *map(R.mean, ["kw", "f1", "bert"]), F.bool_or(F.col("judge").isNotNull()).alias("judged"))


@C.add(f"WITH {RUNS} SELECT topic, " + ", ".join(f"coalesce(round_even(avg(kw) FILTER (model = {i}), 4), 0.0) AS m{i}" for i in range(4)) + " FROM runs GROUP BY topic")
def topic_config_pivot(t, spark):
    p = _runs(t).groupBy("topic").pivot("model", [0, 1, 2, 3]).agg(F.bround(F.avg("kw"), 4)).fillna(0.0)
    return p.toDF("topic", "m0", "m1", "m2", "m3")


@C.add(f"WITH {RUNS} SELECT model, round_even(quantile_cont(latency, 0.25), 6) AS q1, round_even(quantile_cont(latency, 0.5), 6) AS median, round_even(quantile_cont(latency, 0.75), 6) AS q3 FROM runs GROUP BY model")
def latency_quartiles(t, spark):
    q = R.exact_quantiles(_runs(t), "model", "latency", [0.25, 0.5, 0.75]).groupBy("model").pivot("share", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
    return q.toDF("model", "q1", "median", "q3").select("model", *[F.bround(n, 6).alias(n) for n in ("q1", "median", "q3")])


@C.add(f"WITH {RUNS}, a AS (SELECT model, avg(kw) AS kw, avg(latency) AS latency FROM runs GROUP BY model), b AS (SELECT * FROM a WHERE model = 0) SELECT a.model, round_even((a.kw - b.kw) / b.kw * 100, 4) AS kw_change, round_even(-((a.latency - b.latency) / b.latency * 100), 4) AS latency_gain FROM a, b WHERE a.model <> 0")
def delta_vs_baseline(t, spark):
    a = _runs(t).groupBy("model").agg(F.avg("kw").alias("kw"), F.avg("latency").alias("latency"))
    b = a.where("model = 0").select(F.col("kw").alias("bk"), F.col("latency").alias("bl"))
    d = a.where("model <> 0").join(F.broadcast(b))
    return d.select("model", F.bround(R.relative_change(F.col("kw"), F.col("bk")), 4).alias("kw_change"), F.bround(R.relative_change(F.col("latency"), F.col("bl"), True), 4).alias("latency_gain"))


THRESHOLDS = [round(0.40 + 0.05 * i, 2) for i in range(10)]
_SWEEP = f"""WITH {RUNS}, j AS (SELECT r.judge, l.quality = 1 AS q, coalesce(r.bert, 0) >= 0.75 OR coalesce(r.f1, 0) >= 0.25 AS ref FROM runs r JOIN labels l ON r.id = l.doc_id WHERE r.judge IS NOT NULL),
s AS (SELECT threshold, round_even(avg(CASE WHEN judge >= threshold THEN 1.0 ELSE 0.0 END), 4) AS pass_rate, round_even(avg(CASE WHEN (judge >= threshold) = q THEN 1.0 ELSE 0.0 END), 4) AS agreement, round_even(avg(CASE WHEN (judge >= threshold) = ref THEN 1.0 ELSE 0.0 END), 4) AS reference_agreement
FROM j, (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold) GROUP BY threshold)"""


def _sweep(t):
    j = _runs(t).join(t("labels"), F.col("id") == F.col("doc_id"))
    reference = (R.z("bert") >= 0.75) | (R.z("f1") >= 0.25)
    return R.threshold_sweep(j, "judge", F.col("quality") == 1, reference, THRESHOLDS)


@C.add(_SWEEP + " SELECT * FROM s")
def threshold_sweep(t, spark):
    return _sweep(t)


@C.add(_SWEEP + " SELECT threshold, agreement FROM s ORDER BY agreement DESC, reference_agreement DESC, threshold LIMIT 1")
def recommended_threshold(t, spark):
    return _sweep(t).orderBy(F.col("agreement").desc(), F.col("reference_agreement").desc(), "threshold").limit(1).select("threshold", "agreement")


@C.add(f"WITH {RUNS} SELECT topic, round_even(coalesce(corr(bert, f1), 0), 6) AS pearson, round_even(avg(bert - f1), 6) AS gap FROM runs WHERE bert IS NOT NULL AND f1 IS NOT NULL GROUP BY topic")
def pearson_gap(t, spark):
    d = _runs(t).dropna(subset=["bert", "f1"])
    return d.groupBy("topic").agg(F.bround(R.pearson("bert", "f1"), 6).alias("pearson"), F.bround(F.avg(F.col("bert") - F.col("f1")), 6).alias("gap"))


@C.add(f"WITH {RUNS} SELECT id, round_even(bert - f1, 6) AS gap FROM runs WHERE bert IS NOT NULL AND f1 IS NOT NULL ORDER BY round_even(bert - f1, 6) DESC, id LIMIT 10")
def top_gap(t, spark):
    return _runs(t).dropna(subset=["bert", "f1"]).select("id", F.bround(F.col("bert") - F.col("f1"), 6).alias("gap")).orderBy(F.col("gap").desc(), "id").limit(10)


_CLASS = """CASE WHEN f1 IS NULL THEN 'no_word_f1' WHEN f1 < 0.25 AND coalesce(bert >= 0.75, false) AND (coalesce(judge >= 0.6, false) OR label = 'acceptable') THEN 'metric_penalty' WHEN f1 < 0.25 AND coalesce(bert >= 0.75, false) THEN 'retrieval_ok_gen_bad'
WHEN f1 < 0.25 AND (coalesce(judge >= 0.6, false) OR label = 'acceptable') THEN 'bert_word_disagree' WHEN f1 < 0.25 THEN 'true_failure' ELSE 'ok' END"""


@C.add(f"WITH {RUNS}, c AS (SELECT {_CLASS} AS class FROM (SELECT *, CASE WHEN judge >= 0.9 THEN 'acceptable' ELSE 'incorrect' END AS label FROM runs)) SELECT class, count(*) AS n, round_even(100 * count(*) / sum(count(*)) OVER (), 1) AS share FROM c GROUP BY class")
def disagreement_classes(t, spark):
    d = _runs(t).withColumn("label", F.when(F.col("judge") >= 0.9, "acceptable").otherwise("incorrect"))
    return R.shares(d.select(R.disagreement("f1", "bert", "judge", "label").alias("class")), "class")


_THREE = """a AS (SELECT user_id AS id, avg(kw) AS raw FROM rr WHERE topic = 'view' GROUP BY user_id), b AS (SELECT user_id AS id, avg(kw) AS rer FROM rr WHERE topic = 'click' GROUP BY user_id),
c AS (SELECT user_id AS id, avg(kw) AS kw, avg(f1) AS f1, avg(cov) AS cov, avg(cit) AS cit FROM rr WHERE topic = 'purchase' GROUP BY user_id), j AS (SELECT * FROM a JOIN b USING (id) JOIN c USING (id))"""
_RR = f"WITH {RUNS}, rr AS (SELECT r.*, e.user_id FROM runs r JOIN events e ON e.event_id = r.id), {_THREE}"


def _three(t):
    r = _runs(t).join(t("events").select(F.col("event_id").alias("id"), "user_id"), "id")
    # Means of decimals, added exactly: sums of doubles depend on the order of rows, and a mean that is a threshold fell on either side of it.
    mean = lambda c: (F.sum(F.col(c).cast("decimal(18,4)")).cast("double") / F.count(c))
    one = lambda topic, **m: r.where(F.col("topic") == topic).groupBy("user_id").agg(*[mean(c).alias(n) for n, c in m.items()])
    j = one("view", raw="kw").join(one("click", rer="kw"), "user_id").join(one("purchase", kw="kw", f1="f1", cov="cov", cit="cit"), "user_id")
    return j.withColumnRenamed("user_id", "id")


@C.add(_RR + ", k AS (SELECT CASE WHEN coalesce(raw, 0) < 0.6 THEN 'retrieval_miss' WHEN coalesce(rer, 0) + 0.2 < coalesce(raw, 0) OR coalesce(rer, 0) < 0.6 THEN 'rank_miss' ELSE 'gen_bad' END AS taxonomy FROM j) SELECT taxonomy, count(*) AS n, round_even(100 * count(*) / sum(count(*)) OVER (), 1) AS share FROM k GROUP BY taxonomy")
def error_taxonomy(t, spark):
    return R.shares(_three(t).select(R.taxonomy("raw", "rer").alias("taxonomy")), "taxonomy")


@C.add(_RR + """, s AS (SELECT id, coalesce(kw, 0) < 0.6 OR coalesce(f1, 0) < 0.25 OR coalesce(cov, 0) < 0.55 OR coalesce(cit, 0) < 1 AS is_error, round_even(2 * greatest(0, 0.6 - coalesce(kw, 0)) + 3 * greatest(0, 0.25 - coalesce(f1, 0)) + greatest(0, 0.55 - coalesce(cov, 0)) + greatest(0, 1 - coalesce(cit, 0)), 9) AS severity FROM j),
o AS (SELECT *, row_number() OVER (ORDER BY is_error DESC, severity DESC, id DESC) AS position FROM s) SELECT position, id, round_even(severity, 6) AS severity FROM o WHERE position <= least(50, greatest(30, (SELECT count(*) FROM s WHERE is_error)))""")
def severity_topn_backfill(t, spark):
    w = R.worst(_three(t), "id", R.is_error("kw", "f1", "cov", "cit"), R.severity("kw", "f1", "cov", "cit"))
    return w.select("position", "id", F.bround("severity", 6).alias("severity"))


def _near(c, th, span):
    return f"coalesce(greatest(0.0, 1.0 - least(abs({c} - {th}) / {span}, 1.0)), 0.0)"


@C.add(f"""WITH {RUNS}, s AS (SELECT id, round_even(0.45 * CASE WHEN bert - f1 IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, bert - f1)) END + 0.20 * {_near('f1', 0.25, 0.15)} + 0.20 * {_near('cov', 0.8, 0.2)} + 0.10 * {_near('cit', 0.95, 0.1)} + 0.05 * {_near('judge', 0.5, 0.25)}, 4) AS ambiguity FROM runs)
SELECT row_number() OVER (ORDER BY ambiguity DESC, id DESC) AS rank, id, ambiguity FROM s ORDER BY ambiguity DESC, id DESC LIMIT 30""")
def ambiguity_topn(t, spark):
    a = _runs(t).select("id", R.ambiguity("f1", "bert", "cov", "cit", "judge").alias("ambiguity"))
    top = a.orderBy(F.col("ambiguity").desc(), F.col("id").desc()).limit(30)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("ambiguity").desc(), F.col("id").desc())))


@C.add(f"""WITH {RUNS}, s AS (SELECT list_filter([CASE WHEN bert - f1 >= 0.45 THEN 'semantic_metric_disagreement' END, CASE WHEN {_near('f1', 0.25, 0.15)} >= 0.7 THEN 'near_word_f1_threshold' END, CASE WHEN {_near('cov', 0.8, 0.2)} >= 0.7 THEN 'near_context_threshold' END,
CASE WHEN {_near('cit', 0.95, 0.1)} >= 0.7 THEN 'near_citation_threshold' END, CASE WHEN judge BETWEEN 0.35 AND 0.65 THEN 'judge_borderline' END], lambda x: x IS NOT NULL) AS l FROM runs)
SELECT signal, count(*) AS n FROM (SELECT unnest(l) AS signal FROM s) GROUP BY signal""")
def signal_counts(t, spark):
    s = _runs(t).select(F.explode(R.ambiguity_signals("f1", "bert", "cov", "cit", "judge")).alias("signal"))
    return s.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


# Questions and a judge's reasons, built from events.
ASKED = """CASE event_id % 6 WHEN 0 THEN 'Quelle prime de retraite pour ' || user_id || ' ?' WHEN 1 THEN 'La rémunération des fonctionnaires' WHEN 2 THEN 'Temps partiel ' || event_type WHEN 3 THEN 'Une formation et ses cotisations' WHEN 4 THEN 'La DISCRIMINATION' ELSE 'Autre ' || event_id END"""
REASON = """CASE event_id % 5 WHEN 0 THEN 'La réponse omet la condition de délai ' || event_id WHEN 1 THEN 'Elle n''évoque pas et ne mentionne pas le secteur privé' WHEN 2 THEN 'Règle générale ignorée; indemnités' WHEN 3 THEN 'Se concentre sur ' || event_type ELSE 'ok' END"""


def _has(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@C.add(f"SELECT event_id AS id, CASE {' '.join(f'WHEN {_has("lower(q)", w)} THEN {chr(39)}{n}{chr(39)}' for w, n in R.TOPICS)} ELSE 'other' END AS topic FROM (SELECT event_id, {ASKED} AS q FROM events)")
def question_topics(t, spark):
    return t("events").select(F.col("event_id").alias("id"), R.topic_of(F.expr(ASKED)).alias("topic"))


_FLAGS = [*((_has("lower(r)", w), n) for w, n in R.REASONS), (f"{_has('r', ('n’', chr(110) + chr(39)))} AND contains(lower(r), 'ne mentionne')", "missing_mentions"), ("contains(lower(r), 'secteur') AND contains(lower(r), 'priv')", "public_private_confusion")]


@C.add(f"SELECT event_id AS id, array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for c, n in _FLAGS)}], lambda x: x IS NOT NULL)), ',') AS signals FROM (SELECT event_id, {REASON} AS r FROM events)")
def reason_signals(t, spark):
    return t("events").select(F.col("event_id").alias("id"), F.array_join(F.sort_array(R.reason_signals(F.expr(REASON))), ",").alias("signals"))


@C.add(f"WITH {RUNS}, w AS (SELECT id FROM runs ORDER BY coalesce(f1, 999), id LIMIT 40) SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT id FROM w)")
def bottom_n_semijoin(t, spark):
    w = _runs(t).orderBy(F.col("f1").asc_nulls_last(), "id").limit(40)
    return t("documents").join(F.broadcast(w.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi").select("doc_id", "source")


@C.add(f"WITH {RUNS}, k AS (SELECT model AS k, avg(kw) AS kw FROM runs GROUP BY model) SELECT k, round_even(kw, 6) AS kw, round_even(kw - lag(kw) OVER (ORDER BY k), 6) AS step FROM k")
def k_decay_lag(t, spark):
    k = _runs(t).groupBy(F.col("model").alias("k")).agg(F.avg("kw").alias("kw"))
    return k.select("k", F.bround("kw", 6).alias("kw"), F.bround(F.col("kw") - F.lag("kw").over(Window.orderBy("k")), 6).alias("step"))


@C.add(f"WITH {RUNS}, g AS (SELECT topic, id % 500 AS k, avg(kw) AS kw, avg(cov) AS cov FROM runs GROUP BY 1, 2) SELECT topic, k FROM g WHERE kw >= 0.55 AND cov >= 0.60")
def kpi_gate(t, spark):
    """Configurations that reach the published targets."""
    return R.reaching(_runs(t).groupBy("topic", (F.col("id") % 500).alias("k")).agg(F.avg("kw").alias("kw"), F.avg("cov").alias("cov"))).select("topic", "k")


_HALVES = "h AS (SELECT topic || '/' || model AS name, avg(latency) FILTER (ts < TIMESTAMP '2024-01-16') AS old, avg(latency) FILTER (ts >= TIMESTAMP '2024-01-16') AS new FROM runs GROUP BY 1)"


def _halves(t):
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    name = F.concat_ws("/", "topic", F.col("model").cast("string"))
    return _runs(t).groupBy(name.alias("name")).agg(F.avg(F.when(first, F.col("latency"))).alias("old"), F.avg(F.when(~first, F.col("latency"))).alias("new")).where("old is not null and new is not null")


@C.add(f"WITH {RUNS}, {_HALVES} SELECT name, round_even((new - old) / nullif(old, 0) * 100, 4) AS change FROM h WHERE old IS NOT NULL AND new IS NOT NULL")
def benchmark_diff(t, spark):
    return _halves(t).select("name", F.bround(R.relative_change(F.col("new"), F.col("old")), 4).alias("change"))


@C.add(f"WITH {RUNS}, {_HALVES}, c AS (SELECT (new - old) / nullif(old, 0) * 100 AS d FROM h WHERE old IS NOT NULL AND new IS NOT NULL) SELECT count(*) FILTER (d > 5) AS regressions, count(*) FILTER (d < -5) AS improvements, count(*) FILTER (d BETWEEN -5 AND 5) AS flat FROM c")
def benchmark_counts(t, spark):
    d = _halves(t).select(R.relative_change(F.col("new"), F.col("old")).alias("d"))
    return d.agg(F.count_if(F.col("d") > 5).alias("regressions"), F.count_if(F.col("d") < -5).alias("improvements"), F.count_if(F.col("d").between(-5, 5)).alias("flat"))


@C.add(f"WITH {RUNS} SELECT l.doc_id, round_even(coalesce(nullif(l.quality::DOUBLE, 0), r.judge), 4) AS merged FROM labels l LEFT JOIN runs r ON r.id = l.doc_id")
def falsy_coalesce_merge(t, spark):
    d = t("labels").join(_runs(t), F.col("doc_id") == F.col("id"), "left")
    return d.select("doc_id", F.bround(R.falsy(F.col("quality").cast("double"), F.col("judge")), 4).alias("merged"))


@C.add(f"WITH {RUNS} SELECT topic, max_by(id, (round_even(coalesce(CASE WHEN f1 IS NULL THEN kw ELSE 0.5 * kw + 0.5 * f1 END, 0), 6), -id)) AS best FROM runs GROUP BY topic")
def best_row(t, spark):
    score = F.coalesce(F.bround(R.composite(F.col("kw"), F.col("f1")), 6), F.lit(0.0))
    return _runs(t).groupBy("topic").agg(F.max_by("id", F.struct(score, -F.col("id"))).alias("best"))


@C.add(f"WITH {RUNS} SELECT least(floor(f1 * 5), 4)::BIGINT AS bucket, count(*) AS n FROM runs WHERE f1 IS NOT NULL GROUP BY 1")
def f1_histogram(t, spark):
    d = _runs(t).where("f1 is not null")
    return d.groupBy(F.least(F.floor(F.col("f1") * 5), F.lit(4)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@C.add(f"""WITH {RUNS}, v AS (SELECT id // 3 AS q, id % 3 AS version, coalesce(kw, 0) AS s FROM runs), d AS (SELECT q, max(s) - min(s) AS delta, max_by(version, (s, -version)) AS best FROM v GROUP BY q)
SELECT best, count(*) AS n, count(*) FILTER (delta >= 0.05) AS sensitive FROM d GROUP BY best""")
def prompt_ablation(t, spark):
    v = _runs(t).select(F.floor(F.col("id") / 3).alias("q"), (F.col("id") % 3).alias("version"), R.z("kw").alias("s"))
    d = v.groupBy("q").agg((F.max("s") - F.min("s")).alias("delta"), F.max_by("version", F.struct("s", -F.col("version"))).alias("best"))
    return d.groupBy("best").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("delta") >= 0.05).alias("sensitive"))


@C.add("SELECT doc_id, l.quality, sum(CASE WHEN e.value > 50 THEN 1 ELSE 0 END)::BIGINT AS top5, count(e.event_id) AS top20 FROM labels l LEFT JOIN events e ON e.user_id = l.doc_id GROUP BY doc_id, l.quality")
def annotation_packet(t, spark):
    j = t("labels").join(t("events"), F.col("user_id") == F.col("doc_id"), "left")
    return j.groupBy("doc_id", "quality").agg(F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("top5"), F.count("event_id").alias("top20"))


@C.add(f"""WITH {RUNS}, g AS (SELECT model, round_even(avg(kw), 6) AS kw, round_even(avg(f1), 6) AS f1, round_even(avg(cov), 6) AS cov, round_even(avg(latency), 6) AS latency FROM runs GROUP BY model)
SELECT 'kw' AS metric, max_by(model, (kw, -model)) AS model FROM g UNION ALL SELECT 'f1', max_by(model, (f1, -model)) FROM g UNION ALL SELECT 'cov', max_by(model, (cov, -model)) FROM g UNION ALL SELECT 'latency', min_by(model, (latency, model)) FROM g""")
def best_by_metric(t, spark):
    g = _runs(t).groupBy("model").agg(*[F.bround(F.avg(c), 6).alias(c) for c in ("kw", "f1", "cov", "latency")])
    return R.best_by(g, "model", ["kw", "f1", "cov"], ["latency"])


@C.add("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 6")
def most_common_hosts(t, spark):
    return R.most_common(t("pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")), "host")


@C.add("SELECT role, round_even(avg(length(text)), 4) AS mean_length, count(*) AS n FROM conversations GROUP BY role")
def answer_lengths(t, spark):
    return t("conversations").groupBy("role").agg(F.bround(F.avg(F.length("text")), 4).alias("mean_length"), F.count(F.lit(1)).alias("n"))


@C.add(f"WITH {RUNS} SELECT id FROM runs WHERE topic = 'view' AND kw IS NOT NULL INTERSECT SELECT id FROM runs WHERE f1 IS NOT NULL INTERSECT SELECT id FROM runs WHERE cov IS NOT NULL")
def aligned_ids(t, spark):
    r = _runs(t)
    return r.where("topic = 'view' and kw is not null").select("id").intersect(r.where("f1 is not null").select("id")).intersect(r.where("cov is not null").select("id"))


@C.add("SELECT doc_id, concat_ws(' · ', lang, 'n° ' || doc_id, 'chunk ' || source) AS card FROM documents")
def source_cards(t, spark):
    m = F.create_map(F.lit("document_nature"), F.col("lang"), F.lit("document_number"), F.col("doc_id").cast("string"), F.lit("jurisdiction"), F.lit(""))
    return t("documents").select("doc_id", R.label(m, F.col("source")).alias("card"))


_K = "CASE model WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 8 ELSE 10 END"


@C.add(f"""WITH {RUNS}, g AS (SELECT {_K} AS k, {_avg('kw', 'f1', 'cov')}, round_even(avg(latency), 4) AS latency FROM runs GROUP BY 1)
SELECT k, kw, f1, cov, latency, row_number() OVER (ORDER BY kw DESC, k) = 1 AS best_kw, row_number() OVER (ORDER BY f1 DESC, k) = 1 AS best_f1, row_number() OVER (ORDER BY cov DESC, k) = 1 AS best_cov,
row_number() OVER (ORDER BY latency, k) = 1 AS best_latency, kw >= 0.55 AND cov >= 0.60 AS meets_targets, round_even((kw - lag(kw) OVER (ORDER BY k)) / (k - lag(k) OVER (ORDER BY k)), 6) AS gain_per_k,
round_even((latency - lag(latency) OVER (ORDER BY k)) / (k - lag(k) OVER (ORDER BY k)), 6) AS latency_per_k, row_number() OVER (ORDER BY kw DESC, k) = 1 AS recommended FROM g""")
def k_report(t, spark):
    """A sweep over k, the runs of each model standing for one k."""
    return evaluate.k_report(_runs(t).withColumn("k", F.expr(_K)))


@C.add(f"""WITH {RUNS}, m AS (SELECT unnest(['kw', 'f1', 'cov', 'latency']) AS metric, unnest([kw, f1, cov, latency]) AS v, id % 2 = 1 AS r FROM runs WHERE model = 2),
a AS (SELECT metric, round_even(avg(v) FILTER (NOT r), 4) AS base, round_even(avg(v) FILTER (r), 4) AS reranked FROM m GROUP BY metric) SELECT *, round_even(reranked - base, 4) AS delta FROM a""")
def rerank_deltas(t, spark):
    """Runs at k = 8 with odd ids stand for those with a reranker."""
    return evaluate.rerank_deltas(_runs(t).where("model = 2").withColumn("r", F.col("id") % 2 == 1), "r")
