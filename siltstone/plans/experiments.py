"""Queries of sources, records, audits, ablations and evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import corpus, fusion, metrics, prompt, reports
from siltstone.plans import evaluate, plugins, retrieval
from siltstone.plans.base import Catalog
from siltstone.plans.reporting import RUNS, _runs

C = Catalog()
BASE_URL = "https://law.example.org"

# Rows of a legal source, built from documents the same in both dialects.
RAW = {
    "type": "CASE doc_id % 6 WHEN 0 THEN 'legislation' WHEN 1 THEN 'regulation' WHEN 2 THEN 'case' WHEN 3 THEN 'tai' WHEN 4 THEN 'legislativeWork' ELSE 'other' END",
    "path": "CASE WHEN doc_id % 50 = 7 THEN '' ELSE '/' || lang || '/' || doc_id || '@2024.01.0' || (doc_id % 9 + 1) END", "title": "'Acte ' || doc_id", "enBody": "CASE WHEN doc_id % 11 = 3 THEN ' ' ELSE text END",
    "date": "'20' || (10 + doc_id % 15) || '-01-01'", "tncNature": "source", "number": "'' || (doc_id % 700)", "jurisdiction": "CASE doc_id % 4 WHEN 0 THEN 'tribunal-travail' WHEN 1 THEN 'cour-appel' ELSE NULL END",
    "legislationAbrogated": "CASE WHEN doc_id % 5 = 0 THEN '2020-0' || (1 + doc_id % 9) || '-01' END", "regulationAbrogated": "CASE WHEN doc_id % 5 = 1 THEN 'oui' END", "idbd": "'bd' || (doc_id * 7)",
    "parties": "CASE WHEN doc_id % 3 = 1 THEN substr(text, 1, 40) END", "caseAbstract": "substr(text, 5, 80)", "interest": "CASE WHEN doc_id % 7 = 2 THEN 'majeur' END",
}
_RAW_SQL = ", ".join(f"{e} AS {n}" for n, e in RAW.items())
LISTS = {"thematic": ("doc_id % 3 = 0", "'travail', lang", "doc_id % 3 = 1", "lang"), "enTitle": ("doc_id % 4 = 0", "'Art. ' || doc_id, substr(text, 1, 20)", "doc_id % 4 = 1", "'Art. 1'"), "lnks": ("doc_id % 5 = 2", "'/a/' || doc_id", "doc_id % 5 = 3", "'/b', '/c'")}
_THEMES_SQL = ", ".join(f"CASE WHEN {a} THEN [{x}] WHEN {b} THEN [{y}] END AS {n}" for n, (a, x, b, y) in LISTS.items())
_ROWS = f"x AS (SELECT doc_id, {_RAW_SQL}, {_THEMES_SQL} FROM documents)"


def _rows(t):
    lists = [F.expr(f"CASE WHEN {a} THEN array({x}) WHEN {b} THEN array({y}) END").alias(n) for n, (a, x, b, y) in LISTS.items()]
    return t("documents").select("doc_id", *(F.expr(e).alias(n) for n, e in RAW.items()), *lists)


_KIND = "CASE " + " ".join(f"WHEN type = '{k}' THEN '{v[0]}'" for k, v in corpus.RECORDS.items()) + " END"


_KEYS = sorted({k for _, fields in corpus.RECORDS.values() for k in fields})


def _field(key: str) -> str:
    """A metadata key of every type that has it: the text, or the list as JSON, of its raw field."""
    value = lambda raw: f"coalesce(to_json({raw})::VARCHAR, '[]')" if raw in LISTS else f"coalesce({raw}, '')"
    return "CASE type " + " ".join(f"WHEN '{kind}' THEN {value(fields[key])}" for kind, (_, fields) in corpus.RECORDS.items() if key in fields) + f" END AS {key}"


@C.add(f"""WITH {_ROWS}, p AS (SELECT *, string_split(coalesce(path, ''), '@')[1] AS clean FROM x WHERE type <> 'other')
SELECT substr(md5(clean), 1, 12) AS id, title AS titre, md5(coalesce(enBody, '')) AS h, date, CASE WHEN clean <> '' THEN '{BASE_URL}' || clean ELSE '' END AS source, {_KIND} AS type, {', '.join(map(_field, _KEYS))} FROM p""")
def record_builders(t, spark):
    r = corpus.records(_rows(t), BASE_URL)
    return r.select("id", "titre", F.md5("text").alias("h"), "date", "source", "type", *(F.try_element_at("metadata", F.lit(k)).alias(k) for k in _KEYS))


@C.add(f"""WITH {_ROWS} SELECT 'laws' AS collection, doc_id FROM x WHERE type = 'legislation' AND list_has_any(thematic, ['travail', 'fr']) UNION ALL SELECT 'court', doc_id FROM x WHERE type = 'case' AND jurisdiction = 'tribunal-travail'
UNION ALL SELECT 'orders', doc_id FROM x WHERE type = 'regulation' AND list_has_any(thematic, ['travail', 'fr']) AND trim(enBody) <> '' UNION ALL SELECT 'other_courts', doc_id FROM x WHERE type = 'case' AND jurisdiction IN ('cour-appel') AND list_has_any(thematic, ['travail', 'fr']) AND trim(enBody) <> ''
UNION ALL SELECT 'treaties', doc_id FROM x WHERE type = 'tai' AND list_has_any(thematic, ['travail', 'fr']) UNION ALL SELECT 'bills', doc_id FROM x WHERE type = 'legislativeWork' AND list_has_any(thematic, ['travail', 'fr'])""")
def source_collections(t, spark):
    rows, work = _rows(t), ["travail", "fr"]
    parts = {
        "laws": corpus.collected(rows, "legislation", work), "court": corpus.collected(rows, "case", None, ["tribunal-travail"]), "orders": corpus.collected(rows, "regulation", work, None, True),
        "other_courts": corpus.collected(rows, "case", work, ["cour-appel"], True), "treaties": corpus.collected(rows, "tai", work), "bills": corpus.collected(rows, "legislativeWork", work),
    }
    out = None
    for name, p in parts.items():
        p = p.select(F.lit(name).alias("collection"), "doc_id")
        out = p if out is None else out.unionAll(p)
    return out


@C.add(r"""WITH h AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN replace(html, '</article>', ' <time datetime="2021-0' || (1 + page_id % 9) || '-05"></time></article>') WHEN 1 THEN replace(html, '</article>', ' le ' || (10 + page_id % 30) || '/11/2020</article>') ELSE html END AS html FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages)),
b AS (SELECT page_id, url, html, regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g') AS b FROM h),
x AS (SELECT *, regexp_replace(regexp_extract(b, '(?is)<title>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') AS title, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(b, '(?is)<title>.*?</title>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS body FROM b)
SELECT page_id, title, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS category, CASE WHEN stamp <> '' THEN stamp ELSE coalesce(strftime(try_strptime(nullif(regexp_extract(body, '(\d{2}/\d{2}/\d{4})', 1), ''), '%d/%m/%Y'), '%Y-%m-%d'), '') END AS date
FROM (SELECT *, regexp_extract(html, '(?i)<(?:time|meta)[^>]*(?:datetime|content)="(\d{4}-\d{2}-\d{2})', 1) AS stamp FROM x)
WHERE NOT regexp_matches(title, '(?i)\b404\b|page non trouv|not found') AND length(body) >= 50""")
def page_records(t, spark):
    """Pages with a stamp put into a third of them and a written date, sometimes of no such day, into another."""
    n, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    ends = lambda c: F.replace(html, F.lit("</article>"), F.concat(c, F.lit("</article>")))
    stamp = F.concat(F.lit(' <time datetime="2021-0'), (1 + n % 9).cast("string"), F.lit('-05"></time>'))
    written = F.concat(F.lit(" le "), (10 + n % 30).cast("string"), F.lit("/11/2020"))
    p = t("pages").withColumn("html", F.when(n % 3 == 0, ends(stamp)).when(n % 3 == 1, ends(written)).otherwise(html))
    f = corpus.page_record(F.col("html"), F.col("url"))
    p = p.where(corpus.usable_page(f["title"], f["body"]))
    return p.select("page_id", f["title"].alias("title"), f["category"].alias("category"), f["date"].alias("date"))


@C.add("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 1 AND c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 AND c_custkey % 7 <> 0 THEN c_name WHEN c_custkey % 2 = 1 AND c_custkey % 5 <> 0 THEN c_mktsegment END END AS payload FROM customer WHERE c_custkey % 3 = 0 OR (c_custkey % 2 = 1 AND c_custkey % 5 <> 0)")
def payload_preference(t, spark):
    c = t("customer").withColumnRenamed("c_custkey", "id")
    vector = c.where("id % 3 = 0").select("id", F.when(F.col("id") % 7 != 0, F.col("c_name")).alias("payload"))
    return fusion.preferred(vector, c.where("id % 2 = 1 and id % 5 <> 0").select("id", F.col("c_mktsegment").alias("payload")), "id")


@C.add(r"SELECT doc_id, len(a) AS n, len(list_distinct(a)) AS n_distinct FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-zàâäéèêëîïôùûüÿœæ0-9]+'), lambda x: length(x) >= 2) AS a FROM documents)")
def tokenize_light(t, spark):
    return t("documents").select("doc_id", T.light_tokens(F.col("text")).alias("a")).select("doc_id", F.size("a").alias("n"), F.size(F.array_distinct("a")).alias("n_distinct"))


@C.add(f"WITH {RUNS} SELECT model, count(*) AS n, round_even(avg(coalesce(kw, 0)), 4) AS kw, round_even(avg(coalesce(cov, 0)), 4) AS cov FROM runs GROUP BY model")
def run_means_missing_as_zero(t, spark):
    z = lambda c: F.bround(F.avg(reports.z(c)), 4).alias(c)
    return _runs(t).groupBy("model").agg(F.count(F.lit(1)).alias("n"), z("kw"), z("cov"))


@C.add(f"WITH {RUNS} SELECT topic, count(*) AS n FROM runs GROUP BY topic")
def report_without_overall(t, spark):
    return reports.without_overall(reports.rollup(_runs(t), "topic", ["kw"]), "topic").select("topic", "n")


_VERSIONS = "least(1.0, round_even(coalesce(kw, 0.0) * (1 + (id % (v + 2)) * 0.1), 4))"


@C.add(f"""WITH {RUNS}, c AS (SELECT id, kw FROM runs WHERE coalesce(cov, 0) >= 0.8 AND coalesce(f1, 1) < 0.25), s AS (SELECT id, v, {_VERSIONS} AS s FROM c, (SELECT unnest([1, 2, 3]) AS v)),
d AS (SELECT id, round_even(max(s) - min(s), 4) AS delta, max_by(v, (s, -v)) AS best FROM s GROUP BY id), a AS (SELECT count(*) AS n, count(*) FILTER (delta < 0.05) AS p, count(*) FILTER (delta >= 0.05) AS q, round_even(coalesce(avg(delta), 0), 4) AS mean_delta FROM d)
SELECT n, p AS metric_penalty, q AS prompt_sensitive, mean_delta, CASE WHEN p > n * 0.6 THEN 'metric_penalty' WHEN q > n * 0.6 THEN 'prompt_sensitive' ELSE 'mixed' END AS verdict FROM a""")
def prompt_ablation_verdict(t, spark):
    """Candidates (good coverage, poor F1) under every prompt version, and what most of them say."""
    c = _runs(t).where((reports.z("cov") >= 0.8) & (F.coalesce("f1", F.lit(1.0)) < reports.F1_LOW))
    v = c.select("id", "kw", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("v"))
    s = v.withColumn("s", F.least(F.lit(1.0), F.bround(reports.z("kw") * (1 + (F.col("id") % (F.col("v") + 2)) * 0.1), 4)))
    return reports.ablation_verdict(reports.ablation(s, "id", "v", "s"))


_TOP = f"WITH {retrieval.IP}"


@C.add(f"""{_TOP}, h AS (SELECT query_id, rank, (a.label = b.label)::INT::DOUBLE AS hit FROM r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id WHERE rank <= 10),
e AS (SELECT k, query_id, avg(hit) AS s FROM h, (SELECT unnest([3, 5, 8, 10]) AS k) WHERE rank <= k GROUP BY 1, 2), m AS (SELECT k, avg(s) AS recall FROM e GROUP BY k)
SELECT k, round_even(recall, 6) AS recall, round_even((recall - lag(recall) OVER (ORDER BY k)) / (k - lag(k) OVER (ORDER BY k)), 6) AS step FROM m""")
def k_sweep(t, spark):
    e = t("embeddings")
    r = retrieval._search(t, 10, "ip").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    return evaluate.k_sweep(r.withColumn("hit", (F.col("a") == F.col("b")).cast("double")), "query_id", "hit", [3, 5, 8, 10])


@C.add(f"""{_TOP}, q AS (SELECT vec_id AS question_id, 'q' || vec_id AS question FROM embeddings WHERE vec_id % 50 = 0 AND vec_id % 150 <> 0), t AS (SELECT query_id AS question_id, rank, id AS chunk_id FROM r WHERE rank <= 10),
u AS (SELECT question_id, list(chunk_id ORDER BY rank) FILTER (rank % 2 = 1 AND rank <= 7) AS used, string_agg(coalesce(CASE WHEN chunk_id % 4 <> 0 THEN 'text ' || chunk_id END, ''), '|' ORDER BY rank) FILTER (rank % 2 = 1 AND rank <= 7) AS texts, count(*) AS n_top FROM t GROUP BY 1)
SELECT question_id, question, len(used) AS n_used, texts, n_top FROM q JOIN u USING (question_id)""")
def audit_packet(t, spark):
    """The five-way join: audits meet questions by text, results and ranked lists by id, and texts by chunk."""
    top = retrieval._search(t, 10, "ip").select(F.col("query_id").alias("question_id"), "rank", F.col("id").alias("chunk_id"))
    e = t("embeddings")
    questions = e.where("vec_id % 50 = 0 and vec_id % 150 <> 0").select(F.col("vec_id").alias("question_id"), F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("question"))
    logged = top.groupBy(F.col("question_id").alias("event_id")).agg(F.collect_list(F.struct("chunk_id", "rank", ((F.col("rank") % 2 == 1) & (F.col("rank") <= 7)).alias("used"))).alias("chunks"))
    audit = logged.withColumn("question", F.concat(F.lit("q"), F.col("event_id").cast("string")))
    chunks = e.where("vec_id % 4 <> 0").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"))
    packet = reports.audit_packet(questions, audit, chunks, questions.select("question_id", F.lit("a").alias("answer")), top)
    return packet.select("question_id", "question", F.size("used_chunks").cast("long").alias("n_used"), F.array_join(F.transform("used_chunks", lambda x: x.text), "|").alias("texts"), F.size("top_chunks").cast("long").alias("n_top"))


_PAIR = """m AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text AS question, CASE WHEN turn % 8 = 4 THEN '[Source 1]' ELSE answer || ' [Source 2]' END AS answer, CASE WHEN conv_id % 5 = 1 THEN ' ' ELSE question END AS reference FROM (SELECT conv_id, turn, text, text AS question, answer FROM m WHERE role = 'user' AND r = 'assistant'))"""


@C.add(rf"""WITH {_PAIR}, c AS (SELECT *, trim(substr(regexp_replace(regexp_replace(regexp_replace(answer, '\[Source\s+(\d+)\]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 1800)) AS a FROM p),
e AS (SELECT *, CASE WHEN trim(question) = '' THEN 'missing_question' WHEN a = '' THEN 'missing_answer' WHEN trim(reference) = '' THEN 'missing_reference_answer' WHEN conv_id % 7 = 2 THEN 'missing_retrieved_contexts' END AS error, list_filter([trim(substr(regexp_replace(regexp_replace(question, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 900)), 'x'], lambda x: x <> '') AS used FROM c),
k AS (SELECT *, list_distinct(regexp_extract_all(lower(a), '[a-zàâäéèêëîïôöùûüç]+')) AS aw, regexp_extract_all(lower(array_to_string(used, ' ')), '[a-zàâäéèêëîïôöùûüç]+') AS ct, regexp_extract_all(lower(reference), '[a-zàâäéèêëîïôöùûüç]+') AS rt FROM e)
SELECT conv_id, turn, length(a) AS n_chars, error, CASE WHEN error IS NULL THEN round_even(CASE WHEN len(aw) = 0 THEN 0.0 ELSE len(list_filter(aw, lambda x: list_contains(ct, x))) / len(aw) END, 4) END AS faithfulness,
CASE WHEN error IS NULL THEN round_even(len(list_filter(used, lambda x: list_has_any(regexp_extract_all(lower(x), '[a-zàâäéèêëîïôöùûüç]+'), rt))) / len(used), 4) END AS context_precision FROM k""")
def semantic_inputs(t, spark):
    """What a semantic judge reads of every answer, and which inputs are missing."""
    p = prompt.pairs(t("conversations")).withColumns({
        "answer": F.when(F.col("turn") % 8 == 4, F.lit("[Source 1]")).otherwise(F.concat("answer", F.lit(" [Source 2]"))), "reference": F.when(F.col("conv_id") % 5 == 1, F.lit(" ")).otherwise(F.col("question")),
        "contexts": F.when(F.col("conv_id") % 7 == 2, F.array(F.lit(" "))).otherwise(F.array("question", F.lit("x"))),
    })
    s = metrics.semantic_scores(F.col("question"), F.col("answer"), F.col("reference"), F.col("contexts"), plugins.OverlapSemanticJudge())
    return p.select("conv_id", "turn", F.length(metrics.judged_answer(F.col("answer"))).cast("long").alias("n_chars"), s.alias("s")).select("conv_id", "turn", "n_chars", "s.*")


@C.add()
def evaluation_run(t, spark):
    """All benchmark questions through retrieval, prompts, stand-in answers and every metric; its stems and models have no SQL."""
    index, _ = retrieval._index(t, "hybrid")
    q = t("benchmark").select(F.col("item_id").alias("query_id"), "text", F.col("text").alias("reference"), F.slice(T.metric_tokens(F.col("text")), 1, 5).alias("keywords"), (F.col("item_id") % 4).cast("string").alias("topic"))
    from siltstone.plans.retriever import Retriever

    models = evaluate.Models(plugins.ExtractiveGenerator(), plugins.OverlapJudge(), plugins.OverlapSemanticJudge(), plugins.EmbeddingSimilarity(plugins.HashingEmbedder()))
    return evaluate.report(evaluate.run(q, Retriever(index), models, "hybrid", 5))
