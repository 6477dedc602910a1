"""Queries of evaluation metrics: answers are assistants' turns, references the questions before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import metrics, prompt
from siltstone.plans import plugins
from siltstone.plans.base import Catalog

C = Catalog()
TOK = "regexp_extract_all(lower({0}), '[a-zàâäéèêëîïôöùûüç]+')"
_PAIRS = """m AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id * 1000 + turn AS id, text AS question, answer FROM m WHERE role = 'user' AND r = 'assistant')"""


def _pairs(t):
    return prompt.pairs(t("conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question", "answer")


@C.add(f"""WITH {_PAIRS}, a AS (SELECT id, tok, count(*) AS c FROM (SELECT id, unnest({TOK.format('answer')}) AS tok FROM p) GROUP BY ALL), b AS (SELECT id, tok, count(*) AS c FROM (SELECT id, unnest({TOK.format('question')}) AS tok FROM p) GROUP BY ALL),
c AS (SELECT id, sum(least(a.c, b.c))::BIGINT AS n FROM a JOIN b USING (id, tok) GROUP BY id), l AS (SELECT id, len({TOK.format('answer')}) AS np, len({TOK.format('question')}) AS nr FROM p)
SELECT id, round_even(coalesce(2 * (n / np) * (n / nr) / (n / np + n / nr), 0.0), 6) AS word_f1 FROM l LEFT JOIN c USING (id)""")
def word_f1(t, spark):
    return metrics.word_f1(_pairs(t), "id", "answer", "question").select("id", F.bround("word_f1", 6).alias("word_f1"))


@C.add(f"""WITH {_PAIRS}, t AS (SELECT id, list_filter({TOK.format('answer')}, lambda x: length(x) > 3) AS w, list_distinct({TOK.format('question')}) AS c FROM p),
s AS (SELECT id, CASE WHEN len(w) = 0 THEN 1.0 ELSE round_even(len(list_filter(w, lambda x: list_contains(c, x))) / len(w), 4) END AS coverage FROM t)
SELECT id, coverage, round_even(1 - coverage, 4) AS hallucination_risk FROM s""")
def context_coverage(t, spark):
    c = metrics.context_coverage(_pairs(t), "id", "answer", "question").withColumnRenamed("context_coverage", "coverage")
    return c.withColumn("hallucination_risk", metrics.hallucination_risk(F.col("coverage")))


@C.add(f"""WITH {_PAIRS}, o AS (SELECT id, {TOK.format('question')} AS kw, {TOK.format('answer')} AS pt FROM p),
f AS (SELECT id, list_transform(kw, lambda x: strip_accents(x)) AS kw, list_transform(pt, lambda x: strip_accents(x)) AS pt FROM o)
SELECT id, round_even(CASE WHEN len(kw) = 0 THEN 1.0 ELSE len(list_filter(kw, lambda k: len(list_filter(pt, lambda q: q = k OR (least(length(q), length(k)) >= 5 AND (starts_with(q, k) OR starts_with(k, q))))) > 0)) / len(kw) END, 6) AS recall FROM f""")
def keyword_recall_unstemmed(t, spark):
    """Every word of a question, repeats counted, is a keyword."""
    p = _pairs(t)
    words = metrics.canonical_rows(p.select("id", F.posexplode(T.metric_tokens(F.col("question"))).alias("keyword", "t")), False)
    return metrics.keyword_recalls(p.select("id"), "id", words, metrics.token_rows(p, "id", "answer", False)).select("id", F.bround("recall", 6).alias("recall"))


@C.add()
def keyword_recall_fr(t, spark):
    """Stemmed recall of every question's words in its answer. Stems have no SQL; a test holds the metric against expected rows."""
    p = _pairs(t)
    words = metrics.token_rows(p, "id", "question").withColumn("keyword", F.col("t"))
    return metrics.keyword_recalls(p.select("id"), "id", words, metrics.token_rows(p, "id", "answer")).select("id", F.bround("recall", 6).alias("recall"))


_SIGNED = "{{'s': ('0x' || substr(md5({0}), 1, 8))::BIGINT % 64, 'v': substr(md5({0}), 9, 1) < '8'}}"
_BEST = "CASE WHEN list_contains({b}, {a}) THEN 1.0 WHEN len(list_filter({b}, lambda y: y.s <> ({a}).s)) > 0 THEN 0.0 ELSE -1.0 END"


@C.add(f"""WITH {_PAIRS}, t AS (SELECT id, {TOK.format('answer')} AS p, {TOK.format('question')} AS r FROM p),
df AS (SELECT t, count(*) AS df FROM (SELECT id, unnest(list_distinct(r)) AS t FROM t) GROUP BY t), w AS (SELECT t, ln(((SELECT count(*) FROM t) + 1) / (df + 1)) AS w FROM df), mo AS (SELECT coalesce(max(w), 1.0) AS most FROM w),
v AS (SELECT id, list_distinct(list_transform(p, lambda x: {_SIGNED.format('x')})) AS pv, list_distinct(list_transform(r, lambda x: {_SIGNED.format('x')})) AS rv FROM t),
pe AS (SELECT id, sum({_BEST.format(a=_SIGNED.format('e.t'), b='rv')} * coalesce(w, most)) / nullif(sum(coalesce(w, most)), 0) AS s FROM (SELECT id, unnest(p) AS t FROM t) e JOIN v USING (id) LEFT JOIN w ON w.t = e.t, mo GROUP BY id),
re AS (SELECT id, sum({_BEST.format(a=_SIGNED.format('e.t'), b='pv')} * coalesce(w, most)) / nullif(sum(coalesce(w, most)), 0) AS s FROM (SELECT id, unnest(r) AS t FROM t) e JOIN v USING (id) LEFT JOIN w ON w.t = e.t, mo GROUP BY id),
b AS (SELECT id, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0 ELSE coalesce(pe.s, 0.0) END AS precision, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0 ELSE coalesce(re.s, 0.0) END AS recall FROM t LEFT JOIN pe USING (id) LEFT JOIN re USING (id))
SELECT id, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1 FROM b""")
def token_similarity(t, spark):
    """Answers against questions token by token, with weights of the questions' tokens and vectors of the hashing embedder."""
    p = _pairs(t)
    weights = metrics.token_weights(p, "question", T.metric_tokens)
    s = metrics.token_similarity(p, "id", "answer", "question", plugins.HashingEmbedder().token_vectors, weights)
    return s.select("id", *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# Answers with marks of sources, built from every turn.
CITED = "text || ' [Source ' || (turn + 1) || '] et [Source ' || (conv_id % 9) || ']' || CASE conv_id % 3 WHEN 0 THEN '[Source  2]' WHEN 1 THEN '' ELSE ' [source 1]' END"


@C.add(f"""SELECT conv_id, turn, CASE WHEN len(c) = 0 THEN 0.0 ELSE round_even(len(list_filter(c, lambda x: x::INT BETWEEN 1 AND 5)) / len(c), 4) END AS faithfulness
FROM (SELECT conv_id, turn, regexp_extract_all(CASE WHEN turn % 4 = 3 THEN '' ELSE {CITED} END, '\\[Source\\s+(\\d+)\\]', 1) AS c FROM conversations)""")
def citation_faithfulness(t, spark):
    answer = F.expr(f"CASE WHEN turn % 4 = 3 THEN '' ELSE {CITED} END")
    return t("conversations").select("conv_id", "turn", metrics.citation_faithfulness(answer, F.lit(5)).alias("faithfulness"))


# Replies of a judge in all forms, built from events.
REPLY = """CASE event_id % 6 WHEN 0 THEN '```json' || chr(10) || '{"score": ' || (event_id % 100 / 80.0) || ', "verdict": "Acceptable", "reason": " ' || event_type || ' "}' || chr(10) || '```' WHEN 1 THEN 'Voici: {"score": 1.7, "verdict": "wrong", "reason": ""} merci'
WHEN 2 THEN 'pas de json ' || event_id WHEN 3 THEN '{"score": "x", "verdict": "ok"}' WHEN 4 THEN '{"score": 0.2, "verdict": "peut-être ' || user_id || '"}' ELSE '{"score": 0.5, "verdict": ' END"""
_VERDICT = "lower(trim(json_extract_string(v, '$.verdict')))"


@C.add(f"""WITH r AS (SELECT event_id AS id, {REPLY.replace("(event_id % 100 / 80.0)", "(event_id % 100 / 80.0)::DECIMAL(10, 6)")} AS r FROM events), b AS (SELECT id, CASE WHEN starts_with(r, '{{') THEN r ELSE regexp_extract(r, '(?s)\\{{.*\\}}') END AS b FROM r), v AS (SELECT id, b, CASE WHEN json_valid(b) THEN b END AS v FROM b),
s AS (SELECT id, b, v, CASE WHEN TRY_CAST(json_extract_string(v, '$.score') AS DOUBLE) IS NOT NULL THEN round_even(least(greatest(TRY_CAST(json_extract_string(v, '$.score') AS DOUBLE), 0.0), 1.0), 4) END AS score, CASE WHEN {_VERDICT} IN ('acceptable', 'accept', 'correct', 'ok') THEN 'acceptable' WHEN {_VERDICT} IN ('incorrect', 'wrong', 'reject', 'bad') THEN 'incorrect' END AS label, nullif(trim(json_extract_string(v, '$.reason')), '') AS reason FROM v)
SELECT id, score, label, reason, CASE WHEN b = '' THEN 'Judge returned non-JSON output' WHEN v IS NULL THEN 'Judge JSON parse error' WHEN score IS NULL OR label IS NULL THEN 'Judge JSON missing valid score/verdict' END AS error FROM s""")
def judge_parse(t, spark):
    reply = F.expr(REPLY.replace("(event_id % 100 / 80.0)", "cast(event_id % 100 / 80.0 as decimal(10, 6))"))
    return t("events").select(F.col("event_id").alias("id"), T.judge_reply(reply).alias("j")).select("id", "j.*")
