"""Queries of the citation graph: extraction from texts of orders and parts, graph tables, neighbours and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import graph
from siltstone.plans.base import Catalog

C = Catalog()

# Texts of acts and decisions, built from keys the same in both dialects: orders are decisions, parts are laws.
LAW_TEXT = """CASE o_orderkey % 8 WHEN 0 THEN 'Vu la loi n° ' || (o_orderkey % 900 + 10) || ' du 16 mars 1963, et la loi n° 1.' || (o_orderkey % 97 + 10) || '; l''article ' || (o_orderkey % 60) || ' de la loi n° ' || (o_orderkey % 900 + 10) || ' dispose.'
WHEN 1 THEN 'L''ordonnance souveraine n° 3.' || (o_orderkey % 500 + 100) || '. Voir l''article ' || (o_orderkey % 30) || '-2 de la loi n° ' || (o_orderkey % 900 + 10)
WHEN 2 THEN 'le Code du  travail et la Loi  N° ' || o_orderkey || '.' WHEN 3 THEN 'les articles ' || (o_orderkey % 9) || '-1bis du code du travail; loi n° 5'
WHEN 4 THEN 'VOIR L’ARTICLE ' || (o_orderkey % 12) || 'ter de l''ordonnance n° 16.' || (o_orderkey % 800 + 100) || ' ; article 9 de l''ordonnance souveraine n° 3.' || (o_orderkey % 500 + 100)
WHEN 5 THEN 'code de commerce, Code de Commerce' WHEN 6 THEN 'aucune' ELSE '' END"""
TITLE = """CASE p_partkey % 6 WHEN 0 THEN 'Loi n° 1.' || p_partkey || ' du 12 juillet 2002 modifiant la loi n° 1.' || (p_partkey % 50 + 10) WHEN 1 THEN 'Ordonnance souveraine n° 3.' || p_partkey || ' du 8 mai'
WHEN 2 THEN 'Arrêté ministériel n° 2020-' || p_partkey || ' portant modification de l''ordonnance n° 16.' || p_partkey || '.' WHEN 3 THEN 'Jugement' WHEN 4 THEN 'Décret n° ' || p_partkey || '. divers'
ELSE 'Loi n° ' || (p_partkey + 7) || ' portant abrogation de la loi n° ' || p_partkey END"""
LAW_TITLE = """CASE WHEN p_partkey = 7 THEN 'Code du travail' ELSE 'Loi n° ' || (1000 + p_partkey) || ' du 16 mars 1963' || CASE WHEN p_partkey % 3 = 0 THEN ' modifiant la loi n° ' || (1000 + p_partkey % 40) ELSE '' END END"""
SEE_TEXT = "'Voir l''article ' || (p_partkey % 20) || ' de la loi n° ' || (1000 + p_partkey % 300)"
CASE_TEXT = """'Attendu que l''article ' || (o_orderkey % 20) || ' de la loi n° ' || (1000 + o_orderkey % 300) || ' et la loi n° ' || (1000 + o_orderkey % 3000)"""
THEME = """CASE p_partkey % 4 WHEN 0 THEN '["' || p_brand || '","' || p_type || '"]' WHEN 1 THEN p_brand WHEN 2 THEN ' ' ELSE NULL END"""
LAWS, CASES = "legislation", "jurisprudence"


def _sq(pattern: str) -> str:
    return pattern.replace("'", "''")


def _norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


_REFS = "list_concat(" + ", ".join(f"regexp_extract_all({{0}}, '(?i){_sq(p)}')" for p in graph.LAW_REFERENCES[:2]) + ")"
_REFS = f"list_concat({_REFS}, list_concat(" + ", ".join(f"regexp_extract_all({{0}}, '(?i){_sq(p)}')" for p in graph.LAW_REFERENCES[2:]) + "))"


def _pairs_sql(source: str, key: str, text: str, *patterns: str) -> str:
    """Distinct (key, article, law) of the patterns over a table."""
    one = f"SELECT {key}, unnest(regexp_extract_all({text}, '(?i)$P', 1)) AS article, unnest(regexp_extract_all({text}, '(?i)$P', 2)) AS law FROM {source}"
    every = " UNION ALL ".join(one.replace("$P", _sq(p)) for p in patterns)
    return f"SELECT DISTINCT {key}, trim(lower(article)) AS article, {_norm_sql('law')} AS law FROM ({every})"


@C.add(f"SELECT DISTINCT id, {_norm_sql('r')} AS ref FROM (SELECT id, unnest({_REFS.format('text')}) AS r FROM (SELECT o_orderkey AS id, {LAW_TEXT} AS text FROM orders))")
def extract_law_refs(t, spark):
    d = t("orders").select(F.col("o_orderkey").alias("id"), F.expr(LAW_TEXT).alias("text"))
    return d.select("id", F.explode(graph.law_references(F.col("text"))).alias("ref"))


@C.add(_pairs_sql(f"(SELECT o_orderkey AS id, {LAW_TEXT} AS text FROM orders)", "id", "text", graph.ARTICLE_CITED, graph.ARTICLE_SEE))
def extract_article_cites(t, spark):
    d = t("orders").select(F.col("o_orderkey").alias("id"), F.expr(LAW_TEXT).alias("text"))
    return d.select("id", F.explode(graph.article_citations(F.col("text"))).alias("p")).select("id", "p.*")


@C.add(f"""SELECT id, regexp_extract(trim(title), '(?i){_sq(graph.LEADING_NUMBER)}', 1) AS number, {_norm_sql(f"regexp_extract_all(title, '(?i){_sq(graph.AMENDS)}', 1)[1]")} AS amended FROM (SELECT p_partkey AS id, {TITLE} AS title FROM part)""")
def title_numbers(t, spark):
    d = t("part").select(F.col("p_partkey").alias("id"), F.expr(TITLE).alias("title"))
    return d.select("id", graph.law_number(F.col("title")).alias("number"), F.get(graph.amended_laws(F.col("title")), 0).alias("amended"))


@C.add(f"SELECT id, {_norm_sql('r')} AS law FROM (SELECT p_partkey AS id, unnest(regexp_extract_all({TITLE}, '(?i){_sq(graph.CHANGES)}', 1)) AS r FROM part)")
def changed_laws(t, spark):
    return t("part").select(F.col("p_partkey").alias("id"), F.explode(graph.changed_laws(F.expr(TITLE))).alias("law"))


_CHUNKS = f"""c AS (SELECT 'L' || p_partkey AS doc_id, 0 AS i, {LAW_TITLE} AS titre, '{LAWS}' AS type, 'Texte de base.' AS text, {THEME} AS theme FROM part UNION ALL SELECT 'L' || p_partkey, 1, {LAW_TITLE}, '{LAWS}', {SEE_TEXT}, {THEME} FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT 'J' || o_orderkey, 0, 'Arrêt ' || o_orderkey, '{CASES}', {CASE_TEXT}, NULL FROM orders UNION ALL SELECT 'J' || o_orderkey, 1, 'Arrêt ' || o_orderkey, '{CASES}', 'et le code du travail', NULL FROM orders WHERE o_orderkey % 50 = 0),
d AS (SELECT doc_id, min_by(titre, i) AS titre, min_by(type, i) AS type, min_by(theme, i) AS theme, string_agg(text, ' ' ORDER BY i) AS body FROM c GROUP BY doc_id),
n AS (SELECT *, regexp_extract(trim(titre), '(?i){_sq(graph.LEADING_NUMBER)}', 1) AS number FROM d), laws AS (SELECT * FROM n WHERE type = '{LAWS}'), cases AS (SELECT * FROM n WHERE type = '{CASES}')"""


def _chunks(t):
    one = lambda d, key, i, titre, kind, text, theme: d.select(F.expr(key).alias("doc_id"), F.lit(i).alias("chunk_index"), F.expr(titre).alias("titre"), F.lit(kind).alias("type"), F.expr(text).alias("text"), F.expr(theme).alias("theme"))
    part, orders = t("part"), t("orders")
    c = one(part, "'L' || p_partkey", 0, LAW_TITLE, LAWS, "'Texte de base.'", THEME).union(one(part.where("p_partkey % 3 = 1"), "'L' || p_partkey", 1, LAW_TITLE, LAWS, SEE_TEXT, THEME))
    c = c.union(one(orders, "'J' || o_orderkey", 0, "'Arrêt ' || o_orderkey", CASES, CASE_TEXT, "cast(null as string)"))
    c = c.union(one(orders.where("o_orderkey % 50 = 0"), "'J' || o_orderkey", 1, "'Arrêt ' || o_orderkey", CASES, "'et le code du travail'", "cast(null as string)"))
    meta = F.when(F.col("theme").isNotNull(), F.create_map(F.lit("thematic"), F.col("theme"))).otherwise(F.create_map().cast("map<string,string>"))
    return c.select("doc_id", "chunk_index", F.concat_ws("-", "doc_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "titre", "type", "text", F.lit("").alias("date"), F.lit("").alias("source"), meta.alias("metadata"))


def _documents(t):
    return graph.documents(_chunks(t))


_KEYS = rf"""k AS (SELECT DISTINCT doc_id AS src, unnest(list_concat(CASE WHEN contains(ref, 'code du travail') THEN ['code du travail'] ELSE [] END, list_concat(CASE WHEN contains(ref, 'code de commerce') THEN ['code de commerce'] ELSE [] END, regexp_extract_all(ref, '\d[\d.\-]+')))) AS key
FROM (SELECT doc_id, {_norm_sql('r')} AS ref FROM (SELECT doc_id, unnest({_REFS.format('body')}) AS r FROM cases)))"""
_SEE_P = _pairs_sql("n", "doc_id", "body", graph.ARTICLE_SEE)
_ALL_P = _pairs_sql("n", "doc_id", "body", graph.ARTICLE_CITED, graph.ARTICLE_SEE)
_NUMS = r"regexp_extract_all(law, '\d[\d.\-]+')"
_ARTICLES = f"""lw AS (SELECT number AS ln, doc_id AS target FROM n WHERE number <> ''), se AS ({_SEE_P}), ap AS ({_ALL_P}),
sx AS (SELECT doc_id, article, unnest(CASE WHEN len({_NUMS}) = 0 THEN [NULL] ELSE {_NUMS} END) AS num FROM se), cx AS (SELECT doc_id, article, unnest({_NUMS}) AS num FROM ap),
ar AS (SELECT DISTINCT doc_id, article FROM (SELECT coalesce(target, doc_id) AS doc_id, article FROM sx LEFT JOIN lw ON num = ln UNION ALL SELECT target, article FROM cx JOIN lw ON num = ln))"""


@C.add(f"WITH {_CHUNKS}, {_KEYS} SELECT DISTINCT k.src, laws.doc_id AS dst FROM k JOIN laws ON contains(lower(laws.titre), k.key)")
def cite_edges_theta(t, spark):
    d = _documents(t)
    return graph.cite_edges(d.where(F.col("type") == CASES), d.where(F.col("type") == LAWS))


@C.add(f"WITH {_CHUNKS}, {_ARTICLES} SELECT doc_id || '__art_' || lower(article) AS article_id, doc_id, article FROM ar")
def article_nodes(t, spark):
    return graph.article_nodes(_documents(t))


@C.add(f"WITH {_CHUNKS}, {_ARTICLES} SELECT DISTINCT cx.doc_id AS src, target || '__art_' || article AS article_id FROM cx JOIN cases USING (doc_id) JOIN lw ON num = ln JOIN laws ON laws.doc_id = target WHERE (target, article) IN (SELECT (doc_id, article) FROM ar)")
def cite_article_edges(t, spark):
    d = _documents(t)
    return graph.article_edges(d.where(F.col("type") == CASES), graph.article_citations, graph.article_nodes(d), d.where(F.col("type") == LAWS), True)


@C.add(f"WITH {_CHUNKS}, {_ARTICLES} SELECT DISTINCT sx.doc_id AS src, target || '__art_' || article AS article_id FROM sx JOIN laws ON laws.doc_id = sx.doc_id JOIN lw ON num = ln WHERE target <> sx.doc_id AND target IN (SELECT doc_id FROM laws) AND (target, article) IN (SELECT (doc_id, article) FROM ar)")
def voir_edges(t, spark):
    d = _documents(t)
    return graph.article_edges(d.where(F.col("type") == LAWS), graph.article_see_also, graph.article_nodes(d), d.where(F.col("type") == LAWS), False)


_AMENDS = rf"am AS (SELECT DISTINCT src, l.doc_id AS dst FROM (SELECT src, unnest(regexp_extract_all(r, '\d[\d.\-]+')) AS num FROM (SELECT doc_id AS src, {_norm_sql('unnest(x)')} AS r FROM (SELECT doc_id, regexp_extract_all(titre, '(?i){_sq(graph.AMENDS)}', 1) AS x FROM laws))) JOIN laws l ON l.number = num AND num <> '' WHERE src <> l.doc_id)"


@C.add(f"WITH {_CHUNKS}, {_AMENDS} SELECT src, dst FROM am")
def modifie_edges(t, spark):
    return graph.amend_edges(_documents(t).where(F.col("type") == LAWS))


_THEMES = """th AS (SELECT DISTINCT doc_id, trim(x) AS theme FROM (SELECT doc_id, unnest(CASE WHEN starts_with(trim(theme), '[') THEN from_json(theme, '["VARCHAR"]') ELSE [theme] END) AS x FROM n WHERE theme IS NOT NULL) WHERE trim(x) <> '')"""


@C.add(f"WITH {_CHUNKS}, {_THEMES} SELECT doc_id, theme FROM th")
def theme_edges(t, spark):
    return graph.theme_edges(_documents(t))


@C.add(f"""WITH {_CHUNKS}, {_KEYS}, {_ARTICLES}, {_AMENDS}, {_THEMES},
ca AS (SELECT DISTINCT cx.doc_id, target, article FROM cx JOIN cases USING (doc_id) JOIN lw ON num = ln JOIN laws ON laws.doc_id = target WHERE (target, article) IN (SELECT (doc_id, article) FROM ar)),
vo AS (SELECT DISTINCT sx.doc_id, target, article FROM sx JOIN laws ON laws.doc_id = sx.doc_id JOIN lw ON num = ln WHERE target <> sx.doc_id AND target IN (SELECT doc_id FROM laws) AND (target, article) IN (SELECT (doc_id, article) FROM ar))
SELECT 'documents' AS label, (SELECT count(*) FROM d) AS n UNION ALL SELECT 'chunks', (SELECT count(*) FROM c) UNION ALL SELECT 'extract_of', (SELECT count(*) FROM c) UNION ALL SELECT 'articles', (SELECT count(*) FROM ar) UNION ALL SELECT 'article_of', (SELECT count(*) FROM ar)
UNION ALL SELECT 'themes', (SELECT count(DISTINCT theme) FROM th) UNION ALL SELECT 'about', (SELECT count(*) FROM th) UNION ALL SELECT 'cites', (SELECT count(*) FROM (SELECT DISTINCT k.src, laws.doc_id FROM k JOIN laws ON contains(lower(laws.titre), k.key)))
UNION ALL SELECT 'amends', (SELECT count(*) FROM am) UNION ALL SELECT 'cites_article', (SELECT count(*) FROM ca) UNION ALL SELECT 'sees_article', (SELECT count(*) FROM vo)""")
def graph_build(t, spark):
    """All node and edge tables of the graph from chunks, and their sizes."""
    return graph.counts(**graph.build(_chunks(t), LAWS, CASES, pairs=False))


# The star schema as a graph: a seed is an order of a customer; it cites its parts, and so on.
_SEEDS = "seeds AS (SELECT DISTINCT o_custkey AS q, o_orderkey AS doc FROM orders)"
_EDGES = "edges AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"


def _seeds(t):
    return t("orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("doc")).distinct()


def _edges(t):
    return t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@C.add(f"WITH {_SEEDS}, {_EDGES} SELECT DISTINCT q, dst AS doc FROM seeds JOIN edges ON doc = src")
def graph_1hop_out(t, spark):
    return graph.out_neighbours(_seeds(t), _edges(t))


@C.add(f"WITH {_EDGES} SELECT DISTINCT p_size AS q, src AS doc FROM part JOIN edges ON p_partkey = dst")
def graph_1hop_in(t, spark):
    return graph.in_neighbours(t("part").select(F.col("p_size").alias("q"), F.col("p_partkey").alias("doc")), _edges(t))


@C.add("SELECT DISTINCT c_mktsegment AS q, n_regionkey AS doc FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_2hop(t, spark):
    seeds = t("customer").select(F.col("c_mktsegment").alias("q"), F.col("c_custkey").alias("doc"))
    first = t("customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("mid"))
    return graph.two_hop_neighbours(seeds, first, t("nation").select(F.col("n_nationkey").alias("mid"), F.col("n_regionkey").alias("dst")))


@C.add("WITH e AS (SELECT DISTINCT l_suppkey AS src, 1000000 + l_linenumber AS dst FROM lineitem), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT DISTINCT s_nationkey AS q, dst AS doc FROM supplier JOIN u ON s_suppkey = src")
def graph_undirected(t, spark):
    e = t("lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_linenumber") + 1000000).cast("long").alias("dst")).distinct()
    return graph.undirected_neighbours(t("supplier").select(F.col("s_nationkey").alias("q"), F.col("s_suppkey").alias("doc")), e)


_BOOSTED = """seeds AS (SELECT c_nationkey AS q, c_custkey AS doc FROM customer WHERE c_acctbal > 5000),
rel AS (SELECT DISTINCT s.q, o.o_orderkey % 1500 AS doc, 0.12 AS b FROM seeds s JOIN orders o ON o.o_custkey = s.doc UNION ALL SELECT DISTINCT s.q, o.o_custkey, 0.12 FROM seeds s JOIN orders o ON o.o_orderkey % 1500 = s.doc
 UNION ALL SELECT DISTINCT s.q, l.l_partkey % 1500, 0.15 FROM seeds s JOIN orders o ON o.o_custkey = s.doc JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
b AS (SELECT q, doc, sum(b)::DOUBLE AS boost FROM rel r WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.q = r.q AND s.doc = r.doc) GROUP BY q, doc)"""


def _boosted(t):
    seeds = t("customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("doc"))
    cite = t("orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1500).alias("dst")).distinct()
    parts = t("lineitem").select(F.col("l_orderkey").alias("mid"), (F.col("l_partkey") % 1500).alias("dst"))
    relations = {"cites": graph.out_neighbours(seeds, cite), "cited_by": graph.in_neighbours(seeds, cite), "cites_article": graph.two_hop_neighbours(seeds, t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("mid")), parts)}
    return seeds, graph.boosts(seeds, relations)


@C.add(f"WITH {_BOOSTED} SELECT q, doc, round_even(boost, 6) AS boost FROM b")
def graph_boost(t, spark):
    return _boosted(t)[1].select("q", "doc", F.bround("boost", 6).alias("boost"))


@C.add(f"""WITH {_BOOSTED}, chunks AS (SELECT o_orderkey AS chunk_id, o_custkey AS doc FROM orders), sc AS (SELECT s.q, s.doc, c.chunk_id, 0.5 + (c.chunk_id % 97) / 194.0::DOUBLE AS score FROM seeds s JOIN chunks c USING (doc)),
p AS (SELECT q, doc, chunk_id, round_even(score, 6) AS score, 0.0 AS graph_boost, 1 AS is_seed FROM sc UNION ALL SELECT b.q, b.doc, c.chunk_id, round_even(0.5 + boost, 6), round_even(boost, 6), 0 FROM b JOIN chunks c USING (doc) WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.q = b.q AND sc.chunk_id = c.chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, is_seed DESC, doc, chunk_id) AS rank FROM p) SELECT q, rank, doc, chunk_id, score, graph_boost::DOUBLE AS graph_boost FROM r WHERE rank <= 50""")
def graph_pool_topk(t, spark):
    seeds, boosted = _boosted(t)
    chunks = t("orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc"))
    scored = seeds.join(chunks, "doc").withColumn("score", F.bround(0.5 + (F.col("chunk_id") % 97) / 194.0, 6))
    return graph.expand(scored, boosted, chunks, 50).select("q", "rank", "doc", "chunk_id", "score", "graph_boost")


@C.add("SELECT 'doc' AS label, count(*) AS n FROM customer UNION ALL SELECT 'cites', count(*) FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) UNION ALL SELECT 'theme', count(*) FROM nation")
def graph_stats(t, spark):
    return graph.counts(doc=t("customer"), cites=t("orders").select("o_custkey", "o_orderkey").distinct(), theme=t("nation"))


# Gazette texts and article headers, built from keys of orders.
GAZETTE_TEXT = """'Loi n° 1.' || (o_orderkey % 900) || ' et Ordonnance Souveraine n° 16.' || (o_orderkey % 77) || '; loi n° 9' || CASE o_orderkey % 3 WHEN 0 THEN ' Arrêté Ministériel n° 2020-' || (o_orderkey % 999) || ', Projet de loi n° ' || o_orderkey ELSE '' END"""
HEADER_TEXT = "'Art. ' || (o_orderkey % 90) || ' - Objet' || chr(10) || 'Article ' || (o_orderkey % 7) || 'er. Champ' || chr(10) || 'voir Art. 9 - non'"


@C.add(" UNION ALL ".join(f"SELECT DISTINCT id, '{k}' AS kind, unnest(regexp_extract_all(text, '{_sq(p)}', 1)) AS number FROM (SELECT o_orderkey AS id, {GAZETTE_TEXT} AS text FROM orders)" for k, p in graph.GAZETTE.items()))
def gazette_references(t, spark):
    d = t("orders").select(F.col("o_orderkey").alias("id"), F.expr(GAZETTE_TEXT).alias("text"))
    return d.select("id", F.explode(graph.gazette_references(F.col("text"))).alias("r")).select("id", "r.*")


@C.add(f"SELECT o_orderkey AS id, unnest(regexp_extract_all({HEADER_TEXT}, '{_sq(graph.ARTICLE_HEADER)}', 1)) AS article FROM orders")
def article_headers(t, spark):
    return t("orders").select(F.col("o_orderkey").alias("id"), F.explode(graph.article_headers(F.expr(HEADER_TEXT))).alias("article"))
