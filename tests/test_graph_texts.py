"""Extraction and graph tables on texts written by hand, with the expected rows."""

from pyspark.sql import functions as F

from siltstone.operators import graph

TEXTS = [
    (1, "Vu la loi n° 729 du 16 mars 1963, et la loi n° 1.048; l'article 5 de la loi n° 729 dispose."), (2, "L'ordonnance souveraine n° 3.162. Voir l'article 12 de la loi n° 729"), (3, "le Code du  travail et la Loi  N° 729."),
    (4, "les articles 2-1bis du code du travail; loi n° 5"), (5, "aucune"), (6, ""), (7, "VOIR L’ARTICLE 3ter de l'ordonnance n° 16.675 ; article 9 de l'ordonnance souveraine n° 3.162"), (8, "code de commerce, Code de Commerce"),
]
LAWREFS = [(1, "loi n° 729"), (1, "loi n° 1.048"), (2, "ordonnance souveraine n° 3.162."), (2, "loi n° 729"), (3, "loi n° 729."), (3, "code du travail"), (4, "loi n° 5"), (4, "code du travail"), (7, "ordonnance n° 16.675"), (7, "ordonnance souveraine n° 3.162"), (8, "code de commerce")]
CITES = [(1, "5", "loi n° 729"), (2, "12", "loi n° 729"), (4, "2-1bis", "code du travail"), (7, "3ter", "ordonnance n° 16.675"), (7, "9", "ordonnance souveraine n° 3.162")]
TITLES = [
    (1, "Loi n° 1.255 du 12 juillet 2002 modifiant la loi n° 1.048", "1.255", "loi n° 1.048"), (2, "Ordonnance souveraine n° 3.162 du 8 mai", "3.162", None),
    (3, "Arrêté ministériel n° 2020-461 portant modification de l'ordonnance n° 16.675.", "2020-461", "ordonnance n° 16.675."), (4, "Jugement", "", None), (5, "Décret n° 7. divers", "7.", None),
]
CHUNKS = [
    ("L1", 0, "Loi n° 729 du 16 mars 1963", "legislation", "Texte de base.", '["travail","contrat"]'), ("L1", 1, "Loi n° 729 du 16 mars 1963", "legislation", "Voir l'article 7 de la loi n° 1.048", '["travail","contrat"]'),
    ("L2", 0, "Loi n° 1.048 modifiant la loi n° 729", "legislation", "Voir l'article 4 de la loi n° 999 inconnue.", "salaires"), ("L3", 0, "Code du travail", "legislation", "Recueil", None),
    ("J1", 0, "Arrêt A", "jurisprudence", "Attendu que l'article 7 de la loi n° 1.048 et la loi n° 729", "travail"), ("J1", 1, "Arrêt A", "jurisprudence", "et le code du travail", "travail"), ("J2", 0, "Arrêt B", "jurisprudence", "rien", " "),
]
GAZETTE = [(1, "Loi n° 1.048 et Ordonnance Souveraine n° 16.675; loi n° 9"), (2, "Arrêté Ministériel n° 2020-461, Projet de loi n° 973"), (3, "rien")]
NUMBERED = [(1, "loi", "1.048"), (1, "ordonnance", "16.675"), (2, "arrete", "2020-461"), (2, "projet", "973")]
HEADERS = [(1, "Art. 5 - Objet\nArticle 1er. Champ\nvoir Art. 9 - non"), (2, "Article premier")]


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_references(spark):
    d = spark.createDataFrame(TEXTS, "id long, text string")
    assert pairs(d.select("id", F.explode(graph.law_references(F.col("text"))))) == sorted(LAWREFS)
    assert pairs(d.select("id", F.explode(graph.article_citations(F.col("text"))).alias("p")).select("id", "p.*")) == sorted(CITES)


def test_titles(spark):
    d = spark.createDataFrame([r[:2] for r in TITLES], "id long, title string")
    got = d.select("id", "title", graph.law_number(F.col("title")), F.get(graph.amended_laws(F.col("title")), 0)).collect()
    assert sorted(map(tuple, got)) == sorted(TITLES)
    repeal = spark.createDataFrame([("Loi portant modification de la loi n° 729",), ("portant abrogation de la loi n° 1.048.",), ("rien",)], "t string")
    assert [r[0] for r in repeal.select(graph.changed_laws(F.col("t"))).collect()] == [["loi n° 729"], ["loi n° 1.048."], []]


def test_tables(spark, tmp_path):
    c = spark.createDataFrame(CHUNKS, "doc_id string, chunk_index int, titre string, type string, text string, theme string")
    meta = F.when(F.col("theme").isNotNull(), F.create_map(F.lit("thematic"), F.col("theme"))).otherwise(F.create_map().cast("map<string,string>"))
    c = c.select("doc_id", "chunk_index", F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "titre", "type", "text", F.lit("").alias("date"), F.lit("").alias("source"), meta.alias("metadata"))
    t = graph.build(c)
    assert pairs(t["cites"]) == [("J1", "L1"), ("J1", "L2"), ("J1", "L3")]
    assert pairs(t["articles"]) == [("L2__art_4", "L2", "4"), ("L2__art_7", "L2", "7")]
    assert pairs(t["cites_article"]) == [("J1", "L2__art_7")] and pairs(t["sees_article"]) == [("L1", "L2__art_7")] and pairs(t["amends"]) == [("L2", "L1")]
    assert pairs(t["about"]) == [("J1", "travail"), ("L1", "contrat"), ("L1", "travail"), ("L2", "salaires")]
    graph.store(t, f"file://{tmp_path}/graph")
    graph.store(t, f"file://{tmp_path}/graph", reset=False)
    assert {r.label: r.n for r in graph.counts(**{n: spark.read.parquet(f"{tmp_path}/graph/{n}") for n in t}).collect()}["chunks"] == len(CHUNKS)


def test_themes_keep_their_characters(spark):
    d = spark.createDataFrame([({"thematic": '["0a0","1b1"]', "domaine": "20"},)], "m map<string,string>")
    assert d.select(graph.themes(F.col("m"))).first()[0] == ["0a0", "1b1", "20"]


def test_gazette(spark):
    d = spark.createDataFrame(GAZETTE, "id long, text string")
    assert pairs(d.select("id", F.explode(graph.gazette_references(F.col("text"))).alias("r")).select("id", "r.*")) == sorted(NUMBERED)
    h = spark.createDataFrame(HEADERS, "id long, text string")
    assert pairs(h.select("id", F.explode(graph.article_headers(F.col("text"))))) == [(1, "1er"), (1, "5")]
