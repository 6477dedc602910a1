"""Citation graph: extraction of references, node and edge tables, neighbours and graph-expanded ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.files import exists, materialise

# How laws and ordinances are named in texts, and which words tie an article or an amendment to them.
LAW = r"loi\s+n[o°.]\s*\d[\d.\-]*"
ORDINANCE = r"ordonnance\s+(?:souveraine\s+)?n[o°.]\s*\d[\d.\-]*"
LAW_REFERENCES = [r"\bloi\s+n[o°.]?\s*\d[\d.\-]*", r"\bordonnance\s+(?:souveraine\s+)?n[o°.]?\s*\d[\d.\-]*", r"\bcode\s+du\s+travail\b", r"\bcode\s+de\s+commerce\b"]
ARTICLE_NUMBER = r"(\d+(?:-\d+)?(?:er|bis|ter)?)"
ARTICLE_CITED = rf"(?:l['’\s]|les\s+)?articles?\s+{ARTICLE_NUMBER}(?:[^,\n]{{0,30}})?\s+(?:de\s+la\s+|du\s+|de\s+l['’]\s*)({LAW}|{ORDINANCE}|code\s+du\s+travail)"
ARTICLE_SEE = rf"voir\s+l['’]\s*article\s+{ARTICLE_NUMBER}\s+de\s+(?:la\s+|l['’]\s*)?({LAW}|{ORDINANCE})"
AMENDS = (
    r"(?:portant\s+(?:modification|abrogation)\s+(?:de\s+(?:la\s+|l['’]\s*)?|du\s+)?|modifiant\s+(?:la\s+|l['’]\s*)?|"
    rf"compl[eé]tant\s+et\s+modifiant\s+(?:(?:en\s+ce\s+qui\s+concerne\s+)?(?:la\s+|l['’]\s*)?)?)({LAW}|{ORDINANCE})"
)
LEADING_NUMBER = r"^(?:loi|ordonnance(?:\s+souveraine)?|arr[eê]t[eé]\s+minist[eé]riel|circulaire|d[eé]cret)\s+n[o°.]\s*(\d[\d.\-]*)"
NAMED_CODES = ("code du travail", "code de commerce")
CHANGES = (
    r"(?:modifiant|portant\s+modification\s+(?:de\s+(?:la\s+)?)?|abrogeant|portant\s+abrogation\s+de\s+)"
    rf"(?:certaines\s+dispositions\s+de\s+la\s+|la\s+|l['’]\s*|du\s+)?({LAW}|{ORDINANCE})"
)
# Boost of every relation; cited-by counts like citing.
BOOSTS = {"cites": 0.12, "cited_by": 0.12, "cites_article": 0.15, "amends": 0.10, "sees_article": 0.08}


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?iu){pattern}"), group)


def _norm(c: Column) -> Column:
    return F.transform(c, lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))


def law_references(text: Column) -> Column:
    """Distinct law references, in the order of the patterns, lower case, blanks collapsed."""
    return F.array_distinct(_norm(F.concat(*[_all(text, p) for p in LAW_REFERENCES])))


def _pairs(text: Column, pattern: str) -> Column:
    laws = _norm(_all(text, pattern, 2))
    return F.zip_with(F.transform(_all(text, pattern, 1), lambda x: F.trim(F.lower(x))), laws, lambda a, b: F.struct(a.alias("article"), b.alias("law")))


def article_citations(text: Column) -> Column:
    """Distinct (article, law) pairs of citations and of see-also marks."""
    return F.array_distinct(F.concat(_pairs(text, ARTICLE_CITED), _pairs(text, ARTICLE_SEE)))


def article_see_also(text: Column) -> Column:
    return F.array_distinct(_pairs(text, ARTICLE_SEE))


def amended_laws(title: Column) -> Column:
    return _norm(_all(title, AMENDS, 1))


def changed_laws(title: Column) -> Column:
    """Laws that a title says to be modified or repealed, in the wider wording."""
    return _norm(_all(title, CHANGES, 1))


def law_number(title: Column, strip_trailing_punct: bool = False) -> Column:
    """The number that a title leads with; final dots stay unless asked otherwise."""
    n = F.regexp_extract(F.trim(title), f"(?iu){LEADING_NUMBER}", 1)
    return F.regexp_replace(n, r"[.\-]+$", "") if strip_trailing_punct else n


def numbers(reference: Column) -> Column:
    """Digit runs of two characters or more."""
    return _all(reference, r"\d[\d.\-]+")


def _parts(title: Column, sizes: Column) -> Column:
    """Parts of the given sizes, from a digit on, of the runs of digits, dots and dashes: as many as a title has characters, for each size."""
    runs = _all(title, r"[\d.\-]{2,}")
    of_size = lambda r, n: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, n))
    fits = lambda r: F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(r)), lambda n: of_size(r, n)))
    return F.filter(F.array_distinct(F.flatten(F.transform(runs, fits))), lambda x: x.rlike(r"^\d"))


def article_id(doc: Column, article: Column) -> Column:
    return F.concat(doc, F.lit("__art_"), F.lower(article))


def themes(meta: Column) -> Column:
    """Distinct themes of three metadata fields that hold a text or a JSON list of texts."""
    def one(name: str) -> Column:
        raw = F.trim(F.element_at(meta, name))
        parsed = F.from_json(raw, "array<string>")
        return F.when(raw.startswith("["), F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(F.array(raw))

    return F.array_distinct(F.filter(F.transform(F.concat(*[F.coalesce(one(n), F.array().cast("array<string>")) for n in ("thematic", "themes", "domaine")]), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def documents(chunks: DataFrame) -> DataFrame:
    """One node per document from its first chunk, with all its text in order."""
    first = F.min_by(F.struct("titre", "type", "date", "source", "metadata"), "chunk_index")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x.text), " ")
    d = chunks.where(F.col("doc_id") != "").groupBy("doc_id").agg(first.alias("d"), body.alias("body"))
    return d.select("doc_id", "d.*", "body").withColumn("law_number", law_number(F.col("titre")))


#: Column of the number of edges that a row stands for.
EDGES = "edges"
#: Decisions of a class that are held in one row, and pairs of one cell of the join that lists them, about.
BLOCK, CELL = 8_192, 1 << 25


def _cite_classes(decisions: DataFrame, laws: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(src, keys) of the decisions; their classes (class, keys, n): decisions with the same keys cite the same laws; and (class, dst), distinct.

    A number that a title contains is a part of one of the title's runs of digits, dots and dashes, so titles are exploded to these parts, of the
    sizes that numbers have, and to the code names they have, and references meet them by equality. Sizes are one row, however many references.
    A class and a law that share several keys meet by the first of them only, so pairs are distinct as they are made.
    """
    codes = lambda c: F.filter(F.array(*map(F.lit, NAMED_CODES)), lambda x: c.contains(x))
    of_refs = F.flatten(F.transform(law_references(F.col("body")), lambda r: F.concat(codes(r), numbers(r))))
    # Rows without keys are left out as the table is read: a filter on what is written would find all references twice.
    every = materialise(decisions.select(F.col("doc_id").alias("src"), F.array_sort(F.array_distinct(of_refs)).alias("keys")), "graph-keys").where(F.size("keys") > 0)
    classes = every.groupBy("keys").agg(F.count(F.lit(1)).alias("n"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("class"), "keys", "n"), "graph-classes")
    keys = classes.select("class", "keys", F.posexplode("keys").alias("at", "key")).select("class", "key", F.slice("keys", F.lit(1), F.col("at")).alias("earlier"))
    sizes = keys.where(~F.col("key").isin(*NAMED_CODES)).agg(F.collect_set(F.length("key")).alias("__sizes"))
    laws = laws.crossJoin(F.broadcast(sizes))
    title = F.lower("titre")
    held = laws.select(F.col("doc_id").alias("dst"), F.array_distinct(F.concat(codes(title), _parts(title, F.col("__sizes")))).alias("has"))
    held = held.select("dst", "has", F.explode("has").alias("key"))
    met = F.when(F.size("earlier") == 0, F.lit(False)).when(F.size("earlier") == 1, F.array_contains("has", F.get("earlier", F.lit(0)))).otherwise(F.arrays_overlap("has", "earlier"))
    return every, classes, keys.join(held, "key").where(~met).select("class", "dst")


def cite_edges(decisions: DataFrame, laws: DataFrame) -> DataFrame:
    """(src, dst): decisions to the laws that a reference in their text names, by code name or by a number in the title.

    Laws meet classes of decisions, and blocks of a class's decisions are unfolded beside each of its laws: pairs are never shuffled, nor are they
    tested one by one. Large classes are dealt out by decisions and by laws, so that no task has all pairs of one.
    """
    every, classes, met = _cite_classes(decisions, laws)
    met = materialise(met, "graph-met")
    blocks, held = F.ceil(F.col("n") / BLOCK), F.least(F.col("n"), F.lit(BLOCK))
    cells = classes.join(met.groupBy("class").agg(F.count(F.lit(1)).alias("laws")), "class")
    cells = cells.select("class", "keys", blocks.alias("blocks"), F.ceil(F.col("laws") * held / CELL).alias("deals"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    own = every.join(cells, "keys").select("class", "deals", dealt("src", "blocks").alias("b"), "src")
    own = own.groupBy("class", "deals", "b").agg(F.collect_list("src").alias("all")).select("class", "b", upto("deals").alias("d"), "all")
    asked = met.join(cells.drop("keys"), "class").select("class", upto("blocks").alias("b"), dealt("dst", "deals").alias("d"), "dst")
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many tasks as that, however few bytes the classes have
    cell = ("class", "b", "d")
    return asked.repartition(parts, *cell).join(own.repartition(parts, *cell), list(cell)).select(F.explode("all").alias("src"), "dst")


def cite_sizes(decisions: DataFrame, laws: DataFrame) -> DataFrame:
    """(dst, edges): for each class of decisions and law that it cites the number of edges between them; their sum is that of `cite_edges`, no pair is listed."""
    _, classes, met = _cite_classes(decisions, laws)
    return met.join(classes.select("class", F.col("n").alias(EDGES)), "class").select("dst", EDGES)


def article_nodes(docs: DataFrame) -> DataFrame:
    """(article_id, doc_id, article): articles that see-also marks (of the law named, else of the document itself) and citations name."""
    laws = docs.where("law_number <> ''").select("law_number", F.col("doc_id").alias("target"))
    see = docs.select("doc_id", F.explode(article_see_also(F.col("body"))).alias("p"))
    see = see.select("doc_id", "p.article", F.explode_outer(numbers(F.col("p.law"))).alias("n")).join(laws, F.col("n") == F.col("law_number"), "left")
    see = see.select(F.coalesce("target", "doc_id").alias("doc_id"), "article")
    cited = docs.select(F.explode(article_citations(F.col("body"))).alias("p")).select("p.article", F.explode(numbers(F.col("p.law"))).alias("n"))
    cited = cited.join(laws, F.col("n") == F.col("law_number")).select(F.col("target").alias("doc_id"), "article")
    return see.union(cited).distinct().select(article_id(F.col("doc_id"), F.col("article")).alias("article_id"), "doc_id", "article")


def article_edges(docs: DataFrame, pairs, articles: DataFrame, laws: DataFrame, to_self: bool) -> DataFrame:
    """(src, article_id) for references whose article exists; to_self: whether a document's own articles count."""
    refs = docs.select(F.col("doc_id").alias("src"), F.explode(pairs(F.col("body"))).alias("p")).select("src", "p.article", F.explode(numbers(F.col("p.law"))).alias("n"))
    e = refs.join(laws.where("law_number <> ''").select("law_number", F.col("doc_id").alias("target")), F.col("n") == F.col("law_number"))
    e = e if to_self else e.where("src <> target")
    e = e.select("src", article_id(F.col("target"), F.col("article")).alias("article_id")).distinct()
    return e.join(articles.select("article_id"), "article_id", "left_semi").select("src", "article_id")


def amend_edges(laws: DataFrame) -> DataFrame:
    """(src, dst): laws whose title says that they amend another."""
    refs = laws.select(F.col("doc_id").alias("src"), F.explode(amended_laws(F.col("titre"))).alias("r")).select("src", F.explode(numbers(F.col("r"))).alias("n"))
    e = refs.join(laws.where("law_number <> ''").select("law_number", F.col("doc_id").alias("dst")), F.col("n") == F.col("law_number"))
    return e.where("src <> dst").select("src", "dst").distinct()


def theme_edges(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(themes(F.col("metadata"))).alias("theme")).distinct()


def build(chunks: DataFrame, laws: str = "legislation", cases: str = "jurisprudence", pairs: bool = True) -> dict[str, DataFrame]:
    """All node and edge tables of the graph from chunks (chunk_id, doc_id, chunk_index, titre, type, ...), documents written once.

    Citations are pairs, or without `pairs` what `cite_sizes` gives, which is all that their number needs.
    """
    docs = materialise(documents(chunks), "graph-documents")
    law, case = docs.where(F.col("type") == laws), docs.where(F.col("type") == cases)
    articles = materialise(article_nodes(docs), "graph-articles")
    about = theme_edges(docs)
    parts = chunks.where(F.col("doc_id") != "")
    return {
        "documents": docs, "chunks": parts.select("chunk_id", "chunk_index", "text"), "extract_of": parts.select(F.col("chunk_id").alias("src"), F.col("doc_id").alias("dst")),
        "articles": articles, "article_of": articles.select(F.col("article_id").alias("mid"), F.col("doc_id").alias("dst")), "themes": about.select("theme").distinct(), "about": about,
        "cites": (cite_edges if pairs else cite_sizes)(case, law), "amends": amend_edges(law),
        "cites_article": article_edges(case, article_citations, articles, law, True).select("src", F.col("article_id").alias("mid")),
        "sees_article": article_edges(law, article_see_also, articles, law, False).select("src", F.col("article_id").alias("mid")),
    }


def store(tables: dict[str, DataFrame], path: str, reset: bool = True) -> None:
    """The graph's tables under one folder; a rerun replaces them, or with reset=False leaves those that are complete."""
    for name, table in tables.items():
        if reset or not exists(table.sparkSession, f"{path}/{name}/_SUCCESS"):
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def counts(**tables: DataFrame) -> DataFrame:
    """(label, n) of every node and edge table; a row of a table with the column `edges` stands for so many."""
    size = lambda t: F.coalesce(F.sum(EDGES), F.lit(0)) if EDGES in t.columns else F.count(F.lit(1))
    parts = [t.agg(size(t).alias("n")).select(F.lit(name).alias("label"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def as_it_is(df: DataFrame) -> DataFrame:
    return df


def out_neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(q, doc): one hop along edges (src, dst); each pair once, however many seeds lead to it."""
    return seeds.select("q", F.col("doc").alias("src")).join(edges, "src").select("q", F.col("dst").alias("doc")).distinct()


def in_neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return out_neighbours(seeds, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def undirected_neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return out_neighbours(seeds, edges.select("src", "dst").union(edges.select("dst", "src")))


def two_hop_neighbours(seeds: DataFrame, first: DataFrame, second: DataFrame, found: Callable[[DataFrame], DataFrame] = as_it_is) -> DataFrame:
    """first (src, mid), second (mid, dst); `found` may store what the first hop finds and say how it is joined."""
    mid = found(seeds.select("q", F.col("doc").alias("src")).join(first, "src").select("q", "mid").distinct())
    return mid.join(second, "mid").select("q", F.col("dst").alias("doc")).distinct()


def boosts(seeds: DataFrame, relations: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """(q, doc, boost): one addition per relation type that leads to a document which is no seed itself."""
    w = BOOSTS if weights is None else weights
    parts = [r.select("q", "doc", F.lit(w[name]).alias("boost")) for name, r in relations.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("q", "doc").agg(F.sum("boost").alias("boost")).join(seeds.select("q", "doc").distinct(), ["q", "doc"], "left_anti")


def expand(seeds: DataFrame, boosted: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Seed chunks (q, doc, chunk_id, score) and all chunks (chunk_id, doc) of boosted documents at 0.5 + boost, best k of every query.

    Equal scores: seeds first, then by document and chunk.
    """
    near = boosted.join(chunks, "doc").select("q", "doc", "chunk_id", F.bround(0.5 + F.col("boost"), 6).alias("score"), F.bround("boost", 6).alias("graph_boost"))
    near = near.join(seeds.select("q", "chunk_id"), ["q", "chunk_id"], "left_anti").select("q", "doc", "chunk_id", "score", "graph_boost", F.lit(0).alias("is_seed"))
    pool = seeds.select("q", "doc", "chunk_id", "score", F.lit(0.0).alias("graph_boost"), F.lit(1).alias("is_seed")).unionByName(near)
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("is_seed").desc(), "doc", "chunk_id")
    return pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# How numbered acts are named in the gazette (case matters), and how an article's own header looks.
GAZETTE = {
    "loi": r"Loi\s+n°\s+(\d+[\d\-./]*)", "ordonnance": r"Ordonnance\s+Souveraine\s+n°\s+(\d+[\d\-./]*)",
    "arrete": r"Arrêté\s+Ministériel\s+n°\s+(\d+[\d\-./]*)", "projet": r"Projet\s+de\s+loi\s+n°\s+(\d+[\d\-./]*)",
}
ARTICLE_HEADER = r"(?im)(?:^|\n)\s*Art(?:icle)?\.?\s+(\d+(?:-\d+)?(?:er|bis|ter)?)\s*[-–—.]"


def gazette_references(text: Column) -> Column:
    """(kind, number) of every numbered act that a gazette text names."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), 1), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("number")))

    return F.array_distinct(F.concat(*[found(k, p) for k, p in GAZETTE.items()]))


def article_headers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ARTICLE_HEADER), 1)
