"""Corpus preparation: scans with provenance, first-wins dedupe, cleaning, chunking, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T

# The version that records name, and how a page says that it was not found.
METADATA_VERSION = "2026-03-traceability-v1"
NOT_FOUND = r"(?i)\b404\b|page non trouv|not found"
# Canonical metadata keys and the raw keys that they are taken from.
CANONICAL = {
    "document_number": "numero", "document_nature": "nature", "jurisdiction": "juridiction", "case_id": "idbd", "journal_number": "journal_numero", "category": "category",
    "thematics": "thematic", "article_titles": "article_titles", "parties": "parties", "abstract": "abstract", "interest": "interest", "links": "liens",
}


def path_id(path: Column) -> Column:
    """The first 12 hexadecimal digits of the MD5 of a path without its version."""
    return F.substring(F.md5(F.split(path, "@")[0].cast("binary")), 1, 12)


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key in the given order; rows with an empty key all stay.

    The window's limit of one is applied before the shuffle as well, so a hot key costs a row per task.
    """
    w = Window.partitionBy(key).orderBy(*order)
    some = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    kept = some.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return kept.unionByName(df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) == ""))


def non_blank(df: DataFrame, text: str) -> DataFrame:
    return df.where(T.strip(F.coalesce(F.col(text), F.lit(""))) != "")


# The types of source rows, the type of record that each becomes, and its metadata keys with the raw fields they hold.
_ACT = {"nature": "tncNature", "numero": "number", "thematic": "thematic", "article_titles": "enTitle", "liens": "lnks"}
RECORDS = {
    "legislation": ("legislation", _ACT | {"abrogee": "legislationAbrogated"}),
    "regulation": ("regulation", _ACT | {"abrogee": "regulationAbrogated"}),
    "case": ("jurisprudence", {"juridiction": "jurisdiction", "numero": "number", "idbd": "idbd", "parties": "parties", "thematic": "thematic", "abstract": "caseAbstract", "interest": "interest", "liens": "lnks"}),
    "tai": ("traite_international", _ACT),
    "legislativeWork": ("projet_loi", _ACT),
}
LISTS = ("thematic", "enTitle", "lnks")


def records(rows: DataFrame, base_url: str) -> DataFrame:
    """Source rows (type, path, title, enBody, date and any raw fields) of the known types -> corpus records.

    Absent and null fields become empty texts or lists; lists are JSON texts in the metadata. Rows of other types are left out.
    """
    have = set(rows.columns)

    def raw(name: str) -> Column:
        empty = "[]" if name in LISTS else ""
        if name not in have:
            return F.lit(empty)
        return F.coalesce(F.to_json(name) if name in LISTS else F.col(name).cast("string"), F.lit(empty))

    path = F.split(raw("path"), "@")[0]
    kind, meta = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    for source, (name, fields) in RECORDS.items():
        own = F.create_map(*[x for key, field in fields.items() for x in (F.lit(key), raw(field))])
        kind, meta = F.when(F.col("type") == source, F.lit(name)).otherwise(kind), F.when(F.col("type") == source, own).otherwise(meta)
    out = rows.select(
        path_id(raw("path")).alias("id"), raw("title").alias("titre"), raw("enBody").alias("text"), raw("date").alias("date"),
        F.when(path != "", F.concat(F.lit(base_url), path)).otherwise("").alias("source"), kind.alias("type"), meta.alias("metadata"),
    )
    return out.where("type is not null")


def collected(rows: DataFrame, kind: str, thematics: list[str] | None = None, jurisdictions: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """Source rows of a collection: of one type, with one of the themes, of one of the courts; with_text leaves out empty bodies."""
    out = rows.where(F.col("type") == kind)
    if thematics is not None:
        out = out.where(F.arrays_overlap("thematic", F.array(*map(F.lit, thematics))))
    if jurisdictions is not None:
        out = out.where(F.col("jurisdiction").isin(jurisdictions))
    return non_blank(out, "enBody") if with_text else out


def page_record(html: Column, url: Column) -> dict[str, Column]:
    """title, lang, body, date (of a time element, a meta element or a written date) and category (the first part of the path)."""
    f = html_fields(html)
    stamp = F.regexp_extract(html, r'(?i)<(?:time|meta)[^>]*(?:datetime|content)="(\d{4}-\d{2}-\d{2})', 1)
    written = F.regexp_extract(f["body"], r"(\d{2}/\d{2}/\d{4})", 1)
    date = F.when(stamp != "", stamp).otherwise(F.date_format(F.try_to_timestamp(F.nullif(written, F.lit("")), F.lit("dd/MM/yyyy")), "yyyy-MM-dd"))
    return f | {"date": F.coalesce(date, F.lit("")), "category": F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+)", 1)}


def usable_page(title: Column, body: Column, least: int = 50) -> Column:
    """Neither a page that says it was not found nor one with under `least` characters of text."""
    return ~title.rlike(NOT_FOUND) & (F.length(body) >= least)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk of every document that has one: chunk_id, chunk_index, total_chunks and the chunk as text."""
    packed = docs.withColumn("__c", T.pack_chunks(T.paragraphs(T.clean(F.col(text)))))
    # an inner explode would have Catalyst test the size of the chunks first, that is compute them twice
    out = packed.select("*", F.posexplode_outer("__c").alias("chunk_index", "__t")).where(F.col("chunk_index").isNotNull()).withColumn("total_chunks", F.size("__c"))
    return out.withColumn(text, F.col("__t")).withColumn("chunk_id", F.concat_ws("-", F.col(key).cast("string"), F.col("chunk_index").cast("string"))).drop("__c", "__t")


def write_chunks(docs: DataFrame, path: str, same: str, *order: str, key: str = "doc_id", text: str = "text") -> dict[str, int]:
    """Write the chunks of the first documents of each `same` to path; documents, duplicates, skipped ones (without a chunk) and chunks come from that one pass."""
    read, kept, made = Observation("read"), Observation("kept"), Observation("made")
    first = first_wins(docs.observe(read, F.count(F.lit(1)).alias("n")), same, *order).observe(kept, F.count(F.lit(1)).alias("n"))
    done = chunks(first, key, text).observe(made, F.count(F.lit(1)).alias("n"), F.count_if(F.col("chunk_index") == 0).alias("chunked"))
    done.write.mode("overwrite").parquet(path)
    return {"documents": read.get["n"], "duplicates": read.get["n"] - kept.get["n"], "skipped": kept.get["n"] - made.get["chunked"], "chunks": made.get["n"]}


def normalised_metadata(raw: Column, source: Column) -> Column:
    """Canonical keys over the raw ones; empty values never override."""
    names = F.array(*map(F.lit, CANONICAL), F.lit("source_url"), F.lit("metadata_schema_version"))
    values = F.array(*[F.element_at(raw, k) for k in CANONICAL.values()], source, F.lit(METADATA_VERSION))
    canonical = F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull() & (v != "") & (v != "[]") & (v != "{}"))
    kept = F.map_filter(raw, lambda k, v: ~F.map_contains_key(canonical, k))
    return F.map_concat(kept, canonical)


def ingestion(source_file: Column, processed_at: str) -> Column:
    return F.struct(
        F.lit(processed_at).alias("processed_at_utc"), F.lit("siltstone.operators.corpus").alias("pipeline"), source_file.alias("source_file"), F.lit(T.CHUNK_SIZE).alias("chunk_size"),
        F.lit(T.CHUNK_OVERLAP).alias("chunk_overlap"), F.lit(T.HARD_MAX).alias("hard_max_chunk"), F.lit(METADATA_VERSION).alias("metadata_schema_version"),
    )


def process(raw: DataFrame, processed_at: str) -> DataFrame:
    """Raw documents (with file_ord, line and source_file) to chunk records, the whole ingest in one plan."""
    docs = first_wins(raw, "id", "file_ord", "line")
    meta = normalised_metadata(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.coalesce("source", F.lit("")))
    docs = docs.withColumn("metadata", meta).withColumn("ingestion", ingestion(F.col("source_file"), processed_at)).withColumnRenamed("id", "doc_id")
    out = chunks(docs)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("titre", "text", "date", "source", "type")]
    return out.select("chunk_id", "doc_id", "chunk_index", "total_chunks", *text, "metadata", "ingestion")


# How lines of page furniture start, and what marks the start of content.
BOILERPLATE = (
    r"(?i)^(Aller au contenu|Aller.+navigation|Aller.+recherche|Accueil$|Journaux$|Categories$|Editos$|Guide|A propos|Nous contacter|Mentions|Plan du site|Sites li|"
    r"Voir le site|MENU$|Francais$|Anglais$|icon-|logo-|image-|svg$|path|fill|Tous droits|Version 20|Visualiser le journal|Telecharger le journal|Imprimer l|"
    r"Retour au sommaire|Article suivant|Article pr|Recevoir le sommaire|Je m'abonne|Acheter le Journal|En savoir plus|Veuillez compl|Mon adresse|Publications$)"
)
CONTENT_START = r"(?i)(ALBERT|Vu la loi|Vu l'|Article\s+\d|Art\.\s+\d|Nous ordonnons|Arretons|loi n|ordonnance n)"


def content_lines(body: Column) -> Column:
    """Lines from the first content line on, without furniture and lines under three characters."""
    lines = F.filter(F.transform(F.split(body, r"\r\n|\r|\n"), T.strip), lambda x: (F.length(x) >= 3) & ~x.rlike(BOILERPLATE))
    start = F.array_position(F.transform(lines, lambda x: x.rlike(CONTENT_START)), True).cast("int")
    return F.when(start > 0, F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(F.size(lines), F.lit(1))), "\n")).otherwise(F.lit(""))


def html_fields(html: Column) -> dict[str, Column]:
    """title, language and visible text of a page, by patterns; scripts, styles and comments are dropped first."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(bare, r"(?is)<title>.*?</title>", " "), "<[^>]*>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return {
        "title": T.strip(F.regexp_extract(bare, r"(?is)<title>(.*?)</title>", 1)),
        "lang": F.regexp_extract(bare, r'(?i)<html[^>]* lang="([^"]*)"', 1),
        "body": T.strip(F.regexp_replace(text, r"\s+", " ")),
    }


def article_url(url: Column, least: int = 4) -> Column:
    """Whether a link has at least `least` non-empty parts between slashes."""
    return F.size(F.filter(F.split(url, "/"), lambda x: x != "")) >= least
