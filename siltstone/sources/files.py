"""Readers and writers: JSON lines in file order, runs, logs, tables; every one is a DataFrame plan."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import schemas


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the context's own; a temporary one only on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = own.get() if own.isDefined() else None
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: computed once, read by every plan that needs it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int, read: bool = False) -> Iterator[None]:
    """What runs inside hands Python at most so many rows at a time: for rows of texts or arrays, of which the usual ten thousand are too many. `read`: Parquet files are read so, too."""
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", *["spark.sql.parquet.columnarReaderBatchSize"] * read]
    before = {name: spark.conf.get(name) for name in names}
    for name, n in before.items():
        spark.conf.set(name, min([rows, int(n)] if int(n) > 0 else [rows]))
    try:
        yield
    finally:
        for name, n in before.items():
            spark.conf.set(name, n)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def spread(df: DataFrame, most_bytes: int = 64 << 20, part_bytes: int = 256 << 10) -> DataFrame:
    """A table of at most most_bytes is dealt out in parts of about part_bytes, so that heavy row work on one small file runs on many cores.

    A larger table stays as its files are split: what this shuffles is bounded by most_bytes, however wide the cluster.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-size // part_bytes)
    return df.repartition(min(parts, 64)) if 1 < parts and size <= most_bytes else df


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and times of the files under some paths: what was derived from them holds while this stays."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for p in sorted(paths):
        path = fs.Path(p)
        for f in path.getFileSystem(conf).listStatus(path):
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist; the others are left out, as a scan of optional files does."""
    return [p for p in paths if exists(spark, p)]


def read_documents(spark: SparkSession, paths: list[str], schema: str = schemas.RAW_DOCUMENT) -> DataFrame:
    """Raw documents of an ordered file list, with source_file, file_ord and line: the order that first-wins needs."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], schema + ", source_file string, file_ord int, line long")
    df = spark.read.schema(schema).json(found).withColumn("source_file", F.col("_metadata.file_name"))
    order = F.create_map(*[F.lit(x) for i, p in enumerate(paths) for x in (p.rstrip("/").rsplit("/", 1)[-1], i)])
    return df.withColumn("file_ord", F.element_at(order, F.col("source_file"))).withColumn("line", F.monotonically_increasing_id())


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def rewrite_in_order(spark: SparkSession, path: str, to: str, schema: str, *order: str) -> None:
    """Result lines in the order they were completed -> the same lines sorted over all files of `to`: ranges are sorted each by itself, and files are named in order."""
    df = spark.read.schema(schema).json(path)
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", "true").json(to)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    q = spark.read.schema(schemas.QUESTION).option("multiLine", "true").json(path)
    return q.withColumn("topic", F.coalesce("topic", F.lit("general"))).withColumn("reference_keywords", F.coalesce("reference_keywords", F.array().cast("array<string>")))


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Result files of any generation under one superset schema, with the file that each row came from."""
    return spark.read.schema(schemas.RESULT).json(list(paths)).withColumn("file", F.col("_metadata.file_path"))


def latest(df: DataFrame, directory: Column, file: Column) -> DataFrame:
    """Rows of the lexically last file of every directory."""
    w = df.withColumn("__d", directory).withColumn("__f", file)
    last = w.groupBy("__d").agg(F.max("__f").alias("__f"))
    return w.join(last, ["__d", "__f"], "left_semi").drop("__d", "__f")


def read_latest_runs(spark: SparkSession, root: str, pattern: str = "eval_*.jsonl") -> DataFrame:
    df = spark.read.schema(schemas.RESULT).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(root).withColumn("file", F.col("_metadata.file_path"))
    return latest(df, F.regexp_replace("file", "/[^/]*$", ""), F.col("file"))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows onto the tab-separated experiment log."""
    df.write.mode("append").option("header", "true").option("sep", "\t").csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EXPERIMENT_LOG).option("header", "true").option("sep", "\t").csv(path)


def log_tail(log: DataFrame, n: int = 15) -> DataFrame:
    return log.orderBy(F.col("exp_id").desc()).limit(n).orderBy("exp_id")


def next_experiment(log: DataFrame) -> int:
    return (log.agg(F.max("exp_id")).first()[0] or 0) + 1


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """name, mean, stddev, rounds of a pytest-benchmark file."""
    kind = "benchmarks array<struct<name:string,fullname:string,stats:struct<mean:double,stddev:double,min:double,max:double,rounds:long>>>"
    b = spark.read.schema(kind).option("multiLine", "true").json(path).select(F.explode("benchmarks").alias("b"))
    return b.select(F.substring_index("b.fullname", "::", -1).alias("name"), "b.stats.mean", "b.stats.stddev", "b.stats.rounds")


def pack_metadata(df: DataFrame, fixed: list[str]) -> DataFrame:
    """Columns beyond the fixed ones as one VARIANT column: rows of the unified table, whose fields are read without parsing a text."""
    rest = [c for c in df.columns if c not in fixed]
    return df.select(*fixed, F.to_variant_object(F.struct(*rest)).alias("metadata"))


def unpack_metadata(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns of fields of `metadata` (VARIANT) or, in tables of older form, of `metadata_json` (a text); what is missing or of another type is null."""
    v = F.col("metadata") if "metadata" in df.columns else F.try_parse_json("metadata_json")
    return df.withColumns({name: F.try_variant_get(v, f"$.{name}", kind) for name, kind in fields.items()})


#: Columns of the unified table beside its metadata.
UNIFIED = ["vector", "text", "doc_id", "chunk_id", "source", "title"]


def save_unified(chunks: DataFrame, vectors: DataFrame, name: str, dim: int, buckets: int = 64) -> None:
    """The unified table: chunks with their vectors and metadata, bucketed and sorted by chunk, so that payloads meet ranked chunks
    without a shuffle of the table."""
    save_table(pack_metadata(join_vectors(vectors, chunks, dim), UNIFIED), name, "chunk_id", buckets)


def join_vectors(vectors: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """Vectors with their chunks by id; a missing partner or another dimension fails the job, as the count check of a zip would."""
    both = vectors.join(chunks, "chunk_id", "full")
    ok = F.assert_true(F.col("vector").isNotNull() & F.col("text").isNotNull() & (F.size("vector") == dim), F.lit("vectors and chunks do not match"))
    return both.where(ok.isNull())


def save_table(df: DataFrame, name: str, bucket: str | None = None, buckets: int = 64) -> None:
    """A managed table; bucketed by the key that later joins use, so that these need no shuffle."""
    w = df.write.mode("overwrite")
    (w.bucketBy(buckets, bucket).sortBy(bucket) if bucket else w).saveAsTable(name)


def open_table(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise FileNotFoundError(f"table {name} does not exist; build it first")
    return spark.table(name)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old without a partner: last write wins."""
    return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old, and those of new without a partner: first write wins."""
    return old.unionByName(new.join(old, keys, "left_anti"), allowMissingColumns=True)


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that `merge_stored` keeps."""
    return spark.read.parquet(f"{path}/rows").drop("bucket")


def merge_stored(path: str, new: DataFrame, keys: list[str], batch: str, how=upsert, buckets: int = 64) -> bool:
    """Merge new rows into the table under path by `upsert` or `insert_missing`; false if this batch was merged before.

    Rows lie in folders by bucket of their keys, and only folders that some new row belongs to are read and written again; the files of all others
    stay. A batch is noted when it is done, so its replay does nothing; one that was cut off is merged again, to the same result.
    Several new rows of a key fail the job, as which of them wins would be chance.
    """
    spark = new.sparkSession
    if exists(spark, f"{path}/batches/{batch}/_SUCCESS"):
        return False
    rows = materialise(_bucketed(new, keys, buckets), "merge-new")
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"several new rows of one key: {twice.first()}")
    if exists(spark, f"{path}/rows"):
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # numbers below `buckets`
        old = spark.read.parquet(f"{path}/rows").where(F.col("bucket").isin(touched)) if touched else spark.read.parquet(f"{path}/rows").limit(0)
        rows = materialise(how(old, rows, [*keys, "bucket"]), "merge-rows")  # what is read is written over
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/batches/{batch}")
    return True


def not_done(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed crawl still has to fetch, in order."""
    return candidates.join(done.select(key), key, "left_anti").orderBy(key)


def missing_outputs(expected: DataFrame, root: str, key: str = "path") -> DataFrame:
    """Expected relative paths that have no file under root: what a run still has to write or fetch."""
    spark = expected.sparkSession
    if not exists(spark, root):
        return expected.select(key)
    have = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    return expected.select(key).join(have.select(F.substring_index("path", base, -1).alias(key)), key, "left_anti")


def capped(df: DataFrame, group: str, item: str, most: int, *order: str) -> DataFrame:
    """At most `most` distinct items of every group: the cap of a search crawl."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.dropDuplicates([group, item]).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def page(df: DataFrame, size: int, number: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(size * number).limit(size)


def prompt_field(payload: Column) -> Column:
    """The question of a nested request, from whichever place has one."""
    v = F.try_parse_json(payload)
    return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in ("$.prompt", "$.input", "$.question", "$.vars.question", "$.context.vars.question", "$.test.vars.question")])


def compact_json(row: Column) -> Column:
    """A struct as JSON without null fields, for append-only logs."""
    return F.to_json(row, {"ignoreNullFields": "true"})
