"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint directory set on the context.

    Only a session on one machine (tests) may have neither; a temporary folder takes its place there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = own.get() if own.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and go on from the files: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths of all tables that are materialised inside."""
    paths: list[str] = []
    token = _made.set(paths)
    try:
        yield paths
    finally:
        _made.reset(token)


def within_run() -> bool:
    """Whether somebody collects the paths of materialised tables and will delete them."""
    return _made.get() is not None


def reads(df: DataFrame, paths: list[str]) -> bool:
    """Whether df's plan scans one of the tables; only the plan is looked at, no files are listed."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            names = [roots.apply(i).getName() for i in range(roots.size())]
            if any(p.rstrip("/").rsplit("/", 1)[-1] in names for p in paths):
                return True
    return False


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete materialised tables that no plan will read again."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay small: at most `rows` rows, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash128(col) -> list:
    """Two independent 64-bit hashes of a column; together the identity of a text."""
    return [F.xxhash64(col), F.xxhash64(F.lit("second"), col)]


def crc32_text(col):
    return F.crc32(F.encode(col, "UTF-8"))


def crc32_mod(col, m: int):
    """crc32 of an id's decimal text, modulo m: the fold rule of the labelled queries. Null id: 0."""
    return F.coalesce(crc32_text(col.cast("string")) % m, F.lit(0)).cast("int")


def attach(rows: DataFrame, about: DataFrame, key: list[str], spread, how: str = "inner", salts: int = 64) -> DataFrame:
    """rows joined with `about` (one row a key), where one key may hold most rows.

    `spread` is a column by whose hash the rows of a key are dealt to salts; `about` is repeated only for the salts that
    a key has, which are found by pre-aggregation, so a key of few rows costs few.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    have = salted.select(*key, "__salt").distinct()
    return salted.join(have.join(about, key), [*key, "__salt"], how).drop("__salt")
