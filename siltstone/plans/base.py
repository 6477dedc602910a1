"""How queries are registered: a function over the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.files import fingerprint, shared_dir, spread


#: Counts and positions are longs in every result, whatever their expression gives.
LONG = {"n", "n_distinct", "n_chars", "chunk_index", "total_chunks", "position", "rank", "rerank_rank", "tokens", "used", "pair", "back"}


def result(df: DataFrame) -> DataFrame:
    wide = {c: df[c].cast("long") for c, kind in df.dtypes if kind == "int" and c in LONG}
    return df.withColumns(wide) if wide else df


#: Tables of texts, on which queries work hard row by row.
TEXTS = {"documents", "conversations", "pages"}


class Tables:
    """Tables of a folder by name, and where what is derived from them may be stored for other queries."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, table: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return spread(df) if table in TEXTS else df

    def stored(self, name: str, *tables: str) -> str:
        """The path of an index over tables; another one as soon as a file of theirs changes."""
        return f"{shared_dir(self.spark)}/{name}-{fingerprint(self.spark, *(f'{self.sf_dir}/{t}.parquet' for t in tables))}"


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Register f(t) as query f; t(name) reads a table. SQL goes beside it where SQL can say it."""

        def register(f):
            name = f.__name__

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return result(f(Tables(spark, sf_dir), spark))

            self.queries[name] = run
            if sql:
                self.oracle[name] = sql
            return f

        return register


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A fixture of a few rows that no table contains."""
    return spark.createDataFrame(rows, columns)


def sql_values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::BIGINT" if isinstance(x, int) else repr(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"
