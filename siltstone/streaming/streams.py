"""Structured Streaming: windowed counts, sessions, dedupe, resumable ingest and append-only logs.

Event times are cast from TIMESTAMP_NTZ, which watermarks do not take. A query reads all files there are
(`availableNow`), and its checkpoint makes the next start go on where it ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from siltstone.sources.files import exists, shared_dir


def read_stream(spark: SparkSession, path: str, event_time: str | None = None, late: str = "1 hour", files_per_batch: int = 100) -> DataFrame:
    """A stream over Parquet files, with a watermark on its event time."""
    schema = spark.read.parquet(path).schema
    # a single file is a stream over its folder, filtered by name
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = reader.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late) if event_time else stream


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_counts(stream: DataFrame, event_time: str, length: str, slide: str | None = None, *keys: str) -> DataFrame:
    w = F.window(event_time, length, slide) if slide else F.window(event_time, length)
    g = stream.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, event_time: str, gap: str, key: str) -> DataFrame:
    g = stream.groupBy(F.session_window(event_time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), key, "n")


def distinct_within(stream: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key while the watermark remembers it."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that is there now through the stream, as a table of what its sink got.

    Complete results replace the table at every batch; appended ones are written by batch number, so that a batch
    that runs again after a failure replaces its own rows.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not exists(spark, f"{base}/out"):
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema).parquet(f"{base}/out") if mode == "complete" else spark.read.schema(schema.add("batch", "long")).parquet(f"{base}/out").drop("batch")
    return out


def crawl(stream: DataFrame, path: str) -> DataFrame:
    """What a stream lists and is not yet under path is added there; the whole table comes back.

    The checkpoint lies beside the rows. A batch is written under its number, so one that is run again after a failure replaces its own rows.
    A start after a failure may do no more than that batch, so it is started again until nothing comes.
    """
    spark, schema = stream.sparkSession, stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    some = True
    while some:
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        some = any(p.numInputRows for p in query.recentProgress)
    if not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema.add("batch", "long")).parquet(f"{path}/rows").drop("batch")


class LastRows(StatefulProcessor):
    """Of every key the n rows with the largest order, kept in state; a batch gives the keys whose rows changed."""

    def __init__(self, names: list[str], order: str, n: int, schema: StructType):
        self.names, self.order, self.n, self.schema = names, order, n, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", StructType([StructField("order", self.schema[self.order].dataType), StructField("row", StringType())]), StructType([StructField("value", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = {tuple(k): v[0] for k, v in self.kept.iterator()}
        before = set(have)
        for part in rows:
            for order, row in zip(part[self.order], part["json"], strict=True):
                have[order, row] = row
        last = sorted(have)[-self.n :]
        for k in before - set(last):
            self.kept.removeKey(k)
        for k in last:
            if k not in before:
                self.kept.updateValue(k, (k[1],))
        if set(last) != before:
            yield pd.DataFrame({"key": [key[0]] * len(last), "row": [row for _, row in last]})

    def close(self) -> None:
        pass


def tail(stream: DataFrame, key: str, order: str, n: int = 15) -> DataFrame:
    """(key, row): after every batch, the last n rows by `order` of the keys that changed, as JSON; late rows find their place, evicted ones are gone.

    The state of a key is n rows. A batch sends n rows of each key from a partition at most, so a log that fills the stream is no load for the task that keeps it.
    """
    spark, names = stream.sparkSession, stream.columns
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(F.col(key).cast("string").alias("of"), order, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json")).where(F.col(order).isNotNull())

    def last_of_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.sort_values([order, "json"]).groupby("of", dropna=False).tail(n)

    kept = rows.mapInPandas(last_of_part, rows.schema)
    processor = LastRows(names, order, n, rows.schema)
    return kept.groupBy("of").transformWithStateInPandas(processor, "key string, row string", "Update", "None")


def append_json(stream: DataFrame, path: str, checkpoint: str, line: Column):
    """An append-only log: one JSON line a row, exactly once by the sink's own log."""
    return stream.select(line.alias("value")).writeStream.format("text").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
