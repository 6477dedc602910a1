"""Streaming queries over the event table; the SQL is their batch equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.base import Catalog
from siltstone.streaming import streams

C = Catalog()


def _query(sql: str | None):
    """Register f(stream) as a query over the whole event table."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(streams.read_stream(spark, f"{sf_dir}/events.parquet", "ts"))

        C.queries[f.__name__] = run
        if sql:
            C.oracle[f.__name__] = sql
        return f

    return register


@_query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(s):
    out = streams.drain(streams.windowed_counts(s, "ts", "1 hour", None, "event_type"), "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@_query("SELECT strftime(b - INTERVAL 1 hour * i, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS b FROM events), range(0, 3) AS r(i) GROUP BY 1")
def stream_sliding(s):
    out = streams.drain(streams.windowed_counts(s, "ts", "3 hours", "1 hour"), "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hour THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM h GROUP BY user_id, s""")
def stream_session(s):
    out = streams.drain(streams.sessions(s, "ts", "6 hours", "user_id"), "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@_query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedupe(s):
    twice = s.select("ts", "event_id", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return streams.drain(streams.distinct_within(twice, "event_id")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
