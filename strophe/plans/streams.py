"""Streaming queries on the events and the dated log, with batch twins as their SQL (survey group T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strophe.plans.registry import Registry, table
from strophe.session import scratch
from strophe.streaming import windows as S

Q = Registry()


def _aggs() -> dict:
    return {"n": F.count("*"), "total": F.round(F.sum("value"), 4)}


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in columns else F.col(c) for c in df.columns])


TUMBLING = "SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
SLIDING = """SELECT strftime(time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL"""
SESSIONS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 14400000000 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, k"""
LATEST = "SELECT item_id, available, status FROM (SELECT DISTINCT * FROM link_status) WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC, checked_on DESC, coalesce(status, '') DESC, coalesce(available, false) DESC) = 1"


def _closed_events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream that ends, a day of lateness allowed."""
    path = S.closed(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value"), "ts", scratch(spark, "events"))
    return S.with_event_time(S.event_stream(spark, path), "ts", "1 day")


@Q(TUMBLING)
def batch_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour windows (T-07)."""
    return _text(S.tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["event_type"], _aggs()), "start")


@Q(SLIDING)
def batch_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Half-overlapping windows (T-08)."""
    return _text(S.sliding(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "12 hours", "6 hours", [], _aggs()), "start")


@Q(SESSIONS)
def batch_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that end after four quiet hours (T-09)."""
    s = S.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "4 hours", ["user_id"], _aggs())
    return _text(s.select("user_id", "start", "n", "total"), "start")


@Q(TUMBLING)
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The same windows from a stream, each written once, when the watermark has passed it (T-02, T-07)."""
    e = _closed_events(spark, d)
    return _text(S.run_to_end(S.tumbling(e, "ts", "6 hours", ["event_type"], _aggs())), "start")


@Q(SLIDING)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Half-overlapping windows of a stream (T-08)."""
    e = _closed_events(spark, d)
    return _text(S.run_to_end(S.sliding(e, "ts", "12 hours", "6 hours", [], _aggs())), "start")


@Q(SESSIONS)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session windows of a stream (T-09)."""
    e = _closed_events(spark, d)
    s = S.run_to_end(S.sessions(e, "ts", "4 hours", ["user_id"], _aggs()))
    return _text(s.select("user_id", "start", "n", "total"), "start")


@Q(LATEST)
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last state of every item from a late and repetitive log (T-04, T-06)."""
    ls = S.event_stream(spark, f"{d}/link_status.parquet").where("item_id is not null")
    ls = ls.select("*", F.coalesce("status", F.lit("")).alias("s0"), F.coalesce("available", F.lit(False)).alias("a0"))
    u = S.run_to_end(S.latest(ls, "item_id", ["loaded_at", "checked_on", "s0", "a0"], ["available", "status"]), "update")
    # of a key that changed in several batches the last one holds
    return u.groupBy("item_id").agg(F.max_by(F.struct("available", "status"), "batch").alias("s")).select("item_id", "s.*")


@Q("SELECT search_id, region, query, CAST(coalesce(len(hits), 0) AS INTEGER) AS hits FROM search_log")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """A stateless stream from a log to an append-only table, exactly once (T-01, T-03, K-04)."""
    s = S.event_stream(spark, f"{d}/search_log.parquet")
    return S.run_to_end(s.select("search_id", "region", "query", F.coalesce(F.array_size("hits"), F.lit(0)).alias("hits")))


QUERIES, SQL = Q.queries, Q.sql
