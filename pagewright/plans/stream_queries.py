"""Queries of the streaming rules over the whole event table, in their batch form; windows are extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.plans.augment import read
from pagewright.streaming import inflight as I
from pagewright.streaming import requests as S


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def breaker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(
        F.concat(F.lit("h"), (F.col("user_id") % 50).cast("string")).alias("host"), F.col("event_id").alias("index"), F.unix_timestamp("ts").cast("double").alias("t"), (F.col("event_type") != "error").alias("ok")
    )
    return S.breaker_batch(rows, most=2, pause=86400.0, half_life=604800.0).groupBy("host").agg(F.count("*").alias("requests"), F.count_if("admitted").alias("admitted"))


def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tumbling(_events(spark, sf_dir), "event_type").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.sessions(_events(spark, sf_dir), "user_id", "1 day")
    return rows.select(F.unix_timestamp("start").alias("start"), "user_id", "n")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the event table's files: who leads, who follows, and with what result, once that is known.

    An event is a request of its user's and type's page; ``value`` says how many minutes it takes. Those whose leader is
    still under way when the stream's event time ends have no row yet.
    """
    rows = I.file_stream(spark, sf_dir, "events").select(
        F.concat_ws("|", (F.col("user_id") % 20).cast("string"), "event_type").alias("request_key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.floor(F.col("value")) * 60).alias("takes")
    )
    return I.run_available(I.followed(rows), "inflight")


QUERIES = {f.__name__: f for f in (breaker_state, ext_tumbling, ext_session, stream_dedup)}

ORACLE_SQL = {
    "ext_tumbling": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "ext_session": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_dedup": """WITH RECURSIVE e AS (SELECT (user_id % 20) || '|' || event_type AS k, event_id AS id, epoch_ms(ts) / 1000.0 AS t, floor(value) * 60 AS takes FROM events),
        o AS (SELECT k, id, t, takes, row_number() OVER (PARTITION BY k ORDER BY t, id) AS n FROM e),
        s AS (SELECT k, id, n, id AS leader_id, t + least(takes, 900) AS until, takes <= 900 AS ok FROM o WHERE n = 1 UNION ALL
            SELECT o.k, o.id, o.n, CASE WHEN o.t < s.until THEN s.leader_id ELSE o.id END, CASE WHEN o.t < s.until THEN s.until ELSE o.t + least(o.takes, 900) END, CASE WHEN o.t < s.until THEN s.ok ELSE o.takes <= 900 END FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1),
        w AS (SELECT max(t) - 60 AS mark FROM e), c AS (SELECT *, max(n) OVER (PARTITION BY k) AS last, count(*) OVER (PARTITION BY k, leader_id) - 1 AS followers, last_value(leader_id) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS open FROM s)
        SELECT k AS request_key, id, leader_id, followers, ok FROM c, w WHERE leader_id <> open OR until <= mark""",
}
