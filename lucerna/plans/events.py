"""Event-time queries (an extension: batch forms of the streaming pipelines) and generic relational smoke queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import pipelines


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(pipelines.windowed(_events(spark, sf), "1 hour"), "start")


def events_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(pipelines.windowed(_events(spark, sf), "1 day", "6 hours"), "start")


def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(pipelines.sessions(_events(spark, sf)), "start", "end")


def events_distinct(spark: SparkSession, sf: str) -> DataFrame:
    d = pipelines.deduplicated(_events(spark, sf), ["user_id", "event_type"])
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_users"))


def order_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """A plain star join and aggregation."""
    l = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o, c, n = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count(F.lit(1)).alias("n_lines"))


QUERIES = {f.__name__: f for f in (events_tumbling, events_sliding, events_sessions, events_distinct, order_revenue)}

ORACLE = {
    "events_tumbling": "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "WITH o AS (SELECT unnest([0, 6, 12, 18]) h), w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(h) s, * FROM events, o) SELECT s::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2",
    "events_sessions": """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END f FROM events),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM a) SELECT min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS "end", user_id, count(*) AS n FROM b GROUP BY user_id, g""",
    "events_distinct": "SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
    "order_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
