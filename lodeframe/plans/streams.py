"""Streaming queries over events: each runs to the end of its input and returns the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_dir
from ..streaming import snapshots as Z
from ..streaming import windows as W
from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parque[t]"  # a pattern, as a stream takes folders and patterns only
    return W.read_stream(spark, path, Z.schema_of(spark, path)).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df: DataFrame, mode: str) -> DataFrame:
    folder = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    Z.drain(df, folder, mode)
    return df.sparkSession.read.parquet(f"{folder}/out")


@query(
    "z_tumbling_windows",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def z_tumbling(spark, d):
    w = W.windowed(_stream(spark, d), "ts", "3650 days", "1 hour", keys=["event_type"], n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))
    return W.flat(_run(w, "complete"))


@query(
    "z_sliding_windows",
    """WITH s AS (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events)
       SELECT start, start + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY 1, 2""",
)
def z_sliding(spark, d):
    w = W.windowed(_stream(spark, d), "ts", "3650 days", "2 hours", "1 hour", n=F.count(F.lit(1)))
    return W.flat(_run(w, "complete"))


@query(
    "z_session_windows",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
       SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, s""",
)
def z_session(spark, d):
    w = W.sessions(_stream(spark, d), "ts", "3650 days", "6 hours", ["user_id"], n=F.count(F.lit(1)))
    return W.flat(_run(w, "complete"))


@query(
    "z_status_changes",
    """SELECT CAST(user_id AS VARCHAR) AS key, was, event_type AS now, ts FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS was FROM events) WHERE was <> event_type""",
)
def z_status(spark, d):
    out = _run(Z.status_changes(_stream(spark, d), "user_id", "event_type", "ts"), "append")
    return out.select("key", "was", "now", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "z_snapshot_watch",
    """WITH s AS (SELECT DISTINCT event_type AS part, day(ts) AS run, user_id FROM events), ok AS (SELECT DISTINCT part, run FROM s WHERE NOT (part = 'purchase' AND run % 5 = 4)),
            o AS (SELECT part, run, lag(run) OVER (PARTITION BY part ORDER BY run) AS prev FROM ok),
            b AS (SELECT s.* FROM s JOIN o USING (part, run) WHERE prev IS NOT NULL), a AS (SELECT s.part, o.run, s.user_id FROM s JOIN o ON o.part = s.part AND o.prev = s.run)
       SELECT part, run, user_id, CASE WHEN u IS NULL THEN 'added' ELSE 'removed' END AS change
       FROM (SELECT *, user_id AS u FROM a) FULL JOIN (SELECT *, user_id AS v FROM b) USING (part, run, user_id) WHERE u IS NULL OR v IS NULL""",
)
def z_watch(spark, d):
    """Daily snapshots of users by event type, a week or so in one batch of several files; each fifth one of 'purchase' lacks records and stays unknown."""
    folder = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select(F.col("event_type").alias("part"), F.dayofmonth("ts").alias("run"), "user_id").distinct()
    n = e.groupBy("part", "run").agg(F.count(F.lit(1)).alias("declared"))
    e = e.join(n, ["part", "run"]).withColumn("declared", F.col("declared") + F.when((F.col("part") == "purchase") & (F.col("run") % 5 == 4), 1).otherwise(0)).withColumn("v", F.lit(1))
    watch = Z.SnapshotWatch(folder, "part", "run", "declared", ["user_id"], ["v"])
    e = materialize(e, "snapshots")
    for day in range(1, 32, 8):
        e.where(F.col("run").between(day, day + 7)).repartition(5).write.mode("append").parquet(f"{folder}/in")
        watch.start(W.read_stream(spark, f"{folder}/in", e.schema, 1000), f"{folder}/checkpoint").awaitTermination()
    return watch.alerts(spark).select("part", "run", "user_id", "change")
