"""Streaming queries, run once over what is there and read back from what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.session import new_path
from tabularium.streaming import alerts

from .results import read


def _events(spark, sf_dir):
    (events,) = read(spark, sf_dir, "events")
    return alerts.alert_stream(spark, f"{sf_dir}/events.parquet*", events.schema)


def alert_poll(spark, sf_dir):
    """Errors of high value, appended batch by batch."""
    out = new_path(spark, "alerts")
    found = _events(spark, sf_dir).where("event_type = 'error' and value > 30").select(F.col("event_id").alias("id"), "user_id", "value")
    alerts.append(found, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/table")


SQL_ALERTS = "SELECT event_id AS id, user_id, value FROM events WHERE event_type = 'error' AND value > 30"


def windowed_counts(spark, sf_dir):
    """Events per day and kind, with a watermark; the last row of each."""
    out = new_path(spark, "windows")
    stream = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    found = alerts.windowed(stream, "at", "1 day", "2 hours", "event_type")
    rows = found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))
    return alerts.last_state(rows, ["day", "event_type"], f"{out}/table", f"{out}/checkpoint")


SQL_WINDOWS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"


def latest_status(spark, sf_dir):
    """Per user, the last event seen by the stream."""
    out = new_path(spark, "status")
    rows = _events(spark, sf_dir).groupBy("user_id").agg(F.max("event_id").alias("last_id"), F.max_by("event_type", "event_id").alias("status"))
    return alerts.last_state(rows, ["user_id"], f"{out}/table", f"{out}/checkpoint")


SQL_STATUS = "SELECT user_id, max(event_id) AS last_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id"


def session_counts(spark, sf_dir):
    """Sessions of a user, closed by an hour without events; the last row of each."""
    out = new_path(spark, "sessions")
    stream = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    found = alerts.sessions(stream, "at", "1 hour", "2 hours", "user_id").select("user_id", F.date_format("session.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")
    alerts.append(found, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    closed = spark.read.schema(found.schema).parquet(f"{out}/table")
    # the stream holds back what a later event may still add to: the last three hours
    return closed


SQL_SESSIONS = """
WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 HOUR, true) AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
g AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS began, n FROM g WHERE b + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"""


def polled_alerts(spark, sf_dir):
    """Events handed on in order of their ids, as a poll does; what it was given."""
    out = new_path(spark, "polled")
    given = _events(spark, sf_dir).where("event_type = 'signup'").select(F.col("event_id").alias("id"), "user_id")

    seen = set()

    def act(df, n):
        df.write.mode("overwrite").parquet(f"{out}/table/{n}")
        seen.add(n)

    alerts.poll(given, act, f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(given.schema).parquet(*[f"{out}/table/{n}" for n in sorted(seen)]) if seen else spark.createDataFrame([], given.schema)


SQL_POLLED = "SELECT event_id AS id, user_id FROM events WHERE event_type = 'signup'"

QUERIES = {
    "session_counts": (session_counts, SQL_SESSIONS),
    "polled_alerts": (polled_alerts, SQL_POLLED),
    "alert_poll": (alert_poll, SQL_ALERTS),
    "windowed_counts": (windowed_counts, SQL_WINDOWS),
    "latest_status": (latest_status, SQL_STATUS),
}
