"""Queries on the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import exact_sum
from ..operators import timelines
from ..operators.intervals import interval_join
from ..operators.sequences import sequences
from ..sources.tables import table

_GAP = 12 * 3_600_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return events.withColumn("at", timelines.micros(F.col("ts"))).drop("ts")


def purchase_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest view of the same user up to each purchase."""
    views = F.when(F.col("event_type") == "view", F.col("event_id"))
    rows = timelines.as_of(_events(spark, sf_dir).where(F.col("event_type").isin("view", "purchase")), "user_id", "at", "event_id", views)
    return rows.where("event_type = 'purchase'").select("event_id", "user_id", "at", F.col("as_of").alias("view_id"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events with no more than twelve hours between them."""
    rows = timelines.sessions(_events(spark, sf_dir), "user_id", "at", "event_id", _GAP)
    return rows.groupBy("user_id", "session").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n_events"), exact_sum(F.col("value"), 2).alias("value")
    )


def hourly_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value by type in windows of six hours that begin every two hours."""
    events = table(spark, sf_dir, "events", "ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.groupBy(F.window("ts", "6 hours", "2 hours").alias("w"), "event_type")
    rows = rows.agg(F.count("*").alias("n_events"), exact_sum(F.col("value"), 2).alias("value"))
    return rows.select(F.unix_micros("w.start").alias("from_at"), "event_type", "n_events", "value")


def purchase_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase that clicks of the same user precede within a day, with their number and value: intervals that overlap."""
    events = _events(spark, sf_dir)
    clicks = events.where("event_type = 'click'").select("user_id", "at", "value")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", F.col("at").alias("bought_at"))
    met = interval_join(clicks, bought, "user_id", F.col("at"), F.col("bought_at") - timelines.DAY, F.col("bought_at"), timelines.DAY)
    return met.groupBy("event_id", "user_id").agg(F.count("*").alias("n_clicks"), exact_sum(F.col("value"), 2).alias("value"))


def led_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that a view and then a click of the same user lead to within two days, without an error in between, with the
    latest such view."""
    kind = F.col("event_type")
    steps = [kind == "view", kind == "click", kind == "purchase"]
    found = sequences(_events(spark, sf_dir), "user_id", "at", "event_id", steps, 2 * timelines.DAY, kind == "error")
    return found.select("event_id", "user_id", F.col("began_tie").alias("view_id"))


QUERIES = {f.__name__: f for f in (purchase_views, user_sessions, hourly_types, purchase_clicks, led_purchases)}
_VALUE = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value"
ORACLE_SQL = {
    "purchase_views": """
        SELECT event_id, user_id, epoch_us(ts) AS at, view_id FROM (
            SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (
                PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS view_id
            FROM events WHERE event_type IN ('view', 'purchase'))
        WHERE event_type = 'purchase'""",
    "user_sessions": f"""
        SELECT user_id, CAST(session AS BIGINT) AS session, min(epoch_us(ts)) AS first_at, max(epoch_us(ts)) AS last_at, count(*) AS n_events, {_VALUE}
        FROM (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
              FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {_GAP} THEN 0 ELSE 1 END AS starts
                    FROM events))
        GROUP BY user_id, session""",
    "hourly_types": f"""
        SELECT from_at, event_type, count(*) AS n_events, {_VALUE}
        FROM (SELECT event_type, value, 7200000000 * (epoch_us(ts) // 7200000000 - k) AS from_at FROM events, (SELECT unnest([0, 1, 2]) AS k))
        GROUP BY ALL""",
    "purchase_clicks": f"""
        SELECT p.event_id, p.user_id, count(*) AS n_clicks, {_VALUE.replace("value AS", "c.value AS")}
        FROM events p JOIN events c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click'
             AND c.ts BETWEEN p.ts - INTERVAL 1 DAY AND p.ts
        GROUP BY p.event_id, p.user_id""",
    "led_purchases": """
        SELECT p.event_id, p.user_id, max(v.event_id) AS view_id
        FROM events p JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts < p.ts
             JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts < c.ts AND v.ts >= p.ts - INTERVAL 2 DAY
        WHERE p.event_type = 'purchase' AND NOT EXISTS (
            SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'error' AND e.ts > v.ts AND e.ts < p.ts)
        GROUP BY p.event_id, p.user_id""",
}
