"""Joins of two streams within a time: state on both sides, which goes once the watermarks have passed what could match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import interval_join
from .windows import LATENESS, event_stream, run_available

HOUR = 3_600_000_000


def _side(events: DataFrame, kind: str, id_name: str, at_name: str) -> DataFrame:
    rows = events.where((F.col("event_type") == kind) & F.col("ts").isNotNull())
    rows = rows.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])
    return rows.select("user_id", F.col("event_id").alias(id_name), F.col("ts").alias(at_name))


def views_to_purchases(views: DataFrame, purchases: DataFrame, hours: int = 1) -> DataFrame:
    """(user_id, view_id, purchase_id, viewed_at, purchased_at): each view with each purchase that the user makes within
    `hours` after it, both ends included.

    Two streams or two tables of events with ts (timestamp), event_id, user_id and event_type. The state of a stream is
    keyed by user and hour, so a user with very many events is no hot key, and it holds `hours` and the lateness. Events
    that come after the watermark are left out; each event_id counts once within the lateness.
    """
    left, right = _side(views, "view", "view_id", "viewed"), _side(purchases, "purchase", "purchase_id", "purchased")
    span = F.expr(f"purchased >= viewed and purchased <= viewed + interval {hours} hours")
    start = F.unix_micros("viewed")
    met = interval_join(right, left, "user_id", F.unix_micros("purchased"), start, start + hours * HOUR, hours * HOUR, span)
    return met.select("user_id", "view_id", "purchase_id", F.unix_micros("viewed").alias("viewed_at"), F.unix_micros("purchased").alias("purchased_at"))


def streamed_view_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """views_to_purchases() over the event table, read as two streams of files."""
    return run_available(views_to_purchases(event_stream(spark, sf_dir), event_stream(spark, sf_dir)))


QUERIES = {"streamed_view_purchases": streamed_view_purchases}
ORACLE_SQL = {
    "streamed_view_purchases": """
        SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id, epoch_us(v.ts) AS viewed_at, epoch_us(p.ts) AS purchased_at
        FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase'
             AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR""",
}
