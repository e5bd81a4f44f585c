"""Alerts on keys that stay quiet, from a stream with state and timers of event time.

A purchase is followed by an alert if its user makes no other within `hours` after it. Events may arrive out of order within
LATENESS, so an alert comes out once the watermark has passed the end of the quiet time: by then no event that could
prevent it can arrive. The result doesn't depend on how events are dealt into batches or on restarts between them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from .windows import LATENESS, event_stream, run_available

HOURS = 48
ALERTS = "user_id long, last_at long, alert_at long"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def settled(times: list[int], quiet: int, watermark: int) -> tuple[list[int], list[int]]:
    """(alerts, times to keep) of a user's purchases, in microseconds, when no event before `watermark` can arrive any more.

    A time is kept while its quiet time is open and no other time lies in it, or while an earlier event may still arrive
    that it would follow. So the state has open alerts and the lateness' purchases, however many a user makes.
    """
    times = sorted(set(times))
    following = [*times[1:], None]
    alone = [n is None or n - t > quiet for t, n in zip(times, following, strict=True)]
    alerts = [t for t, a in zip(times, alone, strict=True) if a and t + quiet <= watermark]
    return alerts, [t for t, a in zip(times, alone, strict=True) if t >= watermark or (a and t + quiet > watermark)]


class QuietTimes(StatefulProcessor):
    """Holds a user's purchases in a list state and one timer: the end of the first open quiet time."""

    def __init__(self, hours: float):
        self.quiet = round(hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at long")

    def _step(self, key, new: list[int], watermark: int) -> Iterator[Row]:
        alerts, kept = settled([*(r[0] for r in self.times.get()), *new], self.quiet, watermark)
        if kept:
            self.times.put([(t,) for t in kept])
        else:
            self.times.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:  # timers fire once the watermark, in milliseconds, has passed them
            self.handle.registerTimer(-(-(kept[0] + self.quiet) // 1000))
        for t in alerts:
            yield Row(user_id=key[0], last_at=t, alert_at=t + self.quiet)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._step(key, [r["at"] for r in rows], 1000 * max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        yield from self._step(key, [], 1000 * passed)

    def close(self) -> None:
        pass


def quiet_users(events: DataFrame, hours: float = HOURS) -> DataFrame:
    """(user_id, last_at, alert_at), in microseconds: purchases that no other of the same user follows within `hours`.

    From a stream with ts (timestamp), event_id, user_id and event_type: alerts whose time the watermark has passed; run it
    with run_available(), in a session of with_state_store(). From a table: those whose time lies LATENESS before the last
    purchase, which is the same. Rows with a null time or user count for nothing; several purchases at one time are one.
    """
    bought = events.where("event_type = 'purchase' and ts is not null and user_id is not null")
    at = F.unix_micros("ts").alias("at")
    quiet = round(hours * 3_600_000_000)
    if events.isStreaming:
        rows = bought.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id"]).select("user_id", "ts", at)
        return rows.groupBy("user_id").transformWithState(QuietTimes(hours), ALERTS, "Append", "EventTime")
    rows = bought.select("user_id", at).distinct()
    end = rows.agg((F.floor(F.max("at") / 1000) * 1000 - F.expr(f"unix_micros(timestamp_micros(0) + interval {LATENESS})")).alias("end"))
    rows = rows.withColumn("next", F.lead("at").over(Window.partitionBy("user_id").orderBy("at")))
    rows = rows.where(F.col("next").isNull() | (F.col("next") - F.col("at") > quiet)).join(F.broadcast(end), F.col("at") + quiet <= F.col("end"))
    return rows.select("user_id", F.col("at").alias("last_at"), (F.col("at") + quiet).alias("alert_at"))


def with_state_store(spark: SparkSession, run):
    """run() while the session's streams keep their state where lists and timers are possible."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def streamed_quiet_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quiet_users() over the event table, read as a stream of files."""
    ship(spark)
    return with_state_store(spark, lambda: run_available(quiet_users(event_stream(spark, sf_dir))))


QUERIES = {"streamed_quiet_users": streamed_quiet_users}
_QUIET = HOURS * 3_600_000_000
ORACLE_SQL = {
    "streamed_quiet_users": f"""
        WITH p AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
        n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS later FROM p)
        SELECT user_id, t AS last_at, t + {_QUIET} AS alert_at FROM n
        WHERE (later IS NULL OR later - t > {_QUIET}) AND t + {_QUIET} <= (SELECT 1000 * (max(t) // 1000) - 600000000 FROM p)""",
}
