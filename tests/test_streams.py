"""Streams in several batches: late events, events that come twice, windows and sessions that are still open."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from heronry.streaming.windows import daily_types, run_available, run_updates, user_sessions

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
# each list arrives as a file of its own, in this order
ARRIVALS = [
    [(1, "2024-01-01 10:00:00", 1, "view", 1.25), (2, "2024-01-01 11:00:00", 2, "view", 2.0), (3, None, 1, "view", 8.0)],
    [(4, "2024-01-02 12:00:00", 1, "view", 3.0), (5, "2024-01-01 23:59:59", 2, "click", 1.0)],  # the watermark is still at 10:50 of the first day
    [(7, "2024-01-02 11:55:00", 1, "view", 4.0), (4, "2024-01-02 12:00:00", 1, "view", 3.0)],  # out of order but not late; and one that comes again
    [(6, "2024-01-01 23:00:00", 1, "view", 50.0)],  # late: the first day was closed by the batch before
    [(8, "2024-01-04 00:30:00", 2, "view", 5.0)],
]


def _at(day, hour=0, minute=0, second=0):
    return 1_000_000 * (1704067200 + 86400 * (day - 1) + 3600 * hour + 60 * minute + second)


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """A stream that takes one file a batch."""
    folder = tmp_path_factory.mktemp("arrivals")
    for n, rows in enumerate(ARRIVALS):
        rows = [(i, t and datetime.fromisoformat(t), *rest) for i, t, *rest in rows]
        at = folder / f"part-{n}"
        spark.createDataFrame(rows, EVENTS.replace("ts timestamp", "ts timestamp_ntz")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(at))
        for file in at.glob("*.parquet"):
            os.utime(file, (1_700_000_000 + 100 * n,) * 2)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_closed_windows(arrivals):
    rows = {(r["from_at"], r["event_type"]): (r["n_events"], float(r["value"])) for r in run_available(daily_types(arrivals)).collect()}
    assert rows == {(_at(1), "view"): (2, 3.25), (_at(1), "click"): (1, 1.0), (_at(2), "view"): (2, 7.0)}


def test_all_windows(arrivals):
    found = run_updates(daily_types(arrivals), ["from_at", "event_type"])
    rows = {(r["from_at"], r["event_type"]): (r["n_events"], float(r["value"])) for r in found.collect()}
    assert rows == {(_at(1), "view"): (2, 3.25), (_at(1), "click"): (1, 1.0), (_at(2), "view"): (2, 7.0), (_at(4), "view"): (1, 5.0)}
    assert found.count() == len(rows)


def test_closed_sessions(arrivals):
    rows = {tuple(r) for r in run_available(user_sessions(arrivals)).select("user_id", "first_at", "last_at", "n_events").collect()}
    # user 1 has a gap of more than twelve hours, user 2 one of 12:59:59; the last session of user 2 is still open
    assert rows == {(1, _at(1, 10), _at(1, 10), 1), (1, _at(2, 11, 55), _at(2, 12), 2), (2, _at(1, 11), _at(1, 11), 1), (2, _at(1, 23, 59, 59), _at(1, 23, 59, 59), 1)}


def test_a_gap_of_just_twelve_hours_joins(spark):
    rows = [(1, datetime(2024, 1, 1), 1, "view", 1.0), (2, datetime(2024, 1, 1, 12), 1, "view", 1.0), (2, datetime(2024, 1, 1, 12), 1, "view", 1.0), (3, datetime(2024, 1, 2, 0, 0, 0, 1), 1, "view", 1.0)]
    found = user_sessions(spark.createDataFrame(rows, EVENTS)).select("n_events").collect()
    assert sorted(r["n_events"] for r in found) == [1, 2]


def test_no_events(spark):
    nothing = spark.createDataFrame([], EVENTS)
    assert daily_types(nothing).count() == 0 and user_sessions(nothing).count() == 0
