"""Joins of points in time with intervals, per key, without gathering a key's rows in one task.

Time is cut into buckets of `width`. An interval goes to every bucket that it touches, a point to its own one; they meet by
key and bucket, and the exact bounds are checked there. A point is in one bucket, so each pair comes out once, and a hot key
is spread over as many groups as it has buckets. Intervals much longer than the width are copied often: choose a width near
their usual length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: Column, start: Column, end: Column, width: int, extra: Column | None = None) -> DataFrame:
    """All columns of both sides for each pair of a point and an interval of the same `key` (a column of both, once in the
    result) with start <= at <= end, all whole numbers; `at` is of points, `start` and `end` are of intervals.

    Both sides may be streams with watermarks: then `extra` must state the bounds on their time columns, as Spark lets state
    go by them. Rows with a null key or time meet nothing; an interval that ends before it starts has no points. Other
    columns of the two sides must have different names.
    """
    bucket, low, high, place = (f"_interval_{x}" for x in ("bucket", "low", "high", "at"))
    spans = intervals.withColumns({low: start, high: end}).where(F.col(low) <= F.col(high))
    spans = spans.withColumn(bucket, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    dots = points.withColumn(place, at).withColumn(bucket, F.floor(F.col(place) / width))
    other = f"_interval_{key}"
    spans = spans.withColumnRenamed(key, other)
    exact = (F.col(place) >= F.col(low)) & (F.col(place) <= F.col(high))
    met = dots.withColumnRenamed(bucket, f"{bucket}_of").join(spans, (F.col(key) == F.col(other)) & (F.col(f"{bucket}_of") == F.col(bucket)) & exact & (F.lit(True) if extra is None else extra))
    return met.drop(bucket, f"{bucket}_of", low, high, place, other)
