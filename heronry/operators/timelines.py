"""Operators on the time line of a key that don't gather a key's rows in one task.

A window over a key alone sorts all its rows in one place. Here time is cut into buckets: windows run over (key, bucket),
and what a bucket needs from before it comes from a table with one row a key and bucket. A hot key is so spread over as
many tasks as it has buckets. Rows with a null time are left out; null keys form a key of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def quoted(names: list[str]) -> list[str]:
    """Column names as they must be written where a dot would mean a field."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def micros(ts: Column) -> Column:
    """A timestamp as microseconds since 1970 (of the session's time zone for one without zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def as_of(df: DataFrame, key: str, at: str, tie: str, value: Column, bucket: int = DAY) -> DataFrame:
    """df with as_of: the last non-null `value` among the key's rows up to and with each row, ordered by the columns `at`
    (microseconds) and `tie`."""
    rows = df.where(F.col(at).isNotNull()).withColumns({"_bucket": F.floor(F.col(at) / bucket), "_value": value})
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(at, tie)))  # max_by leaves null orders out
    every = rows.groupBy(key, "_bucket").agg(last.alias("_last"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.last("_last", ignorenulls=True).over(before).alias("_earlier"))
    within = Window.partitionBy(key, "_bucket").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(every, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    return rows.withColumn("as_of", F.coalesce(F.last("_value", ignorenulls=True).over(within), "_earlier")).select(*quoted(df.columns), "as_of")


def sessions(df: DataFrame, key: str, at: str, tie: str, gap: int, bucket: int = DAY) -> DataFrame:
    """df with session: a number from 1 that rises within a key wherever more than `gap` lies between a row and the one
    before it, ordered by the columns `at` (microseconds) and `tie`."""
    rows = df.where(F.col(at).isNotNull()).withColumn("_bucket", F.floor(F.col(at) / bucket))
    within = Window.partitionBy(key, "_bucket").orderBy(at, tie)
    over_key = Window.partitionBy(key).orderBy("_bucket")
    ends = rows.groupBy(key, "_bucket").agg(F.max(at).alias("_end")).withColumn("_before", F.lag("_end").over(over_key))
    ends = ends.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), "_before")
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b"))).drop("_key", "_b")
    previous = F.coalesce(F.lag(at).over(within), F.col("_before"))
    rows = rows.withColumn("_new", (previous.isNull() | (F.col(at) - previous > gap)).cast("long"))
    starts = rows.groupBy(key, "_bucket").agg(F.sum("_new").alias("_starts"))
    starts = starts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), (F.sum("_starts").over(over_key) - F.col("_starts")).alias("_earlier"))
    rows = rows.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b"))).drop("_key", "_b")
    numbered = F.col("_earlier") + F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("session", numbered).select(*quoted(df.columns), "session")
