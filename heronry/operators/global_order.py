"""Ranks and running totals over a whole table, without a window that holds it in one partition.

The rows are dealt into ranges of the order and written, so that the ranges stay what they are. Each range's number of rows
and sums come from one aggregation; what lies before a range is the sum over the ranges before it, a table with one row a
range. Within a range a window numbers and adds up its rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.windows import shared_folder

#: Rows of a range, about: a task sorts one range.
RANGE = 1_000_000


def ranked(df: DataFrame, order: list[Column], total: dict[str, Column] | None = None, rows_of_range: int = RANGE) -> DataFrame:
    """df with `row_number` (from 1, over the whole table), and for each of `total` a column of that name: the sum of its
    expression over the rows up to and with each one.

    `order` must leave no ties, or the rows of a tie come in any order among themselves; a value that very many rows share
    is no hot range if further columns part them. Nulls come where the columns of `order` say. Null values add nothing; the
    sum is null until there is a value. Sums have the type that F.sum gives, so decimals stay exact. An empty table gives
    an empty result. Columns of df that have a name of the result's are replaced.
    """
    total = {} if total is None else total
    spark = df.sparkSession
    ranges = max(1, -(-df.count() // rows_of_range))
    part, lead = "_range", "_before"
    names = [c for c in df.columns if c not in ("row_number", *total)]
    values = {f"_value_{k}": column for k, column in enumerate(total.values())}
    place = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    order = [o if isinstance(o, Column) else F.col(o) for o in order]
    dealt = df.withColumns(values).repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id())
    dealt.write.parquet(place)
    rows = spark.read.schema(dealt.schema).parquet(place)

    sums = {f"_sum_{k}": F.sum(f"_value_{k}") for k in range(len(total))}
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n"), *(s.alias(n) for n, s in sums.items()))
    # one row a range: this window may well be in one partition
    earlier = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col(part).alias(lead), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), *(F.sum(n).over(earlier).alias(n) for n in sums))
    own = Window.partitionBy(part).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    found = {"row_number": F.row_number().over(own).cast("long") + F.col("_n")}
    for k, name in enumerate(total):
        inside = F.sum(f"_value_{k}").over(upto)
        found[name] = F.when(inside.isNull() | F.col(f"_sum_{k}").isNull(), F.coalesce(inside, f"_sum_{k}")).otherwise(inside + F.col(f"_sum_{k}"))
    kept = [F.col(_quoted(c)) for c in names]
    joined = rows.join(F.broadcast(before) if ranges <= 100_000 else before, F.col(part) == F.col(lead))
    return joined.select(*kept, *(value.alias(name) for name, value in found.items()))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
