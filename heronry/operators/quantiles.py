"""Exact quantiles of groups, without gathering a group's rows.

The values of each group are counted in BINS cells of equal width between its least and greatest value, and the cell that
holds the wanted place is cut again, until what is left is one value. Each pass is one aggregation with
a partial sum in every task, so a group that holds half of all rows is as many rows as it has cells. A pass cuts a range to
its BINS-th part, so doubles need a handful of passes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.windows import shared_folder

BINS = 1024


def _written(df: DataFrame, what: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, share, n, quantile): for each group and each of `shares` (0 to 1) the least value that has at least that share
    of the group's values up to it (the first value for 0), as a double.

    Nulls and NaN count for nothing; a group without other values gives no rows. Null groups are one group. Ties are counted
    as often as they stand. Values are compared as doubles. An empty table gives an empty result.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    rows = rows.withColumn("v", F.col("v") + 0.0)  # -0 is 0
    ends = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = ends.withColumn("share", F.explode(F.array(*map(F.lit, sorted({float(s) for s in shares})))))
    place = F.greatest(F.ceil(F.round(F.col("share") * F.col("n"), 9)), F.lit(1)).cast("long")
    # before: how many values of the group lie below the cell
    cells = _written(wanted.select("g", "share", "n", place.alias("place"), "low", "high", F.lit(0).cast("long").alias("before")), "cells")
    done = []
    most = F.lit(1.7976931348623157e308)
    low, high = F.greatest(F.col("low"), -most), F.least(F.col("high"), most)
    width = F.greatest(high / BINS - low / BINS, F.lit(5e-324))
    place_in = F.floor(F.col("v") / width - low / width)
    # the least and the greatest value are in different cells, so each pass gets nearer; infinite values have their own
    bin_of = F.when(F.col("v") < -most, -1).when(F.col("v") > most, BINS).otherwise(F.least(F.greatest(place_in, F.lit(0)), F.lit(BINS - 1))).cast("int")
    while True:
        found = _written(cells.where("low = high").select("g", "share", "n", F.col("low").alias("quantile")), "quantiles")
        done.append(found)
        cells = cells.where("low < high")
        if cells.isEmpty():
            break
        # a row a value and cell that it is in: a group has as many cells as shares at most
        cell = F.broadcast(cells.withColumnRenamed("g", "h")) if cells.count() <= 10_000 else cells.withColumnRenamed("g", "h")
        within = rows.join(cell, F.col("g").eqNullSafe(F.col("h")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        counts = within.groupBy("g", "share", "n", "place", "before", "low", "high", bin_of.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        # at most BINS rows a cell: their running sums tell which one has the place
        counted = counts.groupBy("g", "share", "n", "place", "before").agg(F.sort_array(F.collect_list(F.struct("bin", "c", "least", "most"))).alias("bins"))
        start = F.struct(F.col("before").alias("upto"), F.lit(None).cast("struct<least:double,most:double,before:bigint>").alias("cell"))

        def step(state, b):
            here = state["cell"].isNull() & (state["upto"] + b["c"] >= F.col("place"))
            cell = F.when(here, F.struct(b["least"].alias("least"), b["most"].alias("most"), state["upto"].alias("before"))).otherwise(state["cell"])
            return F.struct((state["upto"] + b["c"]).alias("upto"), cell.alias("cell"))

        hit = F.aggregate("bins", start, step, lambda s: s["cell"])
        cells = _written(counted.select("g", "share", "n", "place", hit.alias("hit")).select("g", "share", "n", "place", F.col("hit.least").alias("low"), F.col("hit.most").alias("high"), F.col("hit.before").alias("before")), "cells")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("g").alias(group), "share", "n", "quantile")
