"""Points within intervals, and places over a whole table, against plain Python."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from heronry.operators.global_order import ranked
from heronry.operators.intervals import interval_join


def met(points, spans, width):
    df = interval_join(points, spans, "k", F.col("at"), F.col("low"), F.col("high"), width)
    assert "Cartesian" not in df._jdf.queryExecution().executedPlan().toString() and "BroadcastNestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    return sorted(tuple(r) for r in df.select("k", "p", "s").collect())


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_pairs_equal_all_by_all(spark, width):
    rng = random.Random(width)
    # one key holds half of the rows; times before zero, intervals of no length, that overlap, and that end before they start
    key = lambda: rng.choice([1, rng.randrange(2, 6)])
    points = [(key(), rng.randrange(-60, 60), n) for n in range(150)] + [(None, 3, 900), (1, None, 901), (1, 5, 902), (1, 5, 902)]
    spans = [(key(), low := rng.randrange(-60, 60), low + rng.randrange(-2, 30), n) for n in range(80)] + [(None, 0, 9, 900), (1, None, 9, 901), (1, 0, None, 902), (1, 5, 5, 903)]
    want = sorted((k, p, s) for k, at, p in points for j, low, high, s in spans if None not in (k, at, low, high) and k == j and low <= at <= high)
    got = met(spark.createDataFrame(points, "k long, at long, p long"), spark.createDataFrame(spans, "k long, low long, high long, s long"), width)
    assert got == want and got


def test_a_hot_key_is_spread(spark):
    points = spark.range(20_000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("at"), F.col("id").alias("p"))
    spans = spark.range(2000).select(F.lit(1).cast("long").alias("k"), (10 * F.col("id")).alias("low"), (10 * F.col("id") + 14).alias("high"), F.col("id").alias("s"))
    df = interval_join(points, spans, "k", F.col("at"), F.col("low"), F.col("high"), 100)
    rows = df.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert sum(r["count"] for r in rows) == 2000 * 15 - 5
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and df.count() == 2000 * 15 - 5


def test_no_rows(spark):
    none = spark.createDataFrame([], "k long, at long, p long"), spark.createDataFrame([], "k long, low long, high long, s long")
    assert met(*none, 5) == []


@pytest.mark.parametrize("rows_of_range", [1_000_000, 40])
def test_places_and_totals_equal_one_loop(spark, rows_of_range):
    rng = random.Random(2)
    # a third of the rows share one value, and some have none
    rows = [(n, rng.choice([7, 7, rng.randrange(50), None, -3]), rng.choice([Decimal(rng.randrange(-500, 500)) / 100, None])) for n in range(300)]
    df = spark.createDataFrame(rows, "id long, x long, v decimal(10,2)").repartition(5)
    df = df.withColumns({"row_number": F.lit("old"), "a.b": F.lit(1), "_range": F.lit(2)}).drop("_range")
    found = ranked(df, [F.desc_nulls_first("x"), F.asc("id")], {"upto": F.col("v"), "n_upto": F.lit(1)}, rows_of_range)
    assert found.columns == ["id", "x", "v", "a.b", "row_number", "upto", "n_upto"]
    want, total = [], None
    for n, (i, x, v) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0])), 1):
        total = total if v is None else v + (total or 0)
        want.append((i, x, v, n, total, n))
    got = sorted(map(tuple, found.select("id", "x", "v", "row_number", "upto", "n_upto").collect()), key=lambda r: r[3])
    assert got == want


def test_no_task_holds_the_whole_table(spark):
    df = spark.range(4000).select("id", (F.col("id") % 3).alias("x"))
    found = ranked(df, ["x", "id"], rows_of_range=500)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number" in line]
    assert windows and all("_range" in line for line in windows)
    assert ranked(df.limit(0), ["x"], {"t": F.col("x")}).collect() == []
    assert ranked(df, ["x", "id"]).agg(F.sum("row_number")).first()[0] == 4000 * 4001 // 2
