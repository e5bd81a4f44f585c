"""Bucketed windows against plain loops: bucket edges, ties, nulls, one hot key, and no rows."""

import random

from pyspark.sql import functions as F

from heronry.operators import timelines
from heronry.operators.ranking import top_k
from heronry.sources.tables import table

SCHEMA = "key string, at long, id long, v long"


def _rows():
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randrange(0, 400), i, rng.choice([None, i])) for i in range(300)]
    return rows + [(None, 5, 1000, 7), (None, 205, 1001, None), ("a", None, 1002, 1)]


def test_as_of(spark):
    rows = _rows()
    found = timelines.as_of(spark.createDataFrame(rows, SCHEMA), "key", "at", "id", F.col("v"), bucket=50)
    last, wanted = {}, {}
    for key, at, i, v in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        last[key] = v if v is not None else last.get(key)
        wanted[i] = last[key]
    assert {r["id"]: r["as_of"] for r in found.collect()} == wanted


def test_sessions(spark):
    rows = _rows()
    found = timelines.sessions(spark.createDataFrame(rows, SCHEMA), "key", "at", "id", gap=7, bucket=50)
    before, number, wanted = {}, {}, {}
    for key, at, i, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if key not in before or at - before[key] > 7:
            number[key] = number.get(key, 0) + 1
        before[key] = at
        wanted[i] = number[key]
    assert {r["id"]: r["session"] for r in found.collect()} == wanted


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert timelines.as_of(none, "key", "at", "id", F.col("v")).count() == 0
    assert timelines.sessions(none, "key", "at", "id", 7).count() == 0


def test_top_k_has_one_order(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 9), ("b", 4, 1)], "g string, id long, v long")
    found = top_k(df, "g", [F.desc("v"), F.asc("id")], 2).select("g", "id", "rank").collect()
    assert sorted(map(tuple, found)) == [("a", 1, 2), ("a", 3, 1), ("b", 4, 1)]


def test_missing_column_is_named(spark, sf_dir):
    try:
        table(spark, sf_dir, "region", "r_nothing")
    except ValueError as e:
        assert "r_nothing" in str(e)
    else:
        raise AssertionError
