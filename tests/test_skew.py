"""Exact quantiles and joins where one key holds half of all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from heronry.operators import quantiles
from heronry.operators.quantiles import exact_quantiles
from heronry.operators.skewed_join import heavy_keys, skewed_join

SHARES = [0.0, 0.1, 0.5, 0.99, 1.0]


@pytest.mark.parametrize("bins", [1024, 3])
def test_quantiles_equal_sorted_lists(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(bins)
    make = [lambda: rng.gauss(0, 1), lambda: float(rng.randrange(4)), lambda: 10 ** rng.uniform(-9, 9), lambda: 7.25, lambda: -rng.random() * 1e-12]
    rows = [(1 if rng.random() < 0.5 else k % 5, make[k % 5]()) for k in range(700)]
    rows += [(None, 3.0), (None, 1.0), (8, None), (8, float("nan")), (9, -0.0), (9, 0.0), (10, 1e300), (10, -1e300), (10, 5e-324)]
    rows += [(11, float("inf")), (11, float("-inf")), (11, 1.0), (11, 1.0000000000000002), (12, 1.7e308), (12, -1.7e308), (12, float("inf")), (13, float("inf"))]
    got = {(r["k"], r["share"]): (r["n"], r["quantile"]) for r in exact_quantiles(spark.createDataFrame(rows, "k long, x double"), "k", "x", SHARES).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        values = sorted(x for j, x in rows if j == k and x is not None and x == x)
        want |= {(k, s): (len(values), values[max(0, math.ceil(round(s * len(values), 9)) - 1)]) for s in SHARES if values}
    assert got == want


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "k long, x double"), "k", "x", SHARES).collect() == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("most", [20, 10**6])
def test_skewed_join_equals_the_plain_one(spark, how, most):
    rng = random.Random(1)
    left = [(rng.choice([7, 7, rng.randrange(30), None]), n) for n in range(400)] + [(7, 5), (7, 5)]
    right = [(k, 100 * k + c) for k in range(0, 30, 2) for c in range(k % 3)] + [(7, 1), (7, 1), (None, 3)]
    a, b = spark.createDataFrame(left, "k long, x long").withColumns({"a.b": F.lit(1)}), spark.createDataFrame(right, "k long, y long")
    got = skewed_join(a, b, "k", how, most)
    assert sorted(got.columns) == sorted(a.join(b, "k", how).columns)
    columns = ["k", "x", *(["y"] if how in ("inner", "left") else [])]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, a.join(b, "k", how).select(columns).collect()))


def test_no_group_has_a_heavy_key_whole(spark):
    a = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    b = spark.range(4000).select(F.col("id").alias("k"), (2 * F.col("id")).alias("y"))
    assert [tuple(r) for r in heavy_keys(a, "k", 100).collect()] == [(7, 21)]
    salted = skewed_join(a, b, "k", most=100)
    assert salted.where("k = 7").count() == 2001 and salted.count() == 4000
    sizes = a.where("k = 7").groupBy(F.pmod(F.xxhash64("k", "x"), F.lit(21))).count().agg(F.max("count")).first()[0]
    assert sizes < 150
    with pytest.raises(ValueError):
        skewed_join(a, b, "k", "full")
