"""The nearest-neighbour join against a comparison of all vectors with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.operators import nearest
from heronry.operators.nearest import nearest_join

SCHEMA = "id long, x array<double>"


def vectors(n, dims, seed, groups=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims)) * 3
    return [(i, [float(v) for v in middles[rng.integers(groups)] + rng.normal(size=dims)]) for i in range(n)]


def brute(queries, rows, k):
    out = set()
    for q, x in queries:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in rows if i != q)
        out |= {(q, n + 1, i) for n, (_, i) in enumerate(near[:k])}
    return out


def found(queries, rows, k, **how):
    got = [(r["query_id"], r["rank"], r["row_id"]) for r in nearest_join(queries, rows, "id", "x", k, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [4096, 5])
def test_exact_equals_all_by_all(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rows = vectors(300, 6, block)
    same = [(1000 + i, rows[3][1]) for i in range(100)]  # one vector that a quarter of the rows share
    frame = spark.createDataFrame(rows + same + rows[:20], SCHEMA).withColumns({"a.b": F.lit(1), "list": F.lit("x"), "v": F.lit(0), "rank": F.lit(2)})
    asked = frame.where("id % 7 = 0")
    want = brute([r for r in rows + same if r[0] % 7 == 0], rows + same, 5)
    assert found(asked, frame, 5, probes=2) == want


def test_odd_rows_take_no_part(spark):
    rows = vectors(40, 3, 1)
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (105, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows + odd, SCHEMA)
    assert found(frame, frame, 4) == brute(rows, rows, 4)
    assert found(frame, frame.limit(0), 4) == set() and found(frame.limit(0), frame, 4) == set()
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert found(few, few, 10) == brute(rows[:3], rows[:3], 10)


def test_recall_without_the_second_visit(spark):
    rows = vectors(3000, 16, 5, groups=40)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = [r for r in rows if r[0] % 50 == 0]
    want = brute(asked, rows, 10)
    got = found(frame.where("id % 50 = 0"), frame, 10, probes=8, exact=False)
    of = lambda pairs: {(q, i) for q, _, i in pairs}
    assert len(of(got) & of(want)) / len(want) >= 0.9
    assert found(frame.where("id % 50 = 0"), frame, 10) == want
