"""Sequences of events against a loop over all rows of each key."""

import random

import pytest
from pyspark.sql import functions as F

from heronry.operators.sequences import sequences

SCHEMA = "k long, at long, id long, kind string"


def brute(rows, within):
    out, by_key = set(), {}
    for k, at, i, kind in rows:
        if at is not None:
            by_key.setdefault(k, []).append((at, i, kind))
    for k, line in by_key.items():
        line.sort()
        for e, (at, i, kind) in enumerate(line):
            if kind != "c":
                continue
            fits = [a for a in range(e) if line[a][2] == "a" and at - line[a][0] <= within and any(x[2] == "b" for x in line[a + 1 : e]) and all(x[2] != "stop" for x in line[a + 1 : e])]
            if fits:
                out.add((k, i, line[max(fits)][1]))
    return out


@pytest.mark.parametrize("bucket", [5, 1000])
def test_equals_a_loop(spark, bucket):
    rng = random.Random(bucket)
    # one key holds half of the rows; times that tie are told apart by the id
    rows = [(rng.choice([1, rng.randrange(2, 6), None]), rng.randrange(-40, 80), n, rng.choice(["a", "b", "c", "stop", "other"])) for n in range(260)]
    rows += [(1, None, 900, "c"), (1, 10, 901, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("a.b", F.lit(1))
    steps = [F.col("kind") == s for s in "abc"]
    found = sequences(df, "k", "at", "id", steps, 25, F.col("kind") == "stop", bucket)
    assert found.columns == ["k", "at", "id", "kind", "a.b", "began_at", "began_tie"]
    got = [(r["k"], r["id"], r["began_tie"]) for r in found.collect()]
    assert set(got) == brute(rows, 25) and len(got) == len(set(got)) > 5
    assert sequences(df.limit(0), "k", "at", "id", steps, 25).collect() == []
