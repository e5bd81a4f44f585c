"""A kept aggregate against the aggregate computed anew, after every batch, failures and retries included."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from heronry.operators import upkeep
from heronry.operators.upkeep import KeptTotals

SCHEMA = "id long, g string, v decimal(12,2), at long, gone boolean"


def computed(state):
    out = {}
    for g, v in state.values():
        n, total = out.get(g, (0, None))
        out[g] = (n + 1, total if v is None else v + (total or 0))
    return {(g, n, total or 0) for g, (n, total) in out.items()}


def kept_rows(kept):
    return {(r["group"], r["n"], r["total"] or 0) for r in kept.totals().collect()}


@pytest.mark.parametrize("together", [8, 2])
def test_equals_the_aggregate_computed_anew(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(upkeep, "TOGETHER", together)
    monkeypatch.setattr(upkeep, "MOST_IDS", 500_000 if together == 8 else 0)
    rng, state = random.Random(together), {}
    kept = KeptTotals(spark, f"file://{tmp_path}/kept")
    with pytest.raises(ValueError):
        kept.totals()

    def apply(n, rows):
        df = spark.createDataFrame(rows, SCHEMA)
        return kept.apply(n, df, "id", "g", F.col("v"), F.col("at"), F.col("gone"))

    for n in range(6):
        rows = []
        for at in range(60):  # ids come again within the batch; groups change; half of all rows are one group's
            value = rng.choice([None, Decimal(rng.randrange(-999, 999)) / 100])
            rows.append((rng.randrange(80), rng.choice(["hot", rng.choice("abc"), None]), value, at, rng.choice([True, False, False, None])))
        rows.append((None, "a", Decimal(1), 99, False))
        if n == 3:  # a batch that failed before its marker was written, with other rows
            spark.createDataFrame([(1, "x", Decimal(5), False, 3)], "id long, group string, value decimal(12,2), gone boolean, batch long").write.parquet(f"{tmp_path}/kept/batch=3/rows")
            assert kept_rows(kept) == computed(state)
        assert apply(n, rows)
        for i, g, v, _, gone in rows:
            if i is not None:
                state.pop(i, None)
                if not gone:
                    state[i] = (g, v)
        assert kept_rows(kept) == computed(state)
        assert not apply(n, rows[:10]) and kept_rows(kept) == computed(state)  # a retry changes nothing
    if together == 2:
        assert len([p for p in (tmp_path / "kept").iterdir() if p.name.startswith("batch=")]) <= 4
    assert kept_rows(KeptTotals(spark, f"file://{tmp_path}/kept")) == computed(state)  # another reader
    assert apply(9, []) and kept_rows(kept) == computed(state)
