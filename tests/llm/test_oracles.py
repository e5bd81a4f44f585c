"""The queries that SQL can express, on the smallest tables, and the shape of all of them."""

import duckdb
import pytest

from heronry.llm import queries

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    found = queries.queries()[name](spark, sf_dir)
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        wanted = db.sql(queries.oracle_sql()[name])
        assert sorted(found.columns) == sorted(wanted.columns)
        rows = wanted.select(*(f'"{c}"' for c in found.columns)).fetchall()
    assert rows and sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
