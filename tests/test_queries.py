"""Each relational and streaming query against DuckDB, on the smallest tables."""

import duckdb
import pytest

from heronry.plans import registry

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def _cells(rows):
    def cell(x):
        return float(x) if not isinstance(x, (str, type(None))) else x

    return sorted((tuple(cell(x) for x in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    found = registry.QUERIES[name](spark, sf_dir)
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        wanted = db.sql(registry.ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(wanted.columns)
        columns = sorted(found.columns)
        rows = wanted.select(*(f'"{c}"' for c in columns)).fetchall()
    assert rows
    assert _cells(map(tuple, found.select(*columns).collect())) == _cells(rows)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
