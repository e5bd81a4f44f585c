"""Tables as Parquet below one folder, read by any path that Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table, or those of its columns that are named; missing columns are an error."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"table {name} in {folder} has no column {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df.select(*columns) if columns else df
