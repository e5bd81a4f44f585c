"""The first rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """df with rank (1 to k): the first k rows of each group by an order without ties. Spark keeps k rows a group on each
    side of the shuffle, as the rank is limited right above the window."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
