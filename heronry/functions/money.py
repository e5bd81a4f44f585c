"""Sums of money that don't depend on the order of addition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(value: Column, scale: int = 4) -> Column:
    """The sum of amounts, each rounded to `scale` decimals, as decimal(28, scale)."""
    return F.sum(value.cast(f"decimal(18,{scale})")).cast(f"decimal(28,{scale})")
