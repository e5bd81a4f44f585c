"""Every query of the relational and streaming part, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming import alerts, joins, windows
from . import events, star, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (star, events, vectors, windows, alerts, joins):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
