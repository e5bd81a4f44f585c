"""Queries on the embedding table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nearest import nearest_join
from ..sources.tables import table


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of each whose id is divisible by 50, among all."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest_join(rows.where(F.col("vec_id") % 50 == 0), rows, "vec_id", "embedding", 10).select("query_id", "rank", "row_id")


QUERIES = {"nearest_vectors": nearest_vectors}
ORACLE_SQL = {
    "nearest_vectors": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
        SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, r.vec_id AS row_id
        FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
        WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_distance(q.e, r.e), r.vec_id)
        QUALIFY row_number() OVER w <= 10""",
}
