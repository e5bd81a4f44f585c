"""Upkeep of an aggregate under batches of new, corrected and removed rows, without reading everything anew.

Each batch leaves two small tables: the rows that it changed, and what it changes in each group's count and sum (the new
rows' share less that of the rows they replace, which are looked up by id). A batch counts from the moment that its marker
is there, which is written last: readers see all of it or nothing, and a batch that failed is applied again from the start.
A batch that counts already is passed over, so a retry changes nothing. Every TOGETHER batches, the tables are put together
into one row an id and one a group, under a marker of their own, and the batches before the last such step are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOGETHER = 8
#: Changed ids of a batch that are broadcast to find the rows they replace, at most.
MOST_IDS = 500_000


class KeptTotals:
    """Count and sum by group of the latest row of each id, kept in `folder`, which all executors must share. One writer at
    a time; any number of readers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.hadoop.Path("/".join((self.folder, *parts)))

    def _versions(self) -> tuple[int, list[int]]:
        """The last batch that is put together (-1: none) and those after it that count."""
        root = self.hadoop.Path(self.folder)
        names = [s.getPath().getName() for s in self.files.listStatus(root)] if self.files.exists(root) else []
        done = [n for n in names if self.files.exists(self._path(n, "_DONE"))]
        upto = max((int(n[5:]) for n in done if n.startswith("upto=")), default=-1)
        return upto, sorted(b for n in done if n.startswith("batch=") and (b := int(n[6:])) > upto)

    def _read(self, table: str) -> DataFrame | None:
        upto, batches = self._versions()
        places = [f"upto={upto}"] * (upto >= 0) + [f"batch={b}" for b in batches]
        out = None
        for place in places:  # 2 * TOGETHER at most
            rows = self.spark.read.parquet(f"{self.folder}/{place}/{table}")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _latest(self) -> DataFrame | None:
        rows = self._read("rows")
        return None if rows is None else rows.groupBy("id").agg(F.max_by(F.struct("batch", "group", "value", "gone"), "batch").alias("row")).select("id", "row.*")

    def totals(self) -> DataFrame:
        """(group, n, total) of all batches that count; groups without rows are left out. Null values add nothing."""
        deltas = self._read("totals")
        if deltas is None:
            raise ValueError(f"no batch has been applied in {self.folder}")
        return deltas.groupBy("group").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n <> 0")

    def apply(self, batch: int, changes: DataFrame, key: str, group: str, value: Column, order: Column, gone: Column | None = None) -> bool:
        """Takes in a batch, numbered upwards; False if it counts already. Of its rows with one `key` the last by `order`
        holds (without ties); it replaces the key's row of earlier batches, or removes it where `gone`. `value` should be a
        decimal or a whole number, so that what is taken away is what was added. Rows with a null key are left out."""
        upto, batches = self._versions()
        if batch <= max([upto, *batches]):
            return False
        rows = changes.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(group).alias("group"), value.alias("value"), (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"), order.alias("o"))
        rows = rows.groupBy("id").agg(F.max_by(F.struct("group", "value", "gone"), "o").alias("row")).select("id", "row.*", F.lit(batch).cast("long").alias("batch"))
        place = f"{self.folder}/batch={batch}"
        rows.write.mode("overwrite").parquet(f"{place}/rows")
        rows = self.spark.read.parquet(f"{place}/rows")
        one = F.when(F.col("gone"), 0).otherwise(1).cast("long")
        some = F.when(~F.col("gone"), F.col("value"))
        parts = rows.select("group", one.alias("n"), some.alias("total"))
        before = self._latest_of(rows.select("id"))
        if before is not None:
            parts = parts.unionByName(before.select("group", (-one).alias("n"), (-some).alias("total")))
        kind = self._read("totals").schema["total"].dataType if before is not None else None
        deltas = parts.groupBy("group").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        deltas = deltas if kind is None else deltas.withColumn("total", F.col("total").cast(kind))
        deltas.write.mode("overwrite").parquet(f"{place}/totals")
        self.files.create(self._path(f"batch={batch}", "_DONE"), True).close()
        if len(self._versions()[1]) >= TOGETHER:
            self._put_together()
        return True

    def _latest_of(self, ids: DataFrame) -> DataFrame | None:
        """The latest earlier rows of some ids."""
        rows = self._read("rows")
        if rows is None:
            return None
        found = rows.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "id", "left_semi")
        return found.groupBy("id").agg(F.max_by(F.struct("group", "value", "gone"), "batch").alias("row")).select("row.*")

    def _put_together(self) -> None:
        old, batches = self._versions()
        last = batches[-1]
        kind = self._read("totals").schema["total"].dataType
        self._latest().where("not gone").write.mode("overwrite").parquet(f"{self.folder}/upto={last}/rows")
        self.totals().withColumn("total", F.col("total").cast(kind)).write.mode("overwrite").parquet(f"{self.folder}/upto={last}/totals")
        self.files.create(self._path(f"upto={last}", "_DONE"), True).close()
        for status in self.files.listStatus(self.hadoop.Path(self.folder)):  # readers may still have the step before this one's batches open
            name, _, number = status.getPath().getName().partition("=")
            if (name == "upto" and int(number) < old) or (name == "batch" and int(number) <= old):
                self.files.delete(status.getPath(), True)
