"""What the corpus jobs share: tables in the shared folder, words, hashes and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class for regular expressions.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
#: The same characters one by one, for translate().
GAP_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share, or else the one that the session was given by
    setCheckpointDir(). Where there is neither, a local session, as in tests, gets a new folder of this machine; a cluster
    gets an error, as its executors wouldn't see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or getattr(spark, "_heronry_shared", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark._heronry_shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/heronry-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, survives lost executors and is read as often as needed."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the table that written() made, once nothing needs it."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if "/heronry-" in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows, such as whole texts, that a task hands to Python at once within small_batches().
BATCH_ROWS = 500


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_ROWS) -> Iterator[None]:
    """What runs meanwhile hands at most `most` rows at once to Python; the session's setting comes back after it. A batch is
    held by the executor and by the worker, each with room to grow, and 10,000 whole texts are tens of MB there."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def quoted(names: str | list[str]) -> str | list[str]:
    """Column names as they must be written where a dot would mean a field."""
    return "`" + names.replace("`", "``") + "`" if isinstance(names, str) else [quoted(n) for n in names]


#: Ids that without_ids() broadcasts, at most; about 40 bytes each.
MOST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id isn't among `ids` (one column, doc_id). The ids are written first, so
    that their number is known: up to MOST_IDS they are broadcast and the rows of docs stay where they are; beyond it they
    are left to Spark, which shuffles both sides. Rows with a null doc_id stay."""
    ids = written(ids.where("doc_id is not null").distinct(), "ids")
    few = ids.count() <= MOST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(quoted(docs.columns))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for words seen before; it starts anew at `most` words, so memory is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of a public hash function)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Twice the bits of an id: more rounds than any links between long ids need.
MOST_ROUNDS = 128


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links a-b (long ids) as (node, component): the smallest id that can be reached.

    Each round every node takes its smallest neighbour as parent, parents are followed to the root (each step doubles
    the way), and the links are redrawn between roots; loops and repeats go. A root that still has no smaller neighbour
    after a round has taken in all its neighbours, so two rounds leave at most half of the nodes that had links: no order
    of ids takes more than 2 log n rounds, whatever the shape. Nulls and self-links are ignored. All of it is joins and
    aggregates over tables; nothing but whether a table is empty comes to the driver. Hub nodes are only ever aggregated
    with a partial min, or stand on the side of a join that adaptive execution can split.
    """
    left = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    left = written(left, "links")
    labels = None
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        up = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))  # roots are those without a row
        moved, old = True, None
        while moved:  # parents are smaller than their nodes, so there is an end
            for _ in range(2):
                over = up.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
                up = up.join(over, "parent", "left").select("node", F.coalesce("over", "parent").alias("parent"), F.col("over").isNotNull().alias("moved"))
            up = written(up, "parents")
            if old is not None:
                drop_written(old)
            moved, old = not up.where("moved").isEmpty(), up
        ends = left
        for end in ("a", "b"):
            to = up.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_up"))
            ends = ends.join(to, end, "left").withColumn(end, F.coalesce(f"{end}_up", end)).drop(f"{end}_up")
        after = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
        if labels is None:
            now = up.select("node", F.col("parent").alias("component"))
        else:
            to = up.select(F.col("node").alias("component"), F.col("parent").alias("over"))
            now = labels.join(to, "component", "left").select("node", F.coalesce("over", "component").alias("component"))
            now = now.unionByName(up.select("node", F.col("parent").alias("component")).join(labels.select("node"), "node", "left_anti"))
        now = written(now, "labels")
        for old in (left, labels):
            if old is not None:
                drop_written(old)
        left, labels = after, now
    else:
        if not left.isEmpty():
            raise RuntimeError(f"links are left after {MOST_ROUNDS} rounds")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(roots.join(labels.select("node"), "node", "left_anti"))
