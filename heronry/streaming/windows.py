"""Event windows and sessions over a stream of files.

Windows and sessions close once the latest event of a batch is LATENESS beyond their end. Events that arrive in a later batch
for what is closed are left out, and of events with one event_id that arrive within LATENESS the first alone counts. Rows
with a null time belong to no window.

A stream runs over what is there and ends (run_available, run_updates). Under a name it is continued by the next call.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.money import exact_sum

WINDOW, LATENESS = "1 day", "10 minutes"
#: Sessions end before a gap of more than this; an event exactly that much later still belongs to one.
GAP = "12 hours"


def _once(events: DataFrame) -> DataFrame:
    if events.isStreaming:
        return events.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def daily_types(events: DataFrame) -> DataFrame:
    """A stream or table with ts (timestamp), event_id, event_type and value: events and their value by day and type, each
    event_id once within the lateness. From a stream, run_available() gives the windows that are closed, run_updates() all."""
    rows = _once(events).groupBy(F.window("ts", WINDOW).alias("w"), "event_type")
    rows = rows.agg(F.count("*").alias("n_events"), exact_sum(F.col("value"), 2).alias("value"))
    return rows.select(F.unix_micros("w.start").alias("from_at"), "event_type", "n_events", "value")


def user_sessions(events: DataFrame) -> DataFrame:
    """A stream or table with ts, event_id, user_id and value: the sessions of users with their events and value. A session
    comes out of a stream once no event that isn't late could still join it; until then its state is one row."""
    rows = _once(events.where("ts is not null")).groupBy(F.session_window("ts", GAP).alias("w"), "user_id")
    rows = rows.agg(F.max("ts").alias("last"), F.count("*").alias("n_events"), exact_sum(F.col("value"), 2).alias("value"))
    return rows.select("user_id", F.unix_micros("w.start").alias("first_at"), F.unix_micros("last").alias("last_at"), "n_events", "value")


#: Batches of run_updates() that are kept one by one before they are put together.
TOGETHER = 16


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The given folder, which all executors must share, or the session's spark.checkpoint.dir, or that of
    setCheckpointDir(); where there is none, one of this machine for a local session, as in tests, and an error on a cluster,
    whose executors wouldn't see each other's files."""
    base = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or getattr(spark, "_heronry_streams", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark._heronry_streams = "file://" + tempfile.mkdtemp(prefix="spark-")
    return base.rstrip("/")


def _place(spark: SparkSession, folder: str | None, name: str | None) -> str:
    """Where a stream keeps its checkpoint and rows: that of its name, which the next call with it continues, or a new one."""
    return f"{shared_folder(spark, folder)}/stream-{name or uuid.uuid4().hex}"


def run_available(stream: DataFrame, folder: str | None = None, name: str | None = None) -> DataFrame:
    """Takes what is there into a Parquet sink, exactly once, and reads it: rows that are final.

    With a name the stream goes on where the last call with this name (and folder) ended, even in another session: it reads
    only what has arrived since, keeps its state, and the result has the rows of all calls. A call that fails is made good
    by the next. For the folder see shared_folder().
    """
    place = _place(stream.sparkSession, folder, name)
    sink = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state")
    sink.trigger(availableNow=True).start(f"{place}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")


def _kept_batches(spark: SparkSession, place: str) -> tuple[int, list[int]]:
    """The last batch whose rows are put together (-1: none) and those after it. A folder counts once its job has ended."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{place}/rows")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in files.listStatus(root)] if files.exists(root) else []
    done = [p.getName() for p in names if files.exists(hadoop.Path(p, "_SUCCESS"))]
    upto = max((int(n[5:]) for n in done if n.startswith("upto=")), default=-1)
    return upto, sorted(b for n in done if n.startswith("batch=") and (b := int(n[6:])) > upto)


def _latest(spark: SparkSession, place: str, schema: StructType, keys: list[str | Column], last: int | None = None) -> DataFrame:
    """The latest row of each key, up to batch `last`, with its batch."""
    upto, batches = _kept_batches(spark, place)
    whole = StructType([*schema, StructField("batch", LongType())])
    rows = spark.createDataFrame([], whole)
    if upto >= 0:
        rows = spark.read.schema(whole).parquet(f"{place}/rows/upto={upto}")
    for batch in batches:  # fewer than 2 * TOGETHER
        if last is None or batch <= last:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{place}/rows/batch={batch}").withColumn("batch", F.lit(batch).cast("long")))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*whole.names), "batch").alias("latest")).select("latest.*")


def run_updates(stream: DataFrame, keys: list[str | Column], folder: str | None = None, name: str | None = None) -> DataFrame:
    """Takes what is there, and gives the latest row of each key: groups that are still open too. With a name it goes on
    where the last call ended, as run_available() does.

    Each batch writes the rows that it changed to a folder of its own, so that a batch that is run again after a failure
    replaces what it wrote. Every TOGETHER batches, what is kept is put together into a row a key, in a new folder that
    counts once it is complete; the batches before it are deleted one such step later. So reading doesn't grow with the
    number of batches.
    """
    spark, place = stream.sparkSession, _place(stream.sparkSession, folder, name)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/rows/batch={batch}")
        upto, batches = _kept_batches(spark, place)
        if len(batches) >= TOGETHER:
            _latest(spark, place, stream.schema, keys, batch).write.mode("overwrite").parquet(f"{place}/rows/upto={batch}")
            hadoop = spark._jvm.org.apache.hadoop.fs
            root = hadoop.Path(f"{place}/rows")
            files = root.getFileSystem(spark._jsc.hadoopConfiguration())
            for status in files.listStatus(root):  # what the step before had put together, and its parts
                kind, _, number = status.getPath().getName().partition("=")
                if kind in ("batch", "upto") and (int(number) < upto or (kind == "batch" and int(number) == upto)):
                    files.delete(status.getPath(), True)

    sink = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{place}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return _latest(spark, place, stream.schema, keys).drop("batch")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # by a pattern: a stream takes a plain path for a folder, and the table may be a single file
    return spark.readStream.schema(schema).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))


def streamed_daily_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_types() over the event table, read as a stream of files: closed windows."""
    return run_available(daily_types(event_stream(spark, sf_dir)))


def streamed_daily_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_types() over the event table, read as a stream of files: all windows, as they stand at the end of what is there."""
    return run_updates(daily_types(event_stream(spark, sf_dir)), ["from_at", "event_type"])


def streamed_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_sessions() over the event table, read as a stream of files: closed sessions."""
    return run_available(user_sessions(event_stream(spark, sf_dir)))


def resumed_daily_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_types() over the event table that arrives in two halves, by a named stream that is called after each: the
    second call continues the first one's state."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = f"resumed-{uuid.uuid4().hex}"
    arrived = f"{shared_folder(spark)}/arrived-{name}"
    half = events.agg(((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 2).cast("long").alias("at")).first()["at"]
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= F.lit(half)
    for n, part in enumerate((events.where(early | F.col("ts").isNull()), events.where(~early))):
        part.write.parquet(f"{arrived}/part={n}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(arrived)
        found = run_available(daily_types(stream.withColumn("ts", F.col("ts").cast("timestamp"))), name=name)
    return found


QUERIES = {f.__name__: f for f in (streamed_daily_types, streamed_daily_updates, streamed_user_sessions, resumed_daily_types)}
_VALUE = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value"
ORACLE_SQL = {
    "streamed_daily_types": f"""
        SELECT from_at, event_type, count(*) AS n_events, {_VALUE}
        FROM (SELECT *, 86400000000 * (epoch_us(ts) // 86400000000) AS from_at FROM events)
        WHERE from_at + 86400000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)
        GROUP BY from_at, event_type""",
    "streamed_daily_updates": f"""
        SELECT 86400000000 * (epoch_us(ts) // 86400000000) AS from_at, event_type, count(*) AS n_events, {_VALUE}
        FROM events GROUP BY ALL""",
    "streamed_user_sessions": f"""
        SELECT user_id, min(micros) AS first_at, max(micros) AS last_at, count(*) AS n_events, {_VALUE}
        FROM (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY micros, event_id) AS session
              FROM (SELECT *, epoch_us(ts) AS micros,
                           CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 43200000000 THEN 0 ELSE 1 END AS starts
                    FROM events))
        GROUP BY user_id, session
        HAVING max(micros) + 43200000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)""",
}
ORACLE_SQL["resumed_daily_types"] = ORACLE_SQL["streamed_daily_types"]
