"""WARC archives written from and read into tables of chunks.

A payload larger than a chunk travels as rows of (record, chunk number): no step after the source, which has a payload as
one value of a row, holds a whole record. The writer streams the chunks of its partition into compressed archives, a gzip
member a record, and carries a digest along, which must come out as the header's; the reader streams an archive block by
block and gives a row a chunk, with the length and the SHA-1 digest of the payload so far. The row of a record's last chunk
so carries those of the whole payload. Payloads stay where the source has them: what refers to what is found from digests,
and meets the pages in a broadcast of at most MOST_REVISITS rows; of more, it is written by partition of the source, and each task reads its own
part. Should a partition not have the rows that it had before (a source that deals its rows anew each time), what is
written doesn't count and chunk rows are shuffled to what they refer to, never records.

Of records with equal payloads of at least LEAST_REVISITED bytes, that with the largest page_id is stored (response); the
others refer to it (revisit). Equality is that of SHA-1 digest and length. A revisit is read back only if the response that
it refers to is there with that digest and length.

What is defined for odd input:
- A null html is an empty payload, a null url an empty one. Line breaks in a url are left out of its header.
- Repeated rows are written as often as they stand there; equal rows that have the largest id are all responses. Rows with
  a null id are responses, and their id is read back as null.
- Payloads of any length are written and read in chunks; ties in page_id are repeated rows. Other columns are not read. An empty table gives archives without records, and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import new_path, written

CHUNK, LEAST_REVISITED, MOST_ARCHIVE = 1 << 16, 1000, 1 << 30
#: Revisits that are broadcast, at most; about 120 bytes each.
MOST_REVISITS = 500_000
# Fixed values of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives made from tables say when the table was made, not when it was written; tables here don't know it.
DATE = "1970-01-01T00:00:00Z"
_ID = "<urn:x-page:{}>"


_PAYLOAD = ["page_id", "digest", "payload_bytes"]


def _rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest) of each row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})


def revisits(pages: DataFrame, least_revisited: int = LEAST_REVISITED) -> DataFrame:
    """(page_id, digest, payload_bytes, refers_to) of the pages whose payload another one stores. Only digests move."""
    large = _rows(pages).where(F.col("payload_bytes") >= least_revisited).select(_PAYLOAD)
    stored = large.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return large.join(stored, ["digest", "payload_bytes"]).where("page_id < refers_to").select(*_PAYLOAD, "refers_to").distinct()


def _cut(rows: DataFrame, chunk: int, stored: Column) -> DataFrame:
    """Rows with a payload as one row a chunk; where not `stored`, one row without data."""
    last = F.when(stored, F.floor(F.greatest(F.octet_length("payload") - 1, F.lit(0)) / chunk)).otherwise(0).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    data = F.when(stored, F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return rows.withColumn("data", data).drop("payload")


def chunked(pages: DataFrame, chunk: int = CHUNK, least_revisited: int = LEAST_REVISITED, again: DataFrame | None = None) -> DataFrame:
    """(record, chunk_no, page_id, url, payload_bytes, digest, refers_to, data): the rows of a record follow each other in
    their partition. Revisits, which have refers_to, are one row without data; `again` is their table, if there is one."""
    again = written(revisits(pages, least_revisited), "revisits") if again is None else again
    rows = _rows(pages).withColumn("record", F.monotonically_increasing_id())
    if again.count() <= MOST_REVISITS:
        rows = rows.join(F.broadcast(again), _PAYLOAD, "left")
        rows = _cut(rows, chunk, F.col("refers_to").isNull())
    else:
        rows = _cut(rows, chunk, F.lit(True)).join(again, _PAYLOAD, "left").where("refers_to is null or chunk_no = 0")
        rows = rows.withColumn("data", F.when(F.col("refers_to").isNull(), F.col("data")).otherwise(F.lit(b"")))
        rows = rows.repartition("record").sortWithinPartitions("record", "chunk_no")
    return rows.select("record", "chunk_no", "page_id", "url", "payload_bytes", "digest", "refers_to", "data")


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path with scheme (of a shared disk, HDFS or an object store), and the path there."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)  # Spark's names of the same store
    return pa.fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", uri))


def _header(row: dict) -> bytes:
    """The record's header and the head of its HTTP message."""
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    url = re.sub(r"[\r\n]+", "", row["url"])
    kind = "revisit" if revisit else "response"
    lines = [VERSION, f"WARC-Type: {kind}", "WARC-Record-ID: " + _ID.format(row["page_id"]), f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", "WARC-Refers-To: " + _ID.format(row["refers_to"])]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class Packer:
    """Packs chunk rows, in order, into a stream: a gzip member a record. It holds a chunk at a time."""

    def __init__(self):
        self.member = self.row = None

    def add(self, row: dict, out) -> None:
        if row["chunk_no"] == 0:
            self.end(out)
            self.member, self.so_far, self.row, self.seen = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1(), row, 0
            out.write(self.member.compress(_header(row)))
        self.so_far.update(row["data"])
        self.seen += len(row["data"])
        out.write(self.member.compress(row["data"]))

    def end(self, out) -> None:
        """Ends the record that is open, if any, whose chunks must have given its length and digest."""
        if self.row is not None:
            row = self.row
            if row["refers_to"] is None and (self.seen, self.so_far.hexdigest()) != (row["payload_bytes"], row["digest"]):
                raise ValueError(f"the chunks of page {row['page_id']} are not its payload")
            out.write(self.member.compress(b"\r\n\r\n") + self.member.flush())
            self.row = None


def _moved(fs: pa.fs.FileSystem, old: str, new: str) -> None:
    """Renames a file; one of that name, which an attempt that was lost has left, has the same records and goes."""
    if fs.get_file_info(new).type != pa.fs.FileType.NotFound:
        fs.delete_file(new)
    fs.move(old, new)


def _own_revisits(parts: str, part: int) -> dict[tuple, int]:
    """What the revisits of one partition of the source refer to, by page, digest and length."""
    fs, path = _place(f"{parts}/part={part}")
    if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
        return {}
    rows = pa.dataset.dataset(path, filesystem=fs, format="parquet").to_table().to_pylist()
    return {(r["page_id"], r["digest"], r["payload_bytes"]): r["refers_to"] for r in rows}


def write(pages: DataFrame, folder: str | None = None, chunk: int = CHUNK, most_archive: int = MOST_ARCHIVE) -> str:
    """Writes the pages as archives into a folder (a new one in the shared folder unless given), and returns it.

    An archive is written under a name of its attempt and renamed once it is whole, so a lost executor leaves none half,
    and the attempt that follows replaces those that it left whole.
    """
    spark = pages.sparkSession

    def qualified(to: str) -> str:
        # tasks read and write past Spark: they must take a path without scheme for the same file system as Spark does
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(to)
        return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()

    folder = qualified(folder or new_path(spark, "warc"))
    fs, path = _place(folder)
    fs.create_dir(path)
    parts = None

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = _place(folder)
        out, packer, number, own, n_again, skip = None, Packer(), 0, None, 0, False

        def closed() -> None:
            out.close()
            _moved(fs, f"{path}/_{task.taskAttemptId()}-{number}", f"{path}/part-{task.partitionId():06d}-{number:04d}.warc.gz")

        for batch in batches:
            for at in range(batch.num_rows):  # row by row, as a batch of large chunks isn't wanted twice
                row = batch.slice(at, 1).to_pylist()[0]
                if parts:
                    own = _own_revisits(parts, row["part"]) if own is None else own
                    if row["chunk_no"] == 0:
                        row["refers_to"] = own.get((row["page_id"], row["digest"], row["payload_bytes"]))
                        skip = row["refers_to"] is not None
                        n_again += skip
                    elif skip:
                        continue
                    if skip:
                        row["data"] = b""
                if row["chunk_no"] == 0 and out and out.tell() > most_archive:
                    packer.end(out)
                    closed()
                    out, number = None, number + 1
                out = out or fs.open_output_stream(f"{path}/_{task.taskAttemptId()}-{number}")
                packer.add(row, out)
        if out:
            packer.end(out)
            closed()
        yield pa.RecordBatch.from_arrays([pa.array([number + bool(out)], pa.int64()), pa.array([n_again], pa.int64())], ["archives", "again"])

    def run(rows: DataFrame) -> int:
        return rows.mapInArrow(stored, "archives long, again long").agg(F.sum("again")).first()[0] or 0

    again = written(revisits(pages), "revisits")
    if again.count() <= MOST_REVISITS:
        run(chunked(pages, chunk, again=again))
        return folder
    parts = qualified(new_path(spark, "revisits-by-part"))
    here = _rows(pages).where(F.col("payload_bytes") >= LEAST_REVISITED).select(*_PAYLOAD, F.spark_partition_id().alias("part"))
    located = written(here.join(again, _PAYLOAD).select("part", *_PAYLOAD, "refers_to"), "located")
    located.distinct().repartition("part").write.partitionBy("part").parquet(parts)
    if run(_cut(_rows(pages).withColumns({"record": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), chunk, F.lit(True))) != located.count():
        fs.delete_dir_contents(path)
        parts = None
        run(chunked(pages, chunk, again=again))
    return folder


class Archive:
    """A stream of an archive's bytes: members are unpacked block by block."""

    def __init__(self, stream):
        self.stream, self.packed, self.plain, self.unpack = stream, b"", b"", None

    def more(self) -> bool:
        """Unpacks another part; False at the end."""
        while True:
            if not self.packed:
                self.packed = self.stream.read(1 << 16)
                if not self.packed:
                    return False
            if self.unpack is None or self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            part = self.unpack.decompress(self.packed, 1 << 20)
            self.packed = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if part:
                self.plain += part
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed; None at the end."""
        while (at := self.plain.find(mark)) < 0:
            if not self.more():
                return None
        found, self.plain = self.plain[:at], self.plain[at + len(mark) :]
        return found

    def take(self, n: int, most: int) -> Iterator[bytes]:
        """The next n bytes, in parts of `most` bytes but for the last."""
        while n:
            want = min(n, most)
            while len(self.plain) < want:
                if not self.more():
                    raise EOFError("the archive ends within a record")
            part, self.plain = self.plain[:want], self.plain[want:]
            n -= want
            yield part


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}


CHUNKS = "page_id long, record_type string, refers_to long, url string, header_digest string, chunk_no long, last boolean, bytes_so_far long, digest_so_far string"


def _chunks(stream, chunk: int) -> Iterator[tuple]:
    archive = Archive(stream)
    number = lambda x: int(x[len(_ID.split("{")[0]) : -1]) if x and "null" not in x.lower() and "none" not in x.lower() else None
    while (head := archive.until(b"\r\n\r\n")) is not None:
        of = _fields(head)
        http = archive.until(b"\r\n\r\n")
        size = int(of["content-length"]) - len(http) - 4
        digest = base64.b32decode(of["warc-payload-digest"].removeprefix("sha1:")).hex()
        known = (number(of["warc-record-id"]), of["warc-type"], number(of.get("warc-refers-to")), of["warc-target-uri"], digest)
        if of["warc-type"] == "revisit":  # its payload is another record's; length and digest are those that it names
            yield (*known, 0, True, int(_fields(http)["content-length"]), digest, b"")
        else:
            so_far, n, seen = hashlib.sha1(), 0, 0
            for part in archive.take(size, chunk):
                so_far.update(part)
                seen += len(part)
                yield (*known, n, seen == size, seen, so_far.hexdigest(), part)
                n += 1
            if not size:
                yield (*known, 0, True, 0, so_far.hexdigest(), b"")
        if b"".join(archive.take(4, 4)) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")


def read(spark: SparkSession, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """A row for each chunk of the archives in a folder: CHUNKS, then data unless it isn't wanted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")  # names alone are read
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary())[: 9 + with_data]
    names = [c.split()[0] for c in CHUNKS.split(", ")] + ["data"] * with_data

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))[: len(kinds)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch[0].to_pylist():
                fs, path = _place(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for row in _chunks(stream, chunk):
                        rows.append(row)
                        held += len(row[-1]) + 200
                        if held > 8_000_000:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return files.mapInArrow(chunks, CHUNKS + ", data binary" * with_data)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): the pages after a round trip through archives."""
    spark = pages.sparkSession
    rows = written(read(spark, write(pages, folder), with_data=False).where("last"), "records")  # headers and digests alone
    claims = rows.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "bytes_so_far", "digest_so_far").distinct()
    stored = rows.where("record_type = 'response'").select("page_id", "bytes_so_far", "digest_so_far")
    if not claims.join(stored, claims.columns, "left_anti").isEmpty():
        raise ValueError("a revisit refers to a payload that isn't stored")
    checked = F.when(F.col("header_digest") == F.col("digest_so_far"), F.col("digest_so_far")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    return rows.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")
