import gzip
import hashlib
import io
import random
import tracemalloc
from pathlib import Path

import pytest

from heronry.llm import warc
from heronry.llm.common import new_path

from .helpers import clashing, words

PAGES = "page_id long, url string, html string"


def _pages(spark):
    rng = random.Random(1)
    big, long = "é" + words(rng, 300), words(rng, 9000)
    rows = [(3, "http://a/1", big), (9, "http://a/2\r\nX: y", big), (5, None, big), (1, "http://b", "short"), (2, "http://b", "short"), (4, "u", None), (6, "u", "")]
    rows += [(7, "v", long), (8, "w", long + "x"), (None, "n", big), (9, "http://a/2", big), (10, "z", "a\r\n\r\nWARC/1.1\r\n\r\n"), (11, "y", "x" * 1000), (12, "y", "x" * 1000), (13, "y", "x" * 999), (14, "y", "x" * 999)]
    return rows, clashing(spark.createDataFrame(rows, PAGES))


@pytest.mark.parametrize("most_revisits", [warc.MOST_REVISITS, 0])
def test_round_trip(spark, monkeypatch, most_revisits):
    monkeypatch.setattr(warc, "MOST_REVISITS", most_revisits)  # 0: each task reads its own part of the revisits
    monkeypatch.setattr(warc.write, "__defaults__", (None, 700, 2000))
    rows, df = _pages(spark)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    wanted = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and i is not None and i < largest[h]
        wanted.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[h] if again else None))
    assert sorted(map(tuple, warc.archived(df).collect()), key=str) == sorted(wanted, key=str)


def test_chunks_put_together_are_the_payload(spark):
    rows, df = _pages(spark)
    folder = warc.write(df, new_path(spark, "test"), chunk=700, most_archive=2000)
    chunks = warc.read(spark, folder, chunk=1000).where("record_type = 'response'").collect()
    parts = {}
    for r in sorted(chunks, key=lambda r: (str(r["page_id"]), r["chunk_no"])):
        parts.setdefault((r["page_id"], r["header_digest"]), []).append(r)
    by_id = {i: h or "" for i, _, h in rows}
    for (i, _), got in parts.items():
        if i == 9:  # stands there twice
            continue
        data = b"".join(r["data"] for r in got)
        assert data == by_id[i].encode()
        assert [r["last"] for r in got] == [False] * (len(got) - 1) + [True]
        at = 0
        for r in got:
            at += len(r["data"])
            assert r["bytes_so_far"] == at and r["digest_so_far"] == hashlib.sha1(data[:at]).hexdigest()
    files = sorted(Path(folder.removeprefix("file:")).iterdir())
    assert len(files) > 2 and all(f.name.startswith("part-") for f in files)
    assert gzip.decompress(files[0].read_bytes()).startswith(b"WARC/1.1\r\n")


def test_no_step_holds_a_record():
    """A payload of 64 MB is packed and read back in a few hundred kilobytes; chunks that aren't the payload are told."""
    chunk, n, sha = random.Random(1).randbytes(1 << 16), 1024, hashlib.sha1()
    for _ in range(n):
        sha.update(chunk)
    row = {"page_id": 1, "url": "u", "payload_bytes": n << 16, "digest": sha.hexdigest(), "refers_to": None, "data": chunk}
    out, packer = io.FileIO("/dev/null", "w"), warc.Packer()
    tracemalloc.start()
    for k in range(n):
        packer.add(row | {"chunk_no": k}, out)
    packer.end(out)
    assert tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()
    packed, packer = io.BytesIO(), warc.Packer()
    for k in range(n):
        packer.add(row | {"chunk_no": k}, packed)
    packer.end(packed)
    packed.seek(0)
    tracemalloc.start()
    for last in warc._chunks(packed, 1 << 16):
        pass
    assert tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()
    assert last[6] and last[7] == n << 16 and last[8] == sha.hexdigest()
    packer.add(row | {"chunk_no": 0}, io.BytesIO())
    with pytest.raises(ValueError):
        packer.end(io.BytesIO())


def test_no_rows(spark):
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_many_revisits_move_no_payload(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "MOST_REVISITS", 0)
    rows, df = _pages(spark)
    df.repartition(3).write.parquet(f"{tmp_path}/pages")
    df, asked = spark.read.parquet(f"{tmp_path}/pages"), []
    cut = warc._cut

    def seen(*args):
        asked.append(cut(*args))
        return asked[-1]

    monkeypatch.setattr(warc, "_cut", seen)
    monkeypatch.setattr(warc, "chunked", None)  # the shuffle isn't needed
    assert warc.archived(df).where("record_type = 'revisit'").count() == 3
    assert len(asked) == 1 and "Exchange" not in asked[0]._jdf.queryExecution().executedPlan().toString()


def test_a_source_that_deals_its_rows_anew(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_REVISITS", 0)
    rows, df = _pages(spark)
    monkeypatch.setattr(warc, "_own_revisits", lambda parts, part: {})  # as if no row were where it was
    got = sorted(map(tuple, warc.archived(df).collect()), key=str)
    monkeypatch.undo()
    assert got == sorted(map(tuple, warc.archived(df).collect()), key=str) and len(got) == len(rows)


def test_an_attempt_replaces_what_a_lost_one_left(tmp_path):
    fs, path = warc._place(f"file://{tmp_path}")
    for name, data in (("_1-0", b"old"), ("_2-0", b"new")):
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write(data)
        warc._moved(fs, f"{path}/{name}", f"{path}/part-000000-0000.warc.gz")
    assert [(f.name, f.read_bytes()) for f in tmp_path.iterdir()] == [("part-000000-0000.warc.gz", b"new")]


def test_revisits_equal_sql(spark, tmp_path):
    """The tables given have no equal pages, so the query's SQL is held against pages that have."""
    import duckdb

    from heronry.llm.oracles import OP9

    _, df = _pages(spark)
    df.where("page_id is not null").dropDuplicates(["page_id"]).select("page_id", "url", "html").coalesce(1).write.parquet(f"{tmp_path}/pages")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
        wanted = db.sql(OP9).fetchall()
    assert any(r[3] == "revisit" for r in wanted)
    assert sorted(map(tuple, warc.archived(spark.read.parquet(f"{tmp_path}/pages")).collect())) == sorted(wanted)
