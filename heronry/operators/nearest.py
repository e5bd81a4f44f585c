"""Nearest-neighbour join on vectors by an inverted-file index.

Centres are fitted on a bounded sample of the rows (at most SAMPLE, the first by the hash of their id); every row is listed
under its nearest centre. A query visits the lists of its nearest centres first, which leaves a distance that its k-th
neighbour has at most. By the triangle inequality no row of a list is nearer than the query's distance to the centre less
the list's radius, so only lists below that distance are visited then, and the result is exact. Without that second visit
it is approximate: `probes` lists decide the recall.

Lists of more than BLOCK rows are dealt over several groups, so a vector that a third of all rows share is no hot key. A
group holds BLOCK rows, and queries stream past them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..streaming.windows import shared_folder

#: Centres at most, rows that they are fitted on, rows of a group.
CENTRES, SAMPLE, BLOCK = 256, 16_384, 4096
#: Numbers that are compared at once.
TOGETHER = 4_000_000


def _written(df: DataFrame, what: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _vectors(df: DataFrame, key: str, vector: str, size: int | None) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # a NaN is greater than all
    return rows.where(fine if size is None else fine & (F.size("v") == size)).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of a to each of b, from the differences, so that equal vectors have exactly 0."""
    out = np.empty((len(a), len(b)))
    step = max(1, TOGETHER // max(1, b.size))
    for at in range(0, len(a), step):
        out[at : at + step] = np.sqrt(((a[at : at + step, None, :] - b) ** 2).sum(axis=2))
    return out


def _centres(points: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    found = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = ((found**2).sum(axis=1) - 2 * points @ found.T).argmin(axis=1)
        counts = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, points)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def nearest_join(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, probes: int = 8, exact: bool = True, others: bool = True) -> DataFrame:
    """(query_id, rank, row_id, distance): for each of `queries` its k nearest of `rows` by Euclidean distance, of equal ones
    those with smaller ids; all of them where there are fewer. `key` (a whole number) and `vector` (an array of numbers) are
    columns of both. With `others`, a query's own id isn't among its neighbours.

    Rows and queries with a null key, a null or empty vector, or a component that is null or not finite take no part, nor
    do vectors of another length than most rows have (of lengths that are equally frequent, the greatest stays). Repeated
    rows count once; of different vectors under one id each counts. Other columns are not read. An empty table on either
    side gives an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    every = _written(_vectors(rows, key, vector, None), "vectors")
    usual = every.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).agg(F.max_by("size", F.struct("n", "size")).alias("size"), F.max("n").alias("n")).first()
    if usual["size"] is None:
        return spark.createDataFrame([], "query_id long, rank int, row_id long, distance double")
    every = every.where(F.size("v") == usual["size"])
    asked = _vectors(queries, key, vector, usual["size"])
    sample = every.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    centres = _centres(_matrix(sample), min(CENTRES, max(1, round(usual["n"] ** 0.5))))

    def listed(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["v"])
                d = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
                away = np.sqrt(((x - centres[d]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(d.astype(np.int32)), pa.array(away)], ["id", "v", "list", "away"])

    lists = _written(every.mapInArrow(listed, "id long, v array<double>, list int, away double"), "lists")
    radii, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    sizes = lists.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    for r in sizes.collect():  # a row a centre
        radii[r["list"]], counts[r["list"]] = r["radius"], r["n"]
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block")
    lists = lists.join(F.broadcast(sizes.select("list", "n")), "list").select("list", block, "id", "v")

    def requests(of: DataFrame, first: bool) -> DataFrame:
        """(list, block, id, v, reach): a row for each block that a query visits first, or then."""

        def visited(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                away = _distances(_matrix(batch["v"]), centres)
                away[:, counts == 0] = np.inf
                order = np.argsort(away, axis=1, kind="stable")
                reach = batch["reach"].to_numpy()
                at, to, blocks = [], [], []
                for q in range(batch.num_rows):
                    early = order[q, :probes]
                    chosen = early if first else np.setdiff1d(np.flatnonzero(away[q] - radii <= reach[q] * (1 + 1e-9) + 1e-9), early)
                    for c in chosen[counts[chosen] > 0]:
                        n = -(-int(counts[c]) // BLOCK)
                        at += [q] * n
                        to += [c] * n
                        blocks += range(n)
                own = [batch[c].take(pa.array(at, pa.int64())) for c in ("id", "v", "reach")]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blocks, pa.int32()), *own], ["list", "block", "id", "v", "reach"])

        return of.mapInArrow(visited, "list int, block int, id long, v array<double>, reach double")

    def found(of: DataFrame) -> DataFrame:
        """(query_id, row_id, distance): the k nearest of each block that was visited, as far as they are in reach."""

        def answers(batches):
            held, group, parts = None, None, []
            for batch in batches:
                keys = np.stack([batch[c].to_numpy() for c in ("list", "block", "kind")])
                cuts = [0, *(1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))).tolist(), batch.num_rows]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    part = batch.slice(a, b - a)
                    if group != (keys[0, a], keys[1, a]):
                        held, group, parts = None, (keys[0, a], keys[1, a]), []
                    if keys[2, a] == 0:
                        parts.append(part)
                        continue
                    if not parts:
                        continue
                    if held is None:
                        whole = pa.Table.from_batches(parts).sort_by("id")
                        held = whole["id"].to_numpy(), _matrix(whole["v"].combine_chunks())
                    ids, x = held
                    who = part["id"].to_numpy()
                    d = _distances(_matrix(part["v"]), x)
                    open_ = d <= part["reach"].to_numpy()[:, None]
                    if others:
                        open_ &= ids != who[:, None]
                    d = np.where(open_, d, np.inf)
                    best = np.argsort(d, axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(d, best, 1)
                    q, place = np.nonzero(np.isfinite(value))
                    yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(q)), part["v"].take(pa.array(q)), pa.array(ids[best[q, place]]), pa.array(value[q, place])], ["query_id", "qv", "row_id", "distance"])

        both = lists.select("list", "block", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("reach"))
        both = both.unionByName(of.withColumn("kind", F.lit(1))).repartition("list", "block").sortWithinPartitions("list", "block", "kind")
        return both.mapInArrow(answers, "query_id long, qv array<double>, row_id long, distance double")

    def best(of: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id", "qv").orderBy("distance", "row_id"))
        return of.withColumn("rank", place).where(F.col("rank") <= k)

    asked = _written(asked.withColumn("reach", F.lit(float("inf"))), "asked")
    near = _written(best(found(requests(asked, True))), "near")
    if exact:
        reach = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("qv").alias("v"), F.col("distance").alias("reach"))
        rest = asked.drop("reach").join(reach, ["id", "v"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))).select("id", "v", "reach")
        near = best(near.drop("rank").unionByName(found(requests(rest, False))))
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "row_id", "distance")
